"""Repaired conversations against a plain shortest-way search and damage done in Python."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """Least (cost, letters, result) over all ways, cheapest and then first letters first.

    `rows` are (role, text, initial, fault); a way's roles are tested as a whole.
    """
    prefixes = re.compile(r"s?(ua)*u?")
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit
        # Only the last two letters and whether there are any matter for what may follow.
        state = (i, roles[-1:], bool(roles))
        if state in seen:
            continue
        seen.add(state)
        after = [(cost + 3, "I", i, r) for r in "ua"]
        if i < len(rows):
            _, _, initial, fault = rows[i]
            after.append((cost + 4, "D", i + 1, ""))
            if fault not in "bd":
                more = 3 if fault == "t" else 0
                after += [(cost + more, "K", i + 1, initial)] + [(cost + 3 + more, "R", i + 1, r) for r in "ua"]
        for total, letter, following, role in after:
            if prefixes.fullmatch(roles + role):
                heapq.heappush(heap, (total, audit + letter, following, roles + role))
    raise AssertionError


def plain(turns):
    """What the operator returns, from rows (conv_id, turn, role, text)."""
    conversations = defaultdict(list)
    for conv_id, turn, role, text in turns:
        rows = conversations[conv_id]
        blank = lambda v: " " if v is None else v
        role, text = blank(role), blank(text)
        kind = zlib.crc32(f"{blank(conv_id)}:{blank(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, rows in conversations.items():
        digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(*r[1:])))
        seen, marked = set(), []
        for _, role, text in rows:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
            fault = "b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else " " if last in ".!?" else "t"
            seen.add((role, text))
            marked.append((role, text, role[:1] or " ", fault))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [m[2] for m in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_edits(marked)
        result, at = [], 0
        for letter in audit:
            following = "assistant" if result and result[-1][0][0] == "u" else "user"
            if letter == "I":
                result.append((following, ""))
                continue
            role, text = marked[at][:2]
            at += 1
            if letter in "KR":
                result.append((role if letter == "K" else following, text))
        assert LEGAL.fullmatch("".join(r[0] for r, _ in result))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        count = lambda f: sum(m[3] == f for m in marked)
        out[conv_id] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, sha)
    return out


def got(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax-"), st.sampled_from("bdt   ")), max_size=9))
def test_search_equals_the_shortest_way(turns):
    rows = [("", "", initial, fault) for initial, fault in turns]
    expected = plain_edits(rows)
    text = "".join((i if i in "sua" else "-") + f for i, f in turns)
    assert repair.search(text) == expected
    for size in (1, 2, 4):
        parts = [repair.ways(text[i : i + 2 * size]) for i in range(0, len(text), 2 * size)] or [repair.ways("")]
        whole = parts[0]
        for part in parts[1:]:
            whole = repair.join_ways(whole, part)
        assert min(w for e in repair.ENDS if (w := whole[e])) == expected


@pytest.fixture(scope="module")
def turns():
    rows = []
    for conv in range(150):
        for turn in range(conv % 9):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", f"Turn {turn} of {conv}."))
    rows += [
        (900, None, None, None), (900, None, "user", "Hi."), (900, 3, "system", "Be kind."), (900, 3, "system", "Be kind."), (900, -4, "", "No role."),
        (901, None, "user", "a\x0b\x0c\r\n"), (901, None, "assistant", "ends. \t"), (901, None, "tool", "é" * 70000),
        (None, 1, "user", "No id."), (None, 2, "assistant", "Still none"), (None, None, "student", "x."),
        (902, 5, "assistant", "Ünïcödé 🙂?"), (902, 9, "agent", "other role!"), (902, 7, "user", " "),
    ]
    # Single turns, some of them dropped; a long one, and one of copies.
    rows += [(conv, 0, "user", "Alone.") for conv in range(1000, 1060)]
    rows += [(903, t, ("system", "user", "assistant", "user", "user", "assistant")[t * t % 6], f"t{t % 300}{'.' if t % 7 else ''}") for t in range(700)]
    rows += [(904, t, "user", "Again.") for t in range(200)]
    return rows


def test_equals_plain(spark, turns):
    df = spark.createDataFrame(turns, SCHEMA)
    expected = plain(turns)
    assert got(repair.repair_conversations(df)) == expected
    assert any(not e[6] and e[-1] == hashlib.sha256(b"").hexdigest() for e in expected.values())
    # Any order of the table, in other partitions and with further columns, gives the same.
    other = df.withColumn("audit", F.lit("x")).withColumn("fault", F.lit(1)).orderBy(F.desc("text")).repartition(5)
    assert got(repair.repair_conversations(other)) == expected


def test_small_pieces_and_rounds(spark, turns, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 3)
    monkeypatch.setattr(repair, "JOINED", 4)
    df = spark.createDataFrame(turns, SCHEMA)
    assert got(repair.repair_conversations(df)) == plain(turns)


def test_empty_table(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_the_table(spark):
    from ruleloom.llm.queries import RUN

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(RUN["op13_conversation_repair"](spark, sf)) == plain(rows)
