import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ruleloom.llm import pii
from ruleloom.llm.common import small
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(digits))))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_random_texts_match_the_patterns():
    rng = random.Random(11)
    for _ in range(6000):
        text = "".join(rng.choice("a_B%@@..--+++()  0123456789\né") for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == plain(text), repr(text)
    digits = "".join(rng.choice("0123456789") for _ in range(30000))
    for text in ("4111 1111-1111 1111 x 4111111111111112", "0255.1.2.3 256.1.1.1 1.2.3.4.5.6.7.8.9", "a@b.c_d@e.f@g.h a@@b.c", digits, "a" * 50000 + "@" + "b" * 50000, "+1" * 5000):
        assert pii.base_spans(text) == plain(text)


def documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for i in range(150):
        words = [word() for _ in range(30)] + ["common"] * 3
        rng.shuffle(words)
        if i % 5 == 0:
            words[10:10] = ["Zanzibar", "agent", "mail", "james@secret.example.org", "codename", "007"]
        if i % 7 == 0:
            words[20:20] = ["agent", "call", "+44 20 7946 0999", "harbour"]
        if i % 11 == 0:
            words.append(f"harbour 10.0.{i}.1")
        rows.append((i, " ".join(words)))
    return [*rows, (900, None), (901, ""), (3, rows[0][1]), (None, rows[5][1])]


def brute(rows, window=None, prior=pii.PRIOR):
    base = [plain(t) for _, t in rows]
    near, with_term, with_entity, together = [], Counter(), Counter(), Counter()
    for (_, text), spans in zip(rows, base):
        text = text or ""
        with_term.update(set(re.findall(r"\w+", text.lower())))
        words = [m.span() for m in re.finditer(r"\w+", text) if not any(m.start() < b and a < m.end() for _, a, b in spans)]
        found, names = set(), set()
        for kind, a, b in spans:
            name = (kind, re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower())
            left, right = [w for w in words if w[0] < a], [w for w in words if w[0] >= b]
            chosen = left + right if window is None else left[-window:] + right[:window]
            found |= {(name, text[s:e].lower(), s, e) for s, e in chosen}
            names.add(name)
        near.append(found)
        with_entity.update(names if window is None else {f[0] for f in found})
        together.update({f[:2] for f in found})
    n, out = len(rows), []
    for (doc_id, _), spans, found in zip(rows, base, near):
        more = {}
        for who, term, s, e in found:
            k = together[who, term]
            if with_entity[who] < n:
                share = math.log(n * k / (with_entity[who] * max(with_term[term], k))) / math.log(n / with_entity[who])
                share = round(share * k / (k + prior), 9)
                if share >= 0.5:
                    more[s, e] = max(more.get((s, e), ""), "remove" if share >= 0.8 else "general")
        every = [*spans, *sorted((kind, s, e) for (s, e), kind in more.items())]
        counts = Counter(k for k, _, _ in spans)
        digest = hashlib.sha256(pii.spans_text(spans).encode()).hexdigest()
        out.append((doc_id, *(counts[k] for k in PATTERNS), digest, pii.spans_text(every)))
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [pii.HELD_TERMS, 50])
def test_query_matches_brute_force(spark, folder, monkeypatch, held):
    monkeypatch.setattr(pii, "HELD_TERMS", held)
    rows = documents()
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, term string, row int").repartition(4)
    got = sorted((tuple(r) for r in RUN["op5_personal_data"](spark, folder(documents=df)).collect()), key=str)
    assert got == brute(rows)
    assert any("remove" in r[-1] for r in got) and any("general" in r[-1] for r in got)


def test_texts_are_sanitised(spark):
    rows = documents()
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, more string, ident int")
    done = pii.sanitise(df)
    assert done.columns == df.columns and done.count() == len(rows)
    by_id = {r.doc_id: r for r in done.collect()}
    assert "james" not in by_id[0].text and "[EMAIL]" in by_id[0].text and "codename" not in by_id[0].text.lower()
    assert by_id[1].text == rows[1][1] and by_id[900].text is None and by_id[901].text == ""
    assert (by_id[0].more, by_id[0].ident) == ("t", 1)
    assert pii.sanitise(df.limit(0)).count() == 0


def test_awkward_and_empty(spark, docs, folder):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in RUN["op5_personal_data"](spark, folder(documents=docs)).collect()), key=str)
    assert got == brute(rows)
    assert RUN["op5_personal_data"](spark, folder(documents=docs.limit(0))).count() == 0


def test_overlapping_spans():
    assert pii.sanitised("call +1 45.114.23.72 now Bob 7", [("general", 25, 28), ("general", 29, 30)]).startswith("call [PHONE]")
    assert pii.sanitised("x Bob 7", [("general", 2, 5), ("remove", 6, 7)]) == "x [NAME] "


def test_words_in_a_window_match_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.digest(pii.find_personal_data(df, window=10)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, window=10) != brute(rows)


@pytest.mark.parametrize("most", [400_000, 0])
def test_evidence_of_one_document(spark, folder, monkeypatch, most):
    monkeypatch.setattr(pii, "small", lambda df: df if most == 0 else small(df))
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    far = "alone.person@one.example.org " + "common " * 40 + "Quartermaine " + "common " * 40 + "10.9.8.7 10.9.8.6"
    rows = [*documents(), (700, far), (701, "nobody common here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    at, where = far.index("Quartermaine"), folder(documents=df)
    for name, prior, action in (("op5_personal_data", pii.PRIOR, "general"), ("op5_whole_documents", 0.0, "remove")):
        got = sorted((tuple(r) for r in RUN[name](spark, where).collect()), key=str)
        assert got == brute(rows, prior=prior)
        spans = {r[0]: r[-1] for r in got}
        assert f"{action}:{at}:{at + 12}" in spans[700] and ":" not in spans[701]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[NAME]" in clean[700] and "Quartermaine" not in clean[700] and clean[701] == "nobody common here"
