import random
import re

import duckdb
import pytest

from ruleloom.llm import linededup
from ruleloom.llm.registry import RUN, SQL
import ruleloom.llm.queries  # noqa: F401


def brute(rows, min_words=linededup.MIN_WORDS):
    """(doc_id, start, end, words, holder) of the runs to cut, one document after the other."""
    cut = []
    for doc_id, text in rows:
        pieces, at = [], 0
        for m in re.finditer(linededup.UNIT, text or ""):
            plain = " ".join(w for w in re.split(r"[ \t\r\n]+", m[0].lower()) if w)
            pieces.append((m.start(), m.end(), plain))
            at = m.end()
        assert at == len(text or "")
        cut.append((doc_id, pieces))
    rank = lambda d: (d is None, d or 0)
    first = {}
    for doc_id, pieces in cut:
        for _, _, plain in pieces:
            if plain and (plain not in first or rank(doc_id) < rank(first[plain])):
                first[plain] = doc_id
    out = []
    for doc_id, pieces in cut:
        run, seen = [], set()
        for a, b, plain in [*pieces, (0, 0, "")]:
            if plain and (rank(first[plain]) < rank(doc_id) or plain in seen):
                run.append((a, b, len(plain.split(" ")), first[plain]))
            else:
                if sum(r[2] for r in run) >= min_words:
                    out.append((doc_id, run[0][0], run[-1][1], sum(r[2] for r in run), run[0][3]))
                run = []
            seen.add(plain)
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", "!", "?", "!!"])
    passages = [" ".join(sentence(rng.randrange(4, 14)) for _ in range(7)) for _ in range(5)]
    hot = " ".join(sentence(9) for _ in range(4))
    rows = []
    for i in range(120):
        lines = [" ".join(sentence(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), hot.upper() if i % 2 else hot.replace(" ", "  "))
        if i % 4 == 0:  # in the middle of a line
            k = rng.randrange(len(lines))
            a, b = lines[k][: len(lines[k]) // 2].rsplit(" ", 1) if " " in lines[k][: len(lines[k]) // 2] else (lines[k], "")
            lines[k] = f"{a} {rng.choice(passages)} {b}"
        rows.append((1000 - 7 * i, rng.choice(["\n", " \n\n", "\r\n"]).join(lines)))
    rows += [(5000, rows[0][1]), (None, rows[0][1]), (None, rows[3][1]), (5001, None), (5002, ""), (5003, " \n . \n"), (5004, (hot + "\n") * 3), (5004, (hot + "\n") * 3)]
    return rows


def test_matches_brute_force(spark, rows, folder):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, low string, rank int, found int").repartition(6)
    got = RUN["op1_line_dedup"](spark, folder(documents=df)).collect()
    want = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 40


def test_passages_go_and_other_columns_stay(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, removed string, rank int, cut int")
    done = linededup.dedup_units(df, removed_col="gone")
    assert done.columns == [*df.columns, "gone"]
    texts = {}
    for r in done.collect():
        texts.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        for r in texts[doc_id]:
            assert (r.removed, r.rank, r.cut) == ("x", 1, 2)
            if text is None:
                assert r.text is None and r.gone == []
    edges = [[0, *(e for g in r.gone for e in (g.start, g.end)), len(dict(rows)[5000])] for r in texts[5000]]
    assert texts[5000][0].text == "".join(dict(rows)[5000][a:b] for a, b in zip(edges[0][::2], edges[0][1::2]))
    assert linededup.dedup_units(df.limit(0)).count() == 0


def test_sql_agrees(spark, folder):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(SQL["op1_line_dedup"]).fetchall()
    got = [tuple(r) for r in RUN["op1_line_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and got
