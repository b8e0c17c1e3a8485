import random

import numpy as np
import pytest

from ruleloom.llm import common, neardup
from ruleloom.llm.components import components
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401

FOLD = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
BLANKS = " \t\n\x0b\x0c\r"


def shingles(text):
    clean = (text or "").translate(FOLD)
    for c in BLANKS:
        clean = clean.replace(c, " ")
    words = [w for w in clean.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    return sorted(_brute(rows), key=str)


def brute_row(rows, i, known={}):  # noqa: B006
    key = id(rows)
    if key not in known:
        known[key] = _brute(rows)
    return known[key][i][3]


def _brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    comps = [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
    return [(d, len(sets[i]), comps[i], d == comps[i]) for i, (d, _) in enumerate(rows)]


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 7)))
    rows = []

    def add(words, sep=" "):
        rows.append((len(rows) * 3 + 1, sep.join(words)))

    for _ in range(25):
        base = [word() for _ in range(rng.randrange(12, 150))]
        add(base)
        for _ in range(rng.randrange(0, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            add([w.upper() if w.isascii() and rng.random() < 0.1 else w for w in copy], rng.choice([" ", "\n", "\t "]))
    hot = [word() for _ in range(60)]
    for _ in range(60):  # a large group of near copies, no two alike
        copy = list(hot)
        copy[rng.randrange(60)] = word()
        add(copy)
    common_part = [word() for _ in range(30)]
    for _ in range(40):  # one passage in many texts
        add([word() for _ in range(25)] + common_part)
    for text in ("one two", "one  two", "a b c d e", "a b c d f", "", None, " \n", "x", "X", "É x", "é x", "a b c d e"):
        rows.append((len(rows) * 3 + 1, text))
    rows += [(4, rows[0][1]), (4, rows[0][1]), (4, "another text with the same id as one above"), (None, rows[0][1]), (None, "nobody else has this text here"), (None, None)]
    return rows


def test_sets_and_hash_sizes():
    texts = [t for _, t in corpus(3)] + ["w" * 5000 + " " + "long " * 20000]
    assert [len(s) for s in neardup.shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    assert [s.tolist() for s in neardup.shingle_sets(texts)] == [neardup.shingle_sets([t])[0].tolist() for t in texts]


def test_agreement_estimates_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sa, sb = (np.frombuffer(neardup.signature(x), ">u4") for x in (a, a[:800]))
    assert abs((sa == sb).mean() - 0.8) < 0.15


@pytest.mark.parametrize(("most", "dense"), [(common.BROADCAST_ROWS, neardup.DENSE), (0, 1)])
def test_matches_brute_force(spark, folder, monkeypatch, most, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "small", lambda df: common.small(df, most))
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", "s", 0.5) for r in rows], "doc_id long, text string, content string, signature string, region double")
    got = RUN["op6_lsh_forest"](spark, folder(documents=df.repartition(5))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, "c", i) for i, r in enumerate(rows)], "doc_id long, text string, content string, ident int").repartition(3)
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {(d, t) for (d, t), row in zip(rows, [brute_row(rows, i) for i in range(len(rows))]) if row}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_awkward_and_empty(spark, docs, folder):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = RUN["op6_lsh_forest"](spark, folder(documents=docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert RUN["op6_lsh_forest"](spark, folder(documents=docs.limit(0))).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (1000, 1000), (5000, 5000)] + [(2000, 2000 + i) for i in range(200)]
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    want = {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000, **{2000 + i: 2000 for i in range(200)}}
    assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_near_copies_without_id_are_linked(spark, folder):
    words = [f"word{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (None, " ".join([*words, "end"])), (9, " ".join(["begin", *words])), (11, "some other text of a few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = RUN["op6_lsh_forest"](spark, folder(documents=df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert sum(r.component_id == 9 for r in got) == 3


def test_a_worker_holds_few_rows_at_a_time(spark):
    def held(_, ids, texts):
        return {"doc_id": ids, "held": [sum(map(len, texts))] * len(ids)}

    rows = spark.range(0, 64, 1, 1).selectExpr("id as doc_id", "repeat('word ', 13000) as text")
    got = common.map_slices(rows, held, "doc_id long, held long", 1).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(64)]
    assert max(r["held"] for r in got) < common.ROW_SLICE_BYTES + 65_000 <= 1 << 19
