"""Near words by acceptors against comparing all pairs, and words counted one by one."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import spelling


def near(u, v):
    """Exactly one inserted, deleted or replaced character."""
    if len(u) > len(v):
        u, v = v, u
    if len(v) - len(u) > 1 or u == v:
        return False
    e = next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u[e:] == v[e + 1 :] if len(u) < len(v) else u[e + 1 :] == v[e + 1 :]


def plain_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 5 and len(w) >= 6}


def plain_variants(words):
    """(word, form, root, n, n_near, form_n) by comparing every pair that shares no more than luck."""
    by_gap = {}
    for w in words:
        for gapped in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_gap.setdefault(gapped, []).append(w)
    around = {w: set() for w in words}
    for some in by_gap.values():
        for u in some:
            around[u].update(v for v in some if near(u, v))
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items()}


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(set(out)) == len(out)
    return set(out)


def random_words(seed, size, letters="abcß", longest=11):
    r = random.Random(seed)
    stock = set()
    while len(stock) < size:
        w = "".join(r.choices(letters, k=r.randint(6, longest)))
        stock.add(w)
        if r.random() < 0.7:
            i = r.randrange(len(w))
            stock.add(r.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]]))
    return {w: r.choice([5, 6, 25, 26, 30, 125, 700, 4000]) for w in sorted(stock) if len(w) >= 6}


@pytest.mark.parametrize("seed", range(30))
def test_accept_is_minimal_and_compose_finds_each_pair_once(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(spelling, "STATES", 3)
        monkeypatch.setattr(spelling, "EQUAL_STATES", 2)
    r = random.Random(seed)
    groups = [sorted({"".join(r.choices("abc", k=r.randint(0, 4))) for _ in range(r.randint(1, 25))}) for _ in range(4)]
    parts = [p for g in groups for p in g]
    number = np.array([i for i, g in enumerate(groups) for _ in g])
    a = spelling.accept(number, [p.encode() for p in parts])

    def language(s):
        out = {""} if a.final[s] else set()
        for x in range(a.first[s], a.first[s + 1]):
            assert a.before[x] == len(out)
            out |= {chr(a.symbol[x]) + w for w in language(a.target[x])}
        return out

    assert [language(s) for s in a.initial] == [set(g) for g in groups]
    languages = [frozenset(language(s)) for s in range(len(a.final))]
    assert len(set(languages)) == len(languages)
    heads = np.flatnonzero(np.diff(number, prepend=-1))
    for width in (0, 1, 9):
        found = [(int(x), int(y)) for one, two in spelling.compose(a, heads, np.full(4, width)) for x, y in zip(one, two)]
        expected = set()
        for i, u in enumerate(parts):
            for j, v in enumerate(parts):
                if number[i] == number[j] and near(u, v) and (len(u), i) < (len(v), j):
                    e = next((k for k, (x, y) in enumerate(zip(u, v)) if x != y), len(u))
                    if e <= width:
                        expected.add((i, j))
        assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 2])
def test_variants_equal_all_pairs(spark, group_words):
    words = random_words(7, 900) | random_words(8, 150, "ÿaé", 7) | {"shared": 5, "shred!"[:5] + "ed": 26, "x" * 40: 5, "x" * 41: 600, "x" * 42: 5000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = rows(spelling.group_variants(df, group_words=group_words))
    assert got == plain_variants(words)
    assert any(form is not None and root not in (word, form) for word, form, root, *_ in got)


def test_blocks_of_groups(spark, monkeypatch):
    words = random_words(9, 300)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 10)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.group_variants(df)) == plain_variants(words)


def test_words(spark, docs):
    extra = [(i, "Straßen Straßen ×÷×÷×÷ ÀÉÎÕÜß abcdefg ABCDEFG 𝒳abcdefg日abcdefg short", "w") for i in range(3000)]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, word string").select("doc_id", "text"), allowMissingColumns=True).withColumn("n", F.lit("x"))
    plain = plain_words([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert dict(spelling.vocabulary(df).collect()) == plain
    assert plain["ÀÉÎÕÜß"] > 2000 and any(w not in ("straßen", "abcdefg") and near(w, "abcdefg") for w in plain)


def test_nothing(spark, docs):
    assert spelling.group_variants(spelling.vocabulary(docs.limit(0))).count() == 0
    one = spark.createDataFrame([("lonely", 9)], "word string, n long")
    assert rows(spelling.group_variants(one)) == {("lonely", None, "lonely", 9, 0, None)}


def test_query_on_the_table(spark):
    from ruleloom.llm.queries import RUN

    sf = "/root/testdata/sf0.01"
    words = plain_words([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert rows(RUN["op12_spelling_variants"](spark, sf)) == plain_variants(words)
