import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ruleloom.llm import packing
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401


@pytest.fixture(scope="module")
def tok():
    return packing.WordTokenizer(packing.default_path())


def test_word_cache_matches_the_library(tok):
    random.seed(3)
    signs = list(" \n\t'''srtvlemdXé1٣!.,　日\r🙂́ͅΣσİßǅ") + ["<|endoftext|>", "  ", "a.", "B,", ".."]
    texts = ["".join(random.choice(signs) for _ in range(random.randrange(40))) for _ in range(2000)]
    for text, ids in zip(texts, tok.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.tok.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(
    ("histogram", "most"),
    [
        ({}, 0),
        ({4096: 5}, 5),
        ({1: 10000}, 3),
        ({2048: 7, 2049: 3}, 7),
        ({1366: 9000, 1365: 9000}, 7000),
        ({700: 5000, 1000: 3000, 1396: 3000}, 2800),
        (dict(Counter(random.Random(1).choices(range(1, 1500), k=20000))), 3690),
    ],
)
def test_compositions_hold_every_item_once(histogram, most):
    made = packing.compositions(histogram)
    held = Counter()
    for items, n in made:
        assert sum(length * a for length, a in items.items()) <= 4096
        for length, a in items.items():
            held[length] += n * a
    assert held == Counter(histogram)
    assert sum(n for _, n in made) <= most


def test_knapsack_values_match_brute_force():
    lengths, values = np.array([3, 5, 7]), np.array([3.1, 5.3, 7.2])
    best = packing._price(values, lengths, 30)
    want = [max(a * 3.1 + b * 5.3 + c * 7.2 for a in range(11) for b in range(7) for c in range(5) if 3 * a + 5 * b + 7 * c <= room) for room in range(31)]
    assert np.allclose(best, want)


def _check(rows, texts, tok, capacity=4096):
    want = Counter()
    for doc_id, text in texts:
        ids = [*tok.tok.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in seats.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seats)


def test_query(spark, docs, folder, tok):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    _check(RUN["op4_best_fit_packing"](spark, folder(documents=docs)).collect(), texts, tok)
    assert RUN["op4_best_fit_packing"](spark, folder(documents=docs.limit(0))).count() == 0


def test_hot_length_and_short_sequences(spark, tok):
    texts = [(i, "same words here" if i % 3 else "word " * (i % 50)) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = packing.pack_documents(df, capacity=32).collect()
    total = sum(r.length for r in rows)
    assert _check(rows, texts, tok, 32) <= total / 32 * 1.05 + 1


def test_best_fit_repeats_compositions():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))}
        rooms = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                room = min((r for r in rooms if r >= length), default=None)
                if room is not None:
                    rooms.remove(room)
                rooms.append((capacity if room is None else room) - length)
        made = packing._best_fit(list(counts), list(counts.values()), capacity)
        assert sorted(capacity - sum(x * a for x, a in items.items()) for items, n in made for _ in range(n)) == sorted(rooms)
        assert len(made) <= 3 * len(counts)
        assert sum((Counter({x: a * n for x, a in items.items()}) for items, n in made), Counter()) == Counter(counts)


def test_entries_follow_the_lengths_and_not_the_items():
    histogram = {x: 20_000 + x for x in range(100, 1500, 7)}
    made = packing.compositions(histogram)
    assert len(made) < 40 * len(histogram)
    assert sum((Counter({x: a * n for x, a in items.items()}) for items, n in made), Counter()) == Counter(histogram)
    made, left = list(packing._rounded(histogram, 4096, packing.ROUNDS))[-1]
    assert sum(left.values()) <= len(histogram) or sum(x * n for x, n in left.items()) < 0.02 * sum(x * n for x, n in histogram.items())
