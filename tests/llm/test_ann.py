import numpy as np
import pytest

from ruleloom.llm import ann
from ruleloom.llm.registry import RUN
import ruleloom.llm.queries  # noqa: F401


def exact(rows, top=20):
    """query_id -> [(score, vec_id)], by plain sums in the order of the components."""
    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, table = np.array(sorted(good)), np.array([good[i] for i in sorted(good)], dtype=np.float32).astype(np.float64)
    out = {}
    for q in ids[ids % 20 == 0]:
        line = np.zeros(len(ids))
        for d in range(8):
            line += np.float64(np.float32(good[q][d])) * table[:, d]
        out[int(q)] = sorted((-s, int(i)) for s, i in zip(line, ids) if i != q)[:top]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8))
    table = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 8))
    table[300:700] = table[299]  # a vector that many rows share
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(table)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [float("inf")] * 8), (2080, [None] + [1.0] * 7), (2100, [1.0] * 5), (2120, []), (None, [1.0] * 8), rows[40], rows[41]]
    return rows


def test_recall_order_and_ties(spark, rows, folder):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "vec_id long, embedding array<float>, label int, part string, block int").repartition(5)
    sf = folder(embeddings=df)
    got = {}
    for r in sorted(RUN["op8_learned_partitions"](spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = exact(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    tied = [f[2] for f in got[320]]
    assert tied == [i for _, i in want[320]]  # equal scores, smallest ids


def test_all_parts_give_exact_results_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    df = ann.valid(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    router = ann.build(df, sample_rows=800, parts=6)
    got = ann.search(df, df.where("vec_id % 20 = 0"), router, mass=2.0).collect()
    want = exact(rows)
    assert len(got) == 20 * len(want)
    for r in got:
        score, vec_id = want[r.query_id][r["rank"] - 1]
        assert (r.vec_id, r.score) == (vec_id, -score)


def test_few_rows_and_none(spark, folder):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in RUN["op8_learned_partitions"](spark, folder(embeddings=df)).collect()}
    assert got == {(0, 1, 7, 0.5), (0, 2, 20, 0.0), (20, 1, 7, 0.5), (20, 2, 0, 0.0)}
    assert RUN["op8_learned_partitions"](spark, folder(embeddings=df.limit(0))).count() == 0


def test_parts_are_balanced_and_keep_neighbours():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(8, 16)), 100, axis=0) + 0.1 * rng.normal(size=(800, 16))
    graph = ann.nearest(points / np.linalg.norm(points, axis=1, keepdims=True), 10)
    of = ann.balanced_parts(graph, 8, rng)
    assert np.bincount(of, minlength=8).max() <= 105
    assert (of[graph] == of[:, None]).mean() > 0.5


def _always(*bias):
    return ann.Classifier(1.0, [np.zeros((2, 1)), np.zeros(1), np.zeros((1, len(bias))), np.array(bias, float)])


def test_routes_hold_the_own_part_and_enough_rows(spark):
    router = ann.Router(_always(0, 9, 0), _always(20, 0, 5))
    x = np.ones((3, 2))
    assert [r.tolist() for r in router.routes(x, 0.95)] == [[0, 1]] * 3
    assert [r.tolist() for r in router.routes(x, 0.95, {0: 5, 1: 2, 2: 30}, 21)] == [[0, 2, 1]] * 3
    assert [r.tolist() for r in router.routes(x, 0.95, {1: 3}, 21)] == [[0, 2, 1]] * 3
    df = ann.valid(spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "vec_id long, embedding array<float>"))
    assert ann.search(df, df.where("vec_id = 20"), router).count() == 20
