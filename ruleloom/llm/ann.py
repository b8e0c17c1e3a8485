"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size that
separate few neighbours. A small classifier learns from a vector in which parts its
neighbours lie. It gives every row its part, and sends a query to the most probable parts
until they hold most of the probability, where all rows are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 20
QUERY_STEP = 20
SAMPLE_ROWS = 6000
PARTS = 16
GRAPH_NEIGHBOURS = 16
HIDDEN = 64
EPOCHS = 40
BATCH = 128
DECAY = 1e-4
MASS = 0.95
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def nearest(points: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """The k nearest other points of each by inner product."""
    out = []
    for i in range(0, len(points), step):
        scores = points[i : i + step] @ points.T
        scores[np.arange(len(scores)), np.arange(i, i + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, min(k, len(points) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 30) -> np.ndarray:
    """Parts of nearly equal size that keep neighbours together.

    Nodes move to the part that holds most of their neighbours, the surest first, as long
    as it has room.
    """
    n = len(graph)
    sources, targets = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    both = np.concatenate((sources, targets)), np.concatenate((targets, sources))
    room = -(-n * 105 // (100 * parts))
    of = rng.permutation(np.arange(n) % parts)
    for _ in range(sweeps):
        votes = np.bincount(both[0] * parts + of[both[1]], minlength=n * parts).reshape(n, parts) + rng.random((n, parts)) * 0.1
        gain = votes.max(axis=1) - np.partition(votes, -2, axis=1)[:, -2]
        sizes, new = np.zeros(parts, int), np.empty(n, int)
        for i in np.argsort(-gain).tolist():
            for p in np.argsort(-votes[i]).tolist():
                if sizes[p] < room:
                    new[i] = p
                    sizes[p] += 1
                    break
        if (new == of).mean() > 0.999:
            break
        of = new
    return of


@dataclass
class Classifier:
    """One hidden layer; vectors are scaled by the sample's mean length."""

    scale: float
    weights: list[np.ndarray]

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        hidden, bias, out, out_bias = self.weights
        logits = np.maximum(vectors / self.scale @ hidden + bias, 0) @ out + out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """Which part a row belongs to, and in which parts the nearest rows of a query lie."""

    own: Classifier
    near: Classifier

    def part(self, vectors: np.ndarray) -> np.ndarray:
        return self.own.probabilities(vectors).argmax(axis=1)

    def routes(self, vectors: np.ndarray, mass: float, rows: dict[int, int] | None = None, least: int = 0) -> list[np.ndarray]:
        """For each query the most probable parts, until they hold `mass` and `least` of the
        rows, and its own part, where copies of it lie. `rows` has the number in each part."""
        p = self.near.probabilities(vectors)
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        counts = np.minimum((held < mass).sum(axis=1) + 1, p.shape[1])
        if rows is not None:
            in_part = np.array([rows.get(i, 0) for i in range(p.shape[1])], np.int64)
            enough = (np.cumsum(in_part[order], axis=1) < least).sum(axis=1) + 1
            counts = np.maximum(counts, np.minimum(enough, p.shape[1]))
        return [o[:c] if k in o[:c] else np.append(o[:c], k) for o, c, k in zip(order, counts, self.part(vectors))]


def train(x: np.ndarray, goal: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Weights that minimise the cross entropy with the goal's distributions, by Adam."""
    dims, parts = x.shape[1], goal.shape[1]
    weights = [rng.normal(0, 3 / np.sqrt(dims), (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            rows, t = order[i : i + BATCH], t + 1
            h = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            logits = h @ weights[2] + weights[3]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            back = (d @ weights[2].T) * (h > 0)
            for k, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                g = g + DECAY * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= 3e-3 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return weights


def fit(sample: np.ndarray, parts: int = PARTS, seed: int = 0) -> Router:
    """A router from a sample of vectors; too few of them make one part of everything."""
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    # Copies are one node: a vector that many rows share would make a clique of its own.
    nodes = np.unique(sample, axis=0)
    if len(nodes) < 4 * parts:
        all_in_one = Classifier(1.0, [np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
        return Router(all_in_one, all_in_one)
    graph = nearest(nodes, min(GRAPH_NEIGHBOURS, len(nodes) - 1))
    of = balanced_parts(graph, parts, rng)
    scale = float(np.linalg.norm(nodes, axis=1).mean())
    own = Classifier(scale, train(nodes / scale, np.eye(parts)[of], rng))
    # A row lies where the classifier puts it; queries are taught from that.
    placed = own.probabilities(nodes).argmax(axis=1)
    near = np.zeros((len(nodes), parts))
    np.add.at(near, (np.repeat(np.arange(len(nodes)), graph.shape[1]), placed[graph.ravel()]), 1 / graph.shape[1])
    return Router(own, Classifier(scale, train(nodes / scale, near, rng)))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _placed(batches: Iterator[pa.RecordBatch], router: Router) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            parts = router.part(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], names=["part", *batch.schema.names])


def _routed(batches: Iterator[pa.RecordBatch], router: Router, mass: float, rows: dict[int, int], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            routes = router.routes(_matrix(batch.column("vector")), mass, rows, least)
            copies = pa.array(np.repeat(np.arange(len(routes)), [len(r) for r in routes]))
            taken = batch.take(copies)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(routes), pa.int32()), *taken.columns], names=["part", *batch.schema.names])


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the order of the components.

    So equal vectors have equal scores wherever they stand.
    """
    out = np.zeros((len(queries), len(rows)))
    columns = np.ascontiguousarray(rows.T)
    for d in range(rows.shape[1]):
        out += queries[:, d : d + 1] * columns[d]
    return out


def _best(group: pd.DataFrame, top: int) -> pd.DataFrame:
    """The best rows of one block for each of its queries."""
    base, queries = group[~group["is_query"]], group[group["is_query"]]
    query_ids, near, found = [], [], []
    if len(base) and len(queries):
        base, queries = base.drop_duplicates("vec_id").sort_values("vec_id"), queries.drop_duplicates("vec_id")
        ids, rows = base["vec_id"].to_numpy(), np.stack(base["vector"].to_numpy()).astype(np.float64)
        asked = queries["vec_id"].to_numpy()
        vectors = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        for i in range(0, len(asked), 64):
            table = scores(vectors[i : i + 64], rows)
            table[asked[i : i + 64, None] == ids[None, :]] = -np.inf
            for query_id, line in zip(asked[i : i + 64], table):
                least = np.partition(line, -top)[-top] if len(line) > top else -np.inf
                at = np.flatnonzero((line >= least) & (line > -np.inf))
                at = at[np.argsort(-line[at], kind="stable")[:top]]
                query_ids.append(np.full(len(at), query_id))
                near.append(ids[at])
                found.append(line[at])
    if not query_ids:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame({"query_id": np.concatenate(query_ids), "vec_id": np.concatenate(near), "score": np.concatenate(found)})


def valid(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that can be compared.

    Left out: null ids, null and empty vectors, those with null or non-finite components,
    zero ones, and those of another length than most vectors have.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("vector") == (lengths["length"] if lengths else 0))


def build(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, parts: int = PARTS) -> Router:
    """The router, from the `sample_rows` rows whose ids hash lowest."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()
    return fit(_matrix(sample.column("vector").combine_chunks()), parts) if sample.num_rows else fit(np.zeros((0, 1)), parts)


def search(rows: DataFrame, queries: DataFrame, router: Router, top: int = TOP, mass: float = MASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows of largest inner product found.

    Equal scores rank by id, a query never meets rows of its own id, and of rows with one
    id and part one counts. Parts are cut into blocks by the number of their rows and
    queries, so a vector that many rows share makes many blocks and no large one; a task
    compares one block of rows with one of queries.
    """
    kinds = rows.schema["vector"].dataType.simpleString()
    schema = f"part int, vec_id long, vector {kinds}"
    placed = rows.mapInArrow(partial(_placed, router=router), schema)
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count_distinct("vec_id").alias("ids")).collect()
    held = {r["part"]: r["ids"] for r in blocks}
    routed = queries.mapInArrow(partial(_routed, router=router, mass=mass, rows=held, least=top + 1), schema)
    asked = {r["part"]: r["asked"] for r in routed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("asked")).collect()}
    plan = {r["part"]: (r["blocks"], asked[r["part"]]) for r in blocks if r["part"] in asked}
    if not plan:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = lambda i: F.element_at(F.create_map(*[F.lit(x) for p, n in plan.items() for x in (p, n[i])]), F.col("part"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    known = F.col("part").isin(list(plan))
    base = placed.where(known).select("part", own(count(0)).alias("block"), all_of(count(1)).alias("ask"), "vec_id", "vector", F.lit(False).alias("is_query"))
    ask = routed.where(known).select("part", all_of(count(0)).alias("block"), own(count(1)).alias("ask"), "vec_id", "vector", F.lit(True).alias("is_query"))
    found = base.unionAll(ask).groupBy("part", "block", "ask").applyInPandas(partial(_best, top=top), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
