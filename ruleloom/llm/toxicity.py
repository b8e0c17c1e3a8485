"""Toxicity grades by cumulative-link ordinal regression on the words of a text.

One weight for each word is shared by all grades; ordered thresholds cut the sum of the
weights into grades: P(grade > k) = 1 / (1 + exp(threshold_k - sum)). The expected grade
is the severity. Labels say toxic or not; toxic documents are graded by how many marker
words they hold, which are learned from the labels too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm.common import fresh, hand_back, kept_state, slices, with_columns
from ruleloom.llm.hashing import span_hashes

SAMPLE_ROWS = 10_000
MIN_DOCUMENTS = 4
MARKER_SHARE = 0.9
# Markers from which a toxic document has the second, third ... grade.
GRADE_STEPS = (3, 6)
LEAST_SIGNAL = 4.0
PENALTY = 1e-4
ITERATIONS = 300
TOXIC_FROM = 0.5

LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased, and the number of the text each one is in.

    A word is a run of signs other than ASCII blanks and punctuation.
    """
    data = [b"" if t is None else t.lower().encode("utf-8") for t in texts]
    whole = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    edge = np.diff(np.concatenate(([False], LETTER[whole], [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    return span_hashes(whole, starts, ends).view(np.int64), owner


@dataclass
class Ordinal:
    """Sorted word hashes with their weights, and the thresholds between the grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """The sum of the weights of each text's distinct words."""
        hashes, owner = words(texts)
        if not len(self.features):
            return np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        pairs = np.unique(owner[hit] * len(self.features) + at[hit])
        return np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], minlength=len(texts))

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -50, 50)))

    def severity(self, texts: list[str | None]) -> np.ndarray:
        """The expected grade."""
        return self.above(self.sums(texts)).sum(axis=1)

    def grade(self, sums: np.ndarray) -> np.ndarray:
        """The most probable grade."""
        above = self.above(sums)
        edges = np.concatenate((np.ones((len(sums), 1)), above, np.zeros((len(sums), 1))), axis=1)
        return (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)


def _telling(at: np.ndarray, owner: np.ndarray, graded: np.ndarray, size: int) -> np.ndarray:
    """Which words occur in enough documents, and among graded ones clearly more or less often than others."""
    held, bad, share = np.bincount(at, minlength=size), np.bincount(at, graded[owner], minlength=size), graded.mean()
    return (held >= MIN_DOCUMENTS) & (np.abs(bad - share * held) >= LEAST_SIGNAL * np.sqrt(held * share * (1 - share)))


def _steepest(at: np.ndarray, owner: np.ndarray, scale: np.ndarray, n: int) -> float:
    """The largest eigenvalue of the scaled features' second moments, by power iteration."""
    v, size = np.ones(len(scale)), 1.0
    for _ in range(20):
        v = np.bincount(at, np.bincount(owner, (v * scale)[at], minlength=n)[owner], minlength=len(scale)) * scale / n
        size = float(np.linalg.norm(v)) or 1.0
        v = v / size
    return size


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, penalty: float = PENALTY, iterations: int = ITERATIONS) -> Ordinal:
    """Fit weights and thresholds to documents given as arrays of distinct word hashes.

    Proximal gradient steps with momentum on the likelihood, with an L1 penalty that
    keeps words without a clear effect at zero. Without rows, or with one grade only, the
    model has no weights and gives everything the grade it has seen (0 if none).
    """
    top = int(grades.max()) if len(grades) else 0
    if not len(grades) or len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(top, -50.0))
    features, at = np.unique(np.concatenate(rows), return_inverse=True)
    owner, n = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)
    telling = _telling(at, owner, grades > 0, len(features))
    hit = telling[at]
    at, owner, features = (np.cumsum(telling) - 1)[at[hit]], owner[hit], features[telling]
    # Words are scaled so that frequent and rare ones are about equally steep.
    scale = 1 / np.sqrt(np.bincount(at, minlength=len(features)) / n)
    step = 1 / (0.5 * _steepest(at, owner, scale, n) + 1e-9) if len(features) else 0.0
    w, ahead, pace = np.zeros(len(features)), np.zeros(len(features)), 1.0
    share = np.array([np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(top)])
    logits = -np.log(share / (1 - share))
    start, gaps = logits[0], np.log(np.maximum(np.diff(logits), 1e-2))
    i = np.arange(n)
    for _ in range(iterations):
        x = np.bincount(owner, (ahead * scale)[at], minlength=n)
        thresholds = start + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        s = 1 / (1 + np.exp(np.clip(thresholds[None, :] - x[:, None], -50, 50)))  # P(grade > k)
        edges = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        chance = np.maximum(edges[i, grades] - edges[i, grades + 1], 1e-9)
        slope = edges * (1 - edges)
        dx = -(slope[i, grades] - slope[i, grades + 1]) / chance / n
        # Threshold k is the upper end of grade k and the lower end of grade k + 1.
        dt = np.array([((slope[:, k + 1] / chance)[grades == k + 1].sum() - (slope[:, k + 1] / chance)[grades == k].sum()) / n for k in range(top)])
        moved = ahead - step * np.bincount(at, dx[owner], minlength=len(features)) * scale
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty * scale, 0)
        if (ahead - moved) @ (moved - w) > 0:  # the momentum points uphill: start it anew
            pace = 1.0
        next_pace = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, w, pace = moved + (pace - 1) / next_pace * (moved - w), moved, next_pace
        start -= dt.sum()
        gaps = np.clip(gaps - np.cumsum(dt[::-1])[::-1][1:] * np.exp(gaps), -5, 5)
    keep = w != 0
    return Ordinal(features[keep], (w * scale)[keep], start + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def grades_of(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0 for clean documents; toxic ones by how many marker words they hold.

    Marker words occur in enough documents, nearly all of them toxic.
    """
    if not toxic.any():
        return np.zeros(len(rows), np.int64)
    every, which = np.unique(np.concatenate(rows), return_inverse=True)
    flags = np.repeat(toxic, [len(r) for r in rows])
    held, bad = np.bincount(which), np.bincount(which, flags)
    marker = (held >= MIN_DOCUMENTS) & (bad >= MARKER_SHARE * held)
    ends = np.cumsum([len(r) for r in rows])
    total = np.concatenate(([0], np.cumsum(marker[which])))
    markers = total[ends] - total[ends - np.array([len(r) for r in rows])]
    return np.where(toxic, 1 + (markers[:, None] >= np.array(GRADE_STEPS)).sum(axis=1), 0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_state(None)
    for batch in batches:
        for toxic, texts in slices(batch, 1):
            hashes, owner = words(texts)
            rows = [np.unique(hashes[owner == i]).tobytes() for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(rows, pa.binary())], names=["toxic", "words"])
    hand_back()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """A model from at most `sample_rows` labelled documents, those whose ids hash lowest.

    Rows with a null label or id do not count, nor labels without a document; of repeated
    labels each does. Only word hashes of the sample reach the driver.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, words binary").toArrow()
    # Sorted, as the order in which tasks hand rows in must not change the sums. Copies
    # count once, or the words of a copied text would all look like evidence.
    distinct = sorted(set(zip(rows.column("toxic").to_pylist(), rows.column("words").to_pylist())))
    del rows
    table, toxic = [np.frombuffer(b, np.int64) for _, b in distinct], np.array([t for t, _ in distinct], bool)
    return fit_ordinal(table, grades_of(table, toxic) if len(table) else np.zeros(0, np.int64))


def severity(model: Ordinal, text: Column | str) -> Column:
    """struct(severity, grade): the expected and the most probable grade of a text.

    A null or empty text has no words and gets what the thresholds alone say.
    """

    def score(texts: pd.Series) -> pd.DataFrame:
        found, every = [], texts.tolist()
        for i in range(0, len(every), 256):
            found.append(model.sums(every[i : i + 256]))
        sums = np.concatenate(found) if found else np.zeros(0)
        return pd.DataFrame({"severity": model.above(sums).sum(axis=1), "grade": model.grade(sums).astype(np.int32)})

    return F.pandas_udf(score, T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType())]))(text)


def drop_toxic(docs: DataFrame, model: Ordinal, text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """The rows of `docs` whose severity is below `toxic_from`; all columns pass through.

    Null and empty texts have what the thresholds alone say; repeated rows are judged
    alike; very long texts are read whole, a slice of rows at a time; an empty table stays
    empty.
    """
    clean = fresh(docs, "clean")

    def judge(texts: list[str | None]) -> dict:
        return {clean: model.above(model.sums(texts)).sum(axis=1) < toxic_from}

    return with_columns(docs, judge, f"`{clean}` boolean", [text_col], text_col, keep=clean)
