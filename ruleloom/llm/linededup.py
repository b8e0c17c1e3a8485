"""Substring deduplication by hashes of sentences and lines.

A text is cut behind every sentence end and line end; whole lines would miss a passage
that was pasted into the middle of one. Units are normalised and hashed, digests are
grouped over all documents, and a unit that an earlier document holds (or the same
document, further up) is repeated. Runs of repeated units are removed from five words on,
below which sentences are alike by chance; spans refer to the text as it was.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, map_slices, with_columns
from ruleloom.session import cut_lineage

MIN_WORDS = 5
# Anything up to a sentence or line end, with the signs and blanks behind it; then the rest.
UNIT = r"[^.!?\n]*[.!?\n][.!? \t\r\n]*|[^.!?\n]+"
BLANK = r"[ \t\r\n]+"
_UNIT, _BLANK = re.compile(UNIT), re.compile(BLANK)


def units(text: str | None) -> list[tuple[int, int, bytes]]:
    """(length, words, digest) of the units of a text, which follow each other without gaps.

    Units are compared in lower case with single blanks; one without words has no digest.
    """
    out = []
    for unit in _UNIT.findall(text or ""):
        plain = _BLANK.sub(" ", unit.lower()).strip(" ")
        out.append((len(unit), plain.count(" ") + 1, xxhash.xxh3_128_digest(plain.encode("utf-8"))) if plain else (len(unit), 0, b""))
    return out


def repeated_runs(text: str | None, first: dict[int, int], own: int | None, min_words: int) -> list[tuple[int, int, int, int | None]]:
    """(start, end, words, holder) of the runs to remove.

    `first` has the digests (their lower halves) that an earlier document holds, and
    which; `holder` is the document that holds the first unit of the run.
    """
    runs, seen, at = [], set(), 0
    start, words, holder = 0, 0, None
    open_run = False
    for size, n, digest in [*units(text), (0, 0, b"")]:
        key = int.from_bytes(digest[8:], "little", signed=True) if n else None
        again = key is not None and (key in first or key in seen)
        if again and not open_run:
            start, words, holder, open_run = at, 0, first.get(key, own), True
        if again:
            words += n
        elif open_run:
            if words >= min_words:
                runs.append((start, at, words, holder))
            open_run = False
        if key is not None:
            seen.add(key)
        at += size
    return runs


def _digests(_: object, ids: list, keys: list, texts: list) -> dict:
    out: dict[str, list] = {"rank": [], "row_key": [], "high": [], "low": []}
    for rank, key, text in zip(ids, keys, texts):
        found = {d for _, n, d in units(text) if n}
        pairs = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        out["rank"] += [rank] * len(found)
        out["row_key"] += [key] * len(found)
        out["high"] += pairs[:, 0].tolist()
        out["low"] += pairs[:, 1].tolist()
    return out


def _cut(texts: list, ids: list, found: list, min_words: int) -> dict:
    kept, removed = [], []
    for text, own, repeats in zip(texts, ids, found):
        first = {} if repeats is None else {r["low"]: r["first"] for r in repeats}
        runs = repeated_runs(text, first, own, min_words)
        edges = [0, *(e for run in runs for e in run[:2]), len(text or "")]
        kept.append(None if text is None else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        removed.append([dict(zip(("start", "end", "words", "holder"), r)) for r in runs])
    return {"_kept": kept, "_removed": removed}


def dedup_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, removed_col: str = "removed") -> DataFrame:
    """The rows of `df` with repeated passages cut out of the text.

    `removed_col` (which replaces a column of that name) lists the cuts: start, end (code
    points of the original text, end exclusive), words, and the id of the document that
    keeps the passage. Documents rank by id and rows without an id come last; of equal
    units the least rank keeps its first one, and rows of equal rank (repeated rows, rows
    without id) all do. Runs of fewer than `min_words` words stay. Null texts stay null,
    empty and blank ones have no units; other columns pass through; an empty table stays
    empty. A document may end up with an empty text.

    Digests are stored, so that texts are cut and hashed once for counting and joining, and
    a second time for the cuts. A digest that a large part of the documents holds is counted
    before it is shuffled, and is a skewed join key after, which Spark splits while adaptive
    execution is on.
    """
    rank, key, found = (fresh(df, n) for n in ("rank", "row_key", "found"))
    text_hash: Column = F.xxhash64(text_col)
    ranked = df.withColumn(rank, F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1))).withColumn(key, text_hash)
    digests = cut_lineage(map_slices(ranked.select(rank, key, text_col), _digests, "rank long, row_key long, high long, low long", 2))
    first = digests.groupBy("high", "low").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last").drop("last")
    later = digests.join(first, ["high", "low"]).where("rank > first")
    by_row = later.distinct().groupBy("rank", "row_key").agg(F.collect_list(F.struct("low", "first")).alias("repeats"))
    by_row = by_row.select(F.col("rank").alias(rank), F.col("row_key").alias(key), F.col("repeats").alias(found))
    own = fresh(df, "own")
    joined = ranked.join(by_row, [rank, key], "left").withColumn(own, F.col(id_col).cast("bigint"))
    schema = "_kept string, _removed array<struct<start:long,end:long,words:long,holder:long>>"
    named = joined.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(joined.columns)])
    place = {c: f"_{i}" for i, c in enumerate(joined.columns)}
    done = with_columns(named, partial(_cut, min_words=min_words), schema, [place[c] for c in (text_col, own, found)], place[text_col])
    columns = [F.col("_kept" if c == text_col else place[c]).alias(c) for c in df.columns if c != removed_col or c == text_col]
    return done.select(*columns, F.col("_removed").alias(removed_col))


# Five words are the least that is cut, as for shingles.
SPANS_SQL = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '{UNIT}') AS units FROM documents),
rows_ AS (SELECT doc_id, unnest(units) AS unit, generate_subscripts(units, 1) AS k FROM cut),
placed AS (
  SELECT doc_id, k, trim(regexp_replace(lower(unit), '{BLANK}', ' ', 'g'), ' ') AS plain,
         sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS stop, length(unit) AS size
  FROM rows_),
worded AS (
  SELECT *, CASE WHEN plain = '' THEN 0 ELSE length(plain) - length(replace(plain, ' ', '')) + 1 END AS words,
         min(doc_id) OVER (PARTITION BY plain) AS first_doc, min(k) OVER (PARTITION BY doc_id, plain) AS first_k
  FROM placed),
again AS (SELECT *, words > 0 AND (doc_id > first_doc OR k > first_k) AS rep FROM worded),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM again WHERE rep)
SELECT doc_id, CAST(min(stop - size) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end",
       CAST(sum(words) AS BIGINT) AS words, arg_min(first_doc, k) AS kept_doc_id
FROM runs GROUP BY doc_id, run HAVING sum(words) >= 5
"""
