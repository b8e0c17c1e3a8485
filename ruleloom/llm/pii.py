"""Personal data: patterns, and terms that give them away.

Four kinds are found by their form. Around them, corpus statistics tell which words
disclose an entity: the share of the entity's information that a word carries is its
pointwise mutual information with the entity over the entity's information content, both
from counts over all documents. Words above one threshold are replaced by what they are
in general, those above a higher one are removed. The share is shrunk by the number k of
documents behind it, to k / (k + PRIOR): a word of one document is alone with the entity by
chance, so one document can have a word generalised and two can have it removed. A word is
judged anywhere in a document that holds the entity, or in a window around it; texts
without personal data stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ruleloom.llm.common import BROADCAST_ROWS, fresh, hand_back, kept_state, slices, small, with_columns
from ruleloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("general", "remove")
PRIOR = 0.5
GENERALISE, REMOVE = 0.5, 0.8
HELD_TERMS = 300_000
# The share as counted, however few documents are behind it.
UNSHRUNK = {"prior": 0.0}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the four kinds, in forms that do not look at a sign twice: no match may
# begin inside a run that the pattern would have taken whole.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its signs before an @, back to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    if not text:
        return []
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> int:
    """A number for the entity; ways of writing the same one share it."""
    plain = value.lower() if kind in ("email", "ip") else _NOT_DIGIT.sub("", value)
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode()) - (1 << 63)


def free_words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """(start, end) of the words outside of all spans."""
    words = [m.span() for m in _WORD.finditer(text)]
    covered = sorted((a, b) for _, a, b in spans)
    merged: list[list[int]] = []
    for a, b in covered:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    lows = [a for a, _ in merged]

    def free(a: int, b: int) -> bool:
        i = bisect_left(lows, b) - 1
        return i < 0 or merged[i][1] <= a

    return [w for w in words if free(*w)]


def nearby(text: str, spans: list[Span], window: int) -> list[tuple[int, str, int, int]]:
    """(entity, term, start, end) of the words around each span, outside of all spans."""
    words = free_words(text, spans)
    starts = [a for a, _ in words]
    out = set()
    for kind, a, b in spans:
        who, i, j = entity(kind, text[a:b]), bisect_left(starts, a), bisect_left(starts, b)
        out.update((who, text[s:e].lower(), s, e) for s, e in words[max(0, i - window) : j + window])
    return sorted(out)


FACTS = "row long, doc_id long, text_hash long, base array<struct<kind:string,start:long,end:long>>, near array<struct<entity:long,term:string,start:long,end:long>>, entities array<long>, term string, documents long"


def _facts(batches: Iterator[pa.RecordBatch], schema: pa.Schema, window: int | None, held: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows with the documents that each term occurs in."""
    kept_state(None)
    number, counts = TaskContext.get().partitionId() << 33, Counter()

    def flushed() -> pa.RecordBatch:
        columns = {"term": list(counts), "documents": list(counts.values())}
        n = len(counts)
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    for batch in batches:
        for ids, hashes, texts in slices(batch, 2):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text_hash, text in zip(ids, hashes, texts):
                spans = base_spans(text)
                row = (number, doc_id, text_hash, [dict(zip(("kind", "start", "end"), s)) for s in spans], None, None, None, None)
                for values, value in zip(out.values(), row):
                    values.append(value)
                if spans and window is None:
                    out["near"][-1] = [{"entity": None, "term": text[a:b].lower(), "start": a, "end": b} for a, b in free_words(text, spans)]
                    out["entities"][-1] = sorted({entity(k, text[a:b]) for k, a, b in spans})
                elif spans:
                    out["near"][-1] = [dict(zip(("entity", "term", "start", "end"), w)) for w in nearby(text, spans, window)]
                if text:
                    counts.update(set(_WORD.findall(text.lower())))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            if len(counts) > held:
                yield flushed()
    yield flushed()
    hand_back()


def facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None) -> DataFrame:
    """One pass over the texts, stored: spans and the words near them, and term counts.

    Without a window `near` has all words of a document with spans once, and `entities`
    what they stand beside.

    A row with a null `term` is a document, any other one the number of documents of one
    task's texts that hold the term. Each task adds its counts up, so a word that is in
    every text is one row a task.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = to_arrow_schema(T.StructType.fromDDL(FACTS))
    return cut_lineage(rows.mapInArrow(partial(_facts, schema=schema, window=window, held=HELD_TERMS), FACTS))


def meetings(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, entity) of the documents that hold an entity, and (row, entity, term, start, end).

    Counted over whole documents, entities of the same documents have the same counts with
    every term and are one entity here: a list of addresses does not multiply its words.
    """
    docs = found.where("term is null and near is not null")
    words = docs.select("row", F.explode("near").alias("w")).select("row", "w.*")
    holders = docs.where("entities is not null").select("row", F.explode("entities").alias("entity"))
    if holders.isEmpty():
        return words.select("row", "entity").distinct(), words
    marks = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"mark{seed}") for seed in (0, 1)]
    alike = holders.groupBy("entity").agg(*marks, F.count("*").alias("n"))
    alike = small(cut_lineage(alike.select("entity", F.xxhash64("mark0", "mark1", "n").alias("alike"))))
    holders = cut_lineage(holders.join(alike, "entity").select("row", F.col("alike").alias("entity")).distinct())
    return holders, words.drop("entity").join(small(holders), "row").select("row", "entity", "term", "start", "end")


def disclosing(found: DataFrame, met: tuple[DataFrame, DataFrame], prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, share, action): the terms that give an entity away.

    With N documents, d(e) and d(t) that hold entity and term, and d(e, t) where the term
    is near the entity (or anywhere beside it, see `meetings`), share = log(N d(e,t) / (d(e) d(t))) / log(N / d(e)), 1 at most,
    times d(e, t) / (d(e, t) + `prior`). It is compared to nine digits, so that a share at a
    threshold is not a matter of rounding. An entity in every document has nothing to disclose.
    """
    docs = found.where("term is null")
    total = docs.agg(F.count("*").cast("double")).first()[0]
    holders, near = met
    pairs = near.select("row", "entity", "term").distinct().groupBy("entity", "term").agg(F.count("*").alias("together"))
    entities = holders.groupBy("entity").agg(F.count("*").alias("with_entity"))
    terms = found.where("term is not null").groupBy("term").agg(F.sum("documents").alias("with_term"))
    known = cut_lineage(pairs.join(entities, "entity"))
    few = small(known)
    # Beyond a broadcast a word that stands beside many entities is a skewed key, which Spark
    # splits only between tables that lie ready.
    joined = (terms if few is not known else cut_lineage(terms)).join(few, "term")
    most = F.greatest("with_term", "together")
    share = F.log(F.lit(total) * F.col("together") / (F.col("with_entity") * most)) / F.log(F.lit(total) / F.col("with_entity"))
    shrunk = F.round(share * F.col("together") / (F.col("together") + F.lit(float(prior))), 9)
    judged = joined.where(F.col("with_entity") < total).select("entity", "term", shrunk.alias("share"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("general")
    return judged.where(F.col("share") >= generalise).withColumn("action", action)


def term_spans(near: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, more): for each document the spans of terms near the entities they disclose."""
    hits = near.join(terms.select("entity", "term", "action"), ["entity", "term"])
    # A word near two entities counts once, and is removed if it discloses either so far.
    each = hits.groupBy("row", "start", "end").agg(F.max("action").alias("kind"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None, **limits) -> DataFrame:
    """(doc_id, text_hash, base, more): all spans of each row; `more` is null without any.

    Null and empty texts have no spans. Every row is judged by itself, repeated ones
    alike; other columns are not read; an empty table stays empty.
    """
    found = facts(df, id_col, text_col, window)
    met = meetings(found)
    more = term_spans(met[1], disclosing(found, met, **limits))
    docs = found.where("term is null").select("row", "doc_id", "text_hash", "base")
    return docs.join(more, "row", "left").drop("row")


def digest(df: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base, more = text("base"), F.coalesce(text("more"), F.lit(""))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = F.array_join(F.filter(F.array(base, more), lambda s: s != ""), ",")
    return df.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined.alias("spans"))


def sanitised(text: str | None, more: list[Span]) -> str | None:
    """The text with spans replaced; of overlapping ones the first, then the longest, holds."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted([*base_spans(text), *more], key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        a = max(a, at)
        if kind == "general":
            word = text[a:b]
            label = "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"
        else:
            label = "" if kind == "remove" else f"[{kind.upper()}]"
        out += [text[at:a], label]
        at = b
    return "".join([*out, text[at:]])


def _replace(texts: list, more: list) -> dict:
    spans = ([] if m is None else [(s["kind"], s["start"], s["end"]) for s in m] for m in more)
    return {"_clean": [sanitised(t, m) for t, m in zip(texts, spans)]}


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of `df` with personal data and the terms that disclose it replaced.

    Other columns pass through; null texts stay null, empty ones empty; repeated rows get
    the same; very long texts are read whole; an empty table stays empty.
    """
    spans = find_personal_data(df, id_col, text_col, **limits).where("more is not null").dropDuplicates(["doc_id", "text_hash"])
    ident, key, more = (fresh(df, n) for n in ("ident", "text_key", "more"))
    spans = cut_lineage(spans.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(key), F.col("more").alias(more)))
    # A row carries all spans of its document, so spans are counted and not rows.
    few = (spans.agg(F.sum(F.size(more))).first()[0] or 0) <= BROADCAST_ROWS
    spans = F.broadcast(spans) if few else spans
    keyed = df.withColumn(key, F.xxhash64(text_col))
    same = F.col(id_col).cast("bigint").eqNullSafe(spans[ident]) & (keyed[key] == spans[key])
    joined = keyed.join(spans, same, "left").select(*[keyed[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(df.columns)], more)
    text = f"_{df.columns.index(text_col)}"
    done = with_columns(joined, _replace, "_clean string", [text, more], text)
    return done.select(*[F.col("_clean" if c == text_col else f"_{i}").alias(c) for i, c in enumerate(df.columns)])
