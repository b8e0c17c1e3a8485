"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is sorted in several orders, each beginning with other hash functions.
Documents with a long common prefix in an order are candidates: first every document with
its neighbours in the orders, which ties groups of copies together by few comparisons, then
all documents that share a region (a prefix of the least depth) and are not yet in one
component. The depth adapts to the region: neighbours in a dense region share a prefix far
longer than the least one, and a region with many components is cut up further, by the
rarest shingles of its documents. Every link is confirmed on
the full shingle sets, so only candidates are approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.llm.common import fresh, hand_back, kept_state, map_slices, small, utf8
from ruleloom.llm.components import components
from ruleloom.llm.hashing import mixed, span_hashes, word_spans
from ruleloom.session import cut_lineage

WORDS = 5
PERCENT = 75
HASHES = 128
DEPTH = 4
TAIL = 4
# A pair is compared on full sets if this share of its signatures agrees. The estimate of
# a similarity of 0.75 has a standard deviation of 0.038: the bound lies 5 of them below.
LEAST_AGREEMENT = 0.55
# Components in one region up to which its members are compared directly.
DENSE = 16
PART = 1 << 11

_RNG = np.random.default_rng(20240229)
FOLD = np.uint64(0xD6E8FEB86659FD93)
FACTORS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
def _folded(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = out * FOLD + p
    return mixed(out + np.uint64(len(parts)))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text of fewer words than a shingle has one shingle, all its words; a text without
    words, empty or null, has none.
    """
    data = [utf8(t) for t in texts]
    whole = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    starts, stops = word_spans(whole)
    hashes = span_hashes(whole, starts, stops)
    ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))
    n = len(hashes) - words + 1
    windows = _folded([hashes[i : i + n] for i in range(words)]) if n > 0 else hashes[:0]
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= words:
            out.append(np.unique(windows[a : b - words + 1]))
        elif b > a:
            out.append(_folded([hashes[i : i + 1] for i in range(a, b)]))
        else:
            out.append(hashes[:0])
        a = b
    return out


def signature(shingles: np.ndarray) -> bytes:
    """The least value of each hash function over the set; big-endian, so that bytes sort."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), PART):
        part = shingles[i : i + PART]
        np.minimum(least, ((FACTORS[:, None] * part + SHIFTS[:, None]) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(">u4").tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets share at least this share of their union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sign(_: object, ids: list, texts: list) -> dict:
    sets = shingle_sets(texts)
    return {
        "doc_id": ids,
        "n_shingles": [len(s) for s in sets],
        "content": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
        "signature": [signature(s) if len(s) else None for s in sets],
    }


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, content, signature): digest of the set, and its MinHash values."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(rows, _sign, "doc_id long, n_shingles long, content binary, signature binary", 1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those that share their region, with the row before in that region.

    A partition's first and last row are kept in any case, as their region may go on in
    the next one.
    """
    kept_state(None)
    names = ["region", "content", "before"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=names)

    held = previous = None  # the last row, and the content before it in its region
    first = True
    for batch in batches:
        regions, contents = batch.column("region").to_pylist(), batch.column("content").to_pylist()
        rows = []
        for region, content in zip(regions, contents):
            same = held is not None and held[0] == region
            if held is not None and (same or previous is not None or first):
                rows.append((*held, previous))
            if held is not None:
                first = False
            previous = held[1] if same else None
            held = (region, content)
        yield out(rows)
    if held is not None:
        yield out([(*held, previous)])
    hand_back()


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough to be compared on full sets."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_state(None)
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, HASHES) for c in ("sa", "sb"))
            good = (a == b).mean(axis=1) >= LEAST_AGREEMENT if len(a) else np.zeros(0, bool)
            yield batch.filter(pa.array(good)).select(["a", "b"])
        hand_back()

    own, pairs = classes.select("content", "signature"), small(cut_lineage(pairs))
    left = own.select(F.col("content").alias("a"), F.col("signature").alias("sa"))
    right = own.select(F.col("content").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(keep, "a binary, b binary")


def _confirm(_: object, a: list, b: list, ta: list, tb: list, percent: int) -> dict:
    sets = shingle_sets([*ta, *tb])
    good = [linked(x, y, percent) for x, y in zip(sets[: len(ta)], sets[len(ta) :])]
    return {"a": [x for x, g in zip(a, good) if g], "b": [x for x, g in zip(b, good) if g]}


def _texts(contents: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(content, text) of some classes, stored; each is read from the document that holds it."""
    holders = classes.join(contents, "content", "left_semi").select("content", "holder", F.col("text_hash").alias("held_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("text_hash") == F.col("held_hash"))  # some have no id
    return cut_lineage(docs.join(small(cut_lineage(holders)), same).dropDuplicates(["content"]).select("content", "text"))


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; texts are fetched for these pairs only."""
    pairs = cut_lineage(_agreeing(pairs, classes))
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("content")).unionAll(pairs.select(F.col("b").alias("content"))).distinct()
    texts = _texts(wanted, classes, docs)
    left = texts.select(F.col("content").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("content").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return cut_lineage(map_slices(both, partial(_confirm, percent=percent), "a binary, b binary", 2))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    placed = pairs.join(left, "a", "left").join(right, "b", "left")
    return placed.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _mixed_regions(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of regions that more than one component has a part in, stored.

    `main` is the component with most members there, `parts` the number of components.
    """
    known = members.select("region", "content", "place").join(roots, F.col("content") == F.col("node"), "left")
    placed = known.select("region", "content", "place", F.coalesce("root", "content").alias("root"))
    counts = placed.groupBy("region", "root").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("region").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    inside = placed.join(mixed.select("region", F.col("most.root").alias("main"), "parts"), "region")
    return cut_lineage(inside.join(classes.select("content", "n_shingles"), "content"))


def _across(inside: DataFrame, percent: int) -> DataFrame:
    """Pairs of a region in different components that can be similar enough.

    If the region is the first thing that both share, and stands at some place in the order
    of their shingles, they share no more than what comes behind it; that must reach
    the part of both sizes that a link needs.

    The members of the main component are not paired among themselves, all others meet
    the whole region; a region within one component, as groups of copies are, is not here.
    """
    rest = inside.where("root != main").select("region", F.col("content").alias("a"), F.col("root").alias("ra"), (F.col("n_shingles") - F.col("place")).alias("la"), F.col("n_shingles").alias("na"))
    other = inside.select("region", F.col("content").alias("b"), F.col("root").alias("rb"), (F.col("n_shingles") - F.col("place")).alias("lb"), F.col("n_shingles").alias("nb"), (F.col("root") == F.col("main")).alias("is_main"))
    near = ((F.least("la", "lb") + 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent) & (F.col("ra") != F.col("rb")) & (F.col("is_main") | (F.col("a") < F.col("b")))
    return rest.join(other, "region").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shingle_rows(_: object, contents: list, texts: list) -> dict:
    sets = shingle_sets(texts)
    sizes = [len(s) for s in sets]
    return {
        "content": [c for c, n in zip(contents, sizes) for _ in range(n)],
        "n": np.repeat(sizes, sizes),
        "region": np.concatenate(sets).view(np.int64) if sets else [],
    }


def _rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(region, content, place): as many of each set's rarest shingles as similar sets cannot all lack.

    Two sets that share `percent` of their union share one of the least n - ceil(percent n
    / 100) + 1 shingles of each, in any one order of all shingles. With the rarest first, a
    passage that many texts hold brings no pairs. Shingles of one text only come first
    and pair with nothing; they need no rows.
    """
    rows = map_slices(texts, _shingle_rows, "content binary, n long, region long", 1)
    held = rows.groupBy("region").agg(F.count("*").alias("held")).where("held > 1")
    own = Window.partitionBy("content")
    ranked = rows.join(held, "region").select(
        "region",
        "content",
        (F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("held", "region"))).alias("place"),
        (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("least"),
    )
    return ranked.where("place <= least").select("region", "content", "place")


def _unlike_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a region and lie in different components, sizes permitting.

    Where a region has more than DENSE components, which a passage in many texts causes,
    its members are not paired by the region but by their rarest shingles; that loses
    no pair.
    """
    inside = _mixed_regions(members.withColumn("place", F.lit(1)), classes, roots)
    pairs = _across(inside.where(F.col("parts") <= DENSE), percent)
    crowd = cut_lineage(inside.where(F.col("parts") > DENSE).select("content").distinct())
    if crowd.isEmpty():
        return pairs
    rare = _rare_shingles(_texts(crowd, classes, docs), percent)
    return pairs.unionAll(_across(_mixed_regions(rare, classes, roots), percent)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash): one row for every row of `df`.

    A document's set holds its distinct five-word shingles. Documents are linked if the
    intersection of their sets is at least `percent` of the union; component_id is the
    smallest id reachable over links. Texts without words (null, empty, blank) are linked
    with nothing and keep themselves. Rows with equal sets are one class from the start.
    Rows without an id belong to their component; they are kept only if no row of it has
    an id, and such a component has none either. Rows of one id and different texts are separate; those of one id
    and text are alike. Other columns are not read; an empty table stays empty.

    A pair of similarity 0.75 shares none of the 32 regions with a probability of 5e-6.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = map_slices(docs.select("doc_id", "text", "text_hash"), _sign_with_hash, "doc_id long, text_hash long, n_shingles long, content binary, signature binary", 1)
    signed = cut_lineage(signed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("first")
    classes = signed.where("content is not null").groupBy("content").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = cut_lineage(classes.select("content", F.col("first.doc_id").alias("holder"), F.col("first.text_hash").alias("text_hash"), "n_shingles", "signature"))

    step = 4 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(HASHES // DEPTH - 1))).alias("tree")
    twice = F.concat("signature", F.substring("signature", 1, 4 * (DEPTH + TAIL)))
    orders = classes.select("content", twice.alias("twice"), tree).select(
        F.xxhash64("tree", F.substring(F.col("twice"), F.col("tree") * step + 1, F.lit(step))).alias("region"),
        F.substring(F.col("twice"), F.col("tree") * step + step + 1, F.lit(4 * TAIL)).alias("tail"),
        "content",
    )
    ordered = orders.repartitionByRange("region", "tail", "content").sortWithinPartitions("region", "tail", "content")
    members = cut_lineage(ordered.mapInArrow(_neighbours, "region long, content binary, before binary"))

    # Each class with the neighbour it meets in most orders.
    met = members.where("before is not null").groupBy(F.least("content", "before").alias("a"), F.greatest("content", "before").alias("b")).agg(F.count("*").alias("n"))
    met = cut_lineage(met)
    ends = met.select(F.col("a").alias("content"), "a", "b", "n").unionAll(met.select(F.col("b").alias("content"), "a", "b", "n"))
    best = ends.groupBy("content").agg(F.max(F.struct("n", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    links = _links(best, classes, docs, percent)
    roots = components(links, "a", "b")
    # Then the other neighbours that are still apart, which makes one component of most groups.
    beside = _links(_apart(met.select("a", "b"), roots), classes, docs, percent)
    if not beside.isEmpty():
        links = links.unionAll(beside)
        roots = components(links, "a", "b")
    more = _links(_unlike_pairs(members, classes, roots, docs, percent), classes, docs, percent)
    if not more.isEmpty():
        roots = components(links.unionAll(more), "a", "b")

    rooted = classes.select("content", "holder").join(roots.withColumnRenamed("node", "content"), "content", "left").select("content", "holder", F.coalesce("root", "content").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("holder").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("content", "component_id")
    found = signed.select("doc_id", "text_hash", "n_shingles", "content").join(of_class, "content", "left")
    component = F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of `df` that are kept, with all their columns; of repeated rows one stays.

    What goes is told by id and text, so texts are only moved where it is too much to be
    broadcast.
    """
    found = cut_lineage(near_duplicates(df, id_col, text_col, percent).select("doc_id", "text_hash", "kept"))
    ident, key = fresh(df, "ident"), fresh(df, "text_key")
    names = [F.col("doc_id").alias(ident), F.col("text_hash").alias(key)]
    gone = small(cut_lineage(found.where("not kept").select(*names).distinct()))
    twice = cut_lineage(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").select(*names))
    keyed = df.withColumn(key, F.xxhash64(text_col))

    def same(other: DataFrame) -> Column:
        return F.col(id_col).cast("bigint").eqNullSafe(other[ident]) & (keyed[key] == other[key])

    kept = keyed.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        repeats = kept.join(small(twice), same(twice), "left_semi").dropDuplicates([id_col, key])
        kept = kept.join(small(twice), same(twice), "left_anti").unionAll(repeats)
    return kept.drop(key)


def _sign_with_hash(state: object, ids: list, texts: list, hashes: list) -> dict:
    return _sign(state, ids, texts) | {"text_hash": hashes}
