"""Two versions of a corpus: aligned files, renames, item changes and metric deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.session import cut_lineage


def align_files(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """(path, status) of every path on either side; equal content is left out."""
    b = baseline.select("path", F.col("sha256").alias("_b"))
    t = target.select("path", F.col("sha256").alias("_t"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("modified")
    both = b.join(t, "path", "full_outer")
    return both.filter(~F.equal_null("_b", "_t")).select("path", status.alias("status"))


def added_removed(baseline: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct items on one side only, as (…keys, change).

    Both sides are stacked with a mark and grouped once: one shuffle, with repeats
    combined before it.
    """
    stacked = baseline.select(*keys, F.lit(1).alias("_side")).unionByName(target.select(*keys, F.lit(2).alias("_side")))
    sides = stacked.groupBy(*keys).agg(F.bit_or("_side").alias("_side")).filter(F.col("_side") != 3)
    return sides.select(*keys, F.when(F.col("_side") == 2, "added").otherwise("removed").alias("change"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def library_base(path: Column) -> Column:
    """Name of a shared library before `.so`; null for other files."""
    name = basename(path)
    shared = name.endswith(".so") | name.contains(".so.")
    return F.when(shared, F.substring_index(name, ".so", 1))


def _sides(removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    return removed.select(F.col("path").alias("baseline_path")), added.select(F.col("path").alias("target_path"))


def same_name_renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Names that occur once among removed and once among added files."""
    r, a = _sides(removed, added)

    def single(df: DataFrame, path: str) -> DataFrame:
        counted = df.groupBy(basename(F.col(path)).alias("name")).agg(F.count("*").alias("_n"), F.min(path).alias(path))
        return counted.filter(F.col("_n") == 1).drop("_n")

    return single(r, "baseline_path").join(single(a, "target_path"), "name").select(
        "baseline_path", "target_path", F.lit(1.0).alias("score")
    )


def _numbered(df: DataFrame, key: str, path: str) -> DataFrame:
    """Rank of each path within its key, from block counts so a hot key is not one task.

    Blocks are ranges of key and path of about equal size, whatever the paths have in
    common; ranks count the paths of earlier blocks and then those within the block.
    """
    from pyspark.sql import Window as W

    blocked = cut_lineage(df.repartitionByRange(key, path).withColumn("_block", F.spark_partition_id()))
    totals = blocked.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(key, "_block").orderBy(path)
    return (
        blocked.join(base, [key, "_block"])
        .withColumn("_rank", F.col("_base") + F.row_number().over(inside))
        .drop("_block", "_base")
    )


def library_renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Shared libraries of one base name, paired first with first in path order."""
    r, a = _sides(removed, added)
    r = r.withColumn("base", library_base(F.col("baseline_path"))).filter(F.col("base").isNotNull())
    a = a.withColumn("base", library_base(F.col("target_path"))).filter(F.col("base").isNotNull())
    pairs = _numbered(r, "base", "baseline_path").join(_numbered(a, "base", "target_path"), ["base", "_rank"])
    return pairs.select("baseline_path", "target_path", F.lit(0.95).alias("score"))


MIN_SIMILARITY = 0.9


def _allowed_edits(name: Column) -> Column:
    """Edits two names may differ by and still be similar: a tenth of the longer one."""
    return F.floor(F.char_length(name) / 10).cast("int")


# Names under this length differ by two edits at most and meet by the forms with as many characters left out.
SPELLED_LENGTH = 30


def _spelled(name: Column) -> Column:
    """A name under SPELLED_LENGTH and its forms with up to as many characters left out as edits are allowed."""
    n = F.char_length(name)
    head, tail = (lambda i: F.substr(name, F.lit(1), i - 1)), (lambda i: F.substr(name, i + 1))
    places = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places(F.lit(1), n), lambda i: F.concat(head(i), tail(i)))
    two = F.transform(places(F.lit(1), n - 1), lambda i: F.transform(places(i + 1, n), lambda j: F.concat(head(i), F.substr(name, i + 1, j - i - 1), tail(j))))
    own, k = F.array(name), _allowed_edits(name)
    return F.array_distinct(F.when(k == 0, own).when(k == 1, F.concat(own, one)).otherwise(F.concat(own, one, F.flatten(two))))


def _spelled_pairs(r: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs of rows in one directory whose names, both under SPELLED_LENGTH, may be similar.

    Names within k edits hold a common subsequence that lacks at most k characters of the
    longer one, so they share a form whatever the names of a directory have in common. Only
    hashes of forms and paths are shuffled; equal hashes add candidates, which are tested.
    The forms are merged: by the size of the names alone they would be sent to every task.
    """

    def keyed(df: DataFrame, path: str, name: str) -> DataFrame:
        # Rows are short and forms many, so the few tasks of a list of names are spread.
        short = df.filter(F.char_length(name).between(1, SPELLED_LENGTH - 1)).repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
        forms = short.select(F.xxhash64(path).alias(f"_{path}"), "dir", F.explode(_spelled(F.col(name))).alias("_form"))
        return forms.select(f"_{path}", F.xxhash64("dir", "_form").alias("_key"))

    near = keyed(r, "baseline_path", "r_name").join(keyed(a, "target_path", "a_name").hint("merge"), "_key").select("_baseline_path", "_target_path").distinct()
    found = near.join(r.withColumn("_baseline_path", F.xxhash64("baseline_path")), "_baseline_path")
    both = found.join(a.withColumn("_target_path", F.xxhash64("target_path")).withColumnRenamed("dir", "_dir"), "_target_path")
    return both.filter(F.col("dir") == F.col("_dir")).select("baseline_path", "r_name", "target_path", "a_name")


def _piece_count(length: Column) -> Column:
    """One more piece than edits allowed to a name and a partner that may be longer."""
    return (F.floor(length / 10) + 2).cast("int")


def _pieces(name: Column, length: Column) -> Column:
    """(piece number, text) of a name cut into pieces."""
    last = _piece_count(length) - 1
    step = F.floor(length / (last + 1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            i.alias("i"),
            F.when(i == last, F.substr(name, i * step + 1)).otherwise(F.substr(name, i * step + 1, step)).alias("piece"),
        ),
    )


def _piece_pairs(r: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs of rows in one directory that share a piece, one of the names at least SPELLED_LENGTH long.

    Names within k edits share at least one of k + 1 pieces, shifted by at most k. Pairs are
    found by an equi-join on directory, length, piece number and piece.
    """
    n_r, n_a = F.char_length("r_name"), F.char_length("a_name")
    # The removed side is cut for each length its partner may have.
    probe = (
        r.withColumn("_len", F.explode(F.sequence(n_r - _allowed_edits(F.col("r_name")) - 1, n_r + _allowed_edits(F.col("r_name")) + 1)))
        .filter((F.col("_len") >= 1) & (F.greatest(n_r, F.col("_len")) >= SPELLED_LENGTH))
        .withColumn("_k", F.floor(F.greatest(n_r, F.col("_len")) / 10).cast("int"))
    )
    last_i = _piece_count(F.col("_len")) - 1
    step = F.floor(F.col("_len") / (last_i + 1)).cast("int")
    shifts = (
        probe.withColumn("_i", F.explode(F.sequence(F.lit(0), last_i)))
        .withColumn("_shift", F.explode(F.sequence(-F.col("_k"), F.col("_k"))))
        .withColumn("_at", F.col("_i") * step + 1 + F.col("_shift"))
        .filter(F.col("_at") >= 1)
    )
    size = F.when(F.col("_i") == last_i, F.col("_len") - F.col("_i") * step).otherwise(step)
    keyed = shifts.withColumn("_piece", F.substr("r_name", F.col("_at"), size.cast("int"))).select(
        "baseline_path", "r_name", "dir", "_len", "_i", "_piece"
    ).distinct()
    cut = a.withColumn("_len", n_a).withColumn("_p", F.explode(_pieces(F.col("a_name"), n_a)))
    cut = cut.select("target_path", "a_name", "dir", "_len", F.col("_p.i").alias("_i"), F.col("_p.piece").alias("_piece"))
    return keyed.join(cut.hint("merge"), ["dir", "_len", "_i", "_piece"]).select("baseline_path", "r_name", "target_path", "a_name")


def similar_names(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs in one directory whose names are at least 0.9 similar.

    Short names meet by forms with characters left out, longer ones by pieces, both by
    equi-joins; the edit distance is tested behind the join, so pairs that fail are never
    written.
    """
    r, a = _sides(removed, added)
    r = r.withColumns({"dir": directory(F.col("baseline_path")), "r_name": basename(F.col("baseline_path"))})
    a = a.withColumns({"dir": directory(F.col("target_path")), "a_name": basename(F.col("target_path"))})
    score = T.normalized_similarity(F.col("r_name"), F.col("a_name"))
    return (
        _spelled_pairs(r, a).unionByName(_piece_pairs(r, a))
        .filter(score >= MIN_SIMILARITY)
        .select("baseline_path", "target_path", F.round(score, 6).alias("score"))
        .distinct()
    )


def _mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best by score, then by path."""
    best_r = pairs.groupBy("baseline_path").agg(F.min(F.struct(-F.col("score"), "target_path")).alias("_r"))
    best_a = pairs.groupBy("target_path").agg(F.min(F.struct(-F.col("score"), "baseline_path")).alias("_a"))
    return (
        pairs.join(best_r, "baseline_path")
        .join(best_a, "target_path")
        .filter((F.col("_r.target_path") == F.col("target_path")) & (F.col("_a.baseline_path") == F.col("baseline_path")))
        .select("baseline_path", "target_path", "score")
    )


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Each file in one pair at most, the best pairs first, until no pair is left.

    Pairs that are each other's best are taken, pairs of their files go, and so on. That
    is the assignment by descending score, then path; every round works on what is left.
    """
    taken, left = None, cut_lineage(pairs)
    while not left.isEmpty():
        best = cut_lineage(_mutual_best(left))
        taken = best if taken is None else taken.unionByName(best)
        left = left.join(best.select("baseline_path"), "baseline_path", "left_anti").join(best.select("target_path"), "target_path", "left_anti")
        left = cut_lineage(left.select("baseline_path", "target_path", "score"))
    return left if taken is None else taken


def _unused(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return df.join(pairs.select(F.col(side).alias("path")), "path", "left_anti")


def renames(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Renames by unique name, then library base, then similar name in one directory.

    Each pass reads what the earlier ones left several times, so the path lists and the
    pairs found are written between the passes.
    """
    removed, added = cut_lineage(removed.select("path")), cut_lineage(added.select("path"))
    first = cut_lineage(same_name_renames(removed, added))
    r, a = _unused(removed, first, "baseline_path"), _unused(added, first, "target_path")
    second = cut_lineage(library_renames(r, a))
    r, a = _unused(r, second, "baseline_path"), _unused(a, second, "target_path")
    third = best_pairs(similar_names(r, a))
    return first.unionByName(second).unionByName(third).orderBy(F.col("score").desc(), "baseline_path")


def full_diff(baseline: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """diff_items(path, kind, key, change) over facts given as kind to (path, key)."""

    def stacked(side: dict[str, DataFrame]) -> DataFrame:
        parts = [df.select("path", F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key")) for kind, df in side.items()]
        return reduce(lambda a, b: a.unionByName(b), parts)

    return added_removed(stacked(baseline), stacked(target), ["path", "kind", "key"])


def diff_counts(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Added and removed items per path and kind, with the corpus total as path null."""
    columns = [
        F.count_if((F.col("kind") == k) & (F.col("change") == c)).alias(f"{k}_{c}") for k in kinds for c in ("added", "removed")
    ]
    return items.rollup("path").agg(*columns)


def is_high_risk(rule_id: Column, prefixes: tuple[str, ...] = K.RISK_PREFIXES) -> Column:
    return T.starts_with_any(rule_id, prefixes)


def finding_changes(baseline: DataFrame, target: DataFrame, prefixes: tuple[str, ...] = K.RISK_PREFIXES) -> DataFrame:
    """Per path: findings added and removed, their difference, and whether risk rose."""
    items = added_removed(baseline, target, ["path", "rule_id"])
    added, high = F.col("change") == "added", is_high_risk(F.col("rule_id"), prefixes)
    per_path = items.groupBy("path").agg(
        F.count_if(added).alias("added"),
        F.count_if(~added).alias("removed"),
        F.count_if(added & high).alias("high_added"),
        F.count_if(~added & high).alias("high_removed"),
    )
    return per_path.select(
        "path",
        "added",
        "removed",
        (F.col("added") - F.col("removed")).alias("capability_delta"),
        ((F.col("high_added") > 0) & (F.col("high_added") > F.col("high_removed"))).alias("risk_increase"),
    )


def metric_deltas(baseline: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """Target minus baseline of each field, for paths on both sides."""
    b = baseline.select("path", *[F.col(f).alias(f"_{f}") for f in fields])
    return b.join(target.select("path", *fields), "path").select(
        "path", *[(F.col(f) - F.col(f"_{f}")).alias(f) for f in fields]
    )
