"""Ranking, budgets and proximity, written so that one hot group is not one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 32


def first_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first n rows of each group by `order`, exact for any group size.

    A salted pass keeps n rows of each slice of a group, so the last pass sees at most
    n * SALTS rows of one group however large the group is.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS))
    local = W.partitionBy(*keys, "_salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
        .drop("_salt")
    )
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def running_total(
    df: DataFrame, key: str, order: str, amount: str, out: str, block: int = 1 << 20
) -> DataFrame:
    """Sum of `amount` over the rows before each row of its group, by a numeric order.

    The order is cut into blocks; block totals are summed first, so a hot group is
    spread over its blocks and only the small totals meet in one window. Rows of equal
    order value share their total.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(key, "_block").agg(F.sum(amount).alias("_sum"))
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        key, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy(key, "_block").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    return (
        blocked.join(base, [key, "_block"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_block", "_base")
    )


def within_budget(df: DataFrame, key: str, order: str, amount: str, budget: int) -> DataFrame:
    """Rows taken while the total taken before them is under the budget."""
    return running_total(df, key, order, amount, "_taken").filter(F.col("_taken") < budget).drop("_taken")


def proximity(
    evidence: DataFrame, keys: list[str], position: str, span: int, needed: int
) -> DataFrame:
    """Groups with at least `needed` rows whose positions lie within `span`.

    Rows are counted per position first. A window [p, p + span] touches two buckets of
    width span + 1, so each count goes to its own and the previous bucket and the
    windows run per bucket: a group holds at most 2 * (span + 1) positions.
    """
    width = span + 1
    counted = evidence.filter(F.col(position).isNotNull()).groupBy(*keys, position).agg(F.count("*").alias("_n"))
    own = F.floor(F.col(position) / width)
    spread = counted.withColumn("_bucket", F.explode(F.array(own, own - 1)))
    reach = W.partitionBy(*keys, "_bucket").orderBy(position).rangeBetween(0, span)
    hit = spread.withColumn("_near", F.sum("_n").over(reach)).filter(
        (F.floor(F.col(position) / width) == F.col("_bucket")) & (F.col("_near") >= needed)
    )
    return hit.groupBy(*keys).agg(F.max("_near").alias("near_count"))


def near_pairs(evidence: DataFrame, keys: list[str], position: str, span: int) -> DataFrame:
    """Groups with at least two rows whose positions, whole numbers, lie within `span`.

    The groups are those of `proximity` with two needed, without the count. Two rows of one
    bucket of width span + 1 are always near enough; where each bucket has one row, a bucket
    is compared with the next. So rows are combined by bucket before they are shuffled.
    """
    located = evidence.filter(F.col(position).isNotNull())
    bucket = F.floor(F.col(position) / (span + 1)).alias("_bucket")
    buckets = located.groupBy(*keys, bucket).agg(F.count("*").alias("_n"), F.min(position).alias("_low"), F.max(position).alias("_high"))
    following = F.lead("_low").over(W.partitionBy(*keys).orderBy("_bucket"))
    near = buckets.withColumn("_next", following).filter((F.col("_n") > 1) | (F.col("_next") - F.col("_high") <= span))
    return near.select(*keys).distinct()


def unique_in(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows whose key occurs once, found by counting instead of a window over the key."""
    agg = [F.count("*").alias("_n")] + [F.min(c).alias(c) for c in keep if c != key]
    return df.groupBy(key).agg(*agg).filter(F.col("_n") == 1).drop("_n")
