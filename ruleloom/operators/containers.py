"""Containers: guard statistics, member roll-up and the tree of nested files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids
from ruleloom.operators.windows import first_n_per_group, running_total


def guard_findings(
    entries: DataFrame,
    max_entries: int = K.GUARD_MAX_ENTRIES,
    max_total: int = K.GUARD_MAX_TOTAL,
    max_single: int = K.GUARD_MAX_SINGLE,
    max_ratio: int = K.GUARD_MAX_RATIO,
) -> DataFrame:
    """(container_id, reason) for containers that look made to harm an unpacker."""
    name = F.regexp_replace("name", "^/+", "")
    climbs = F.array_contains(F.split(name, "/"), "..")
    escapes = F.col("symlink_target").startswith("/") | F.array_contains(F.split("symlink_target", "/"), "..")
    bomb = (F.col("compressed") > 0) & (F.floor(F.col("uncompressed") / F.col("compressed")) > max_ratio)
    stats = entries.groupBy("container_id").agg(
        F.count("*").alias("n"),
        F.sum("uncompressed").alias("total"),
        F.max("uncompressed").alias("single"),
        F.bool_or(bomb).alias("bomb"),
        F.bool_or(climbs).alias("climbs"),
        F.bool_or(F.coalesce(escapes, F.lit(False))).alias("escapes"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n") > max_entries, "excessive_file_count"),
            F.when(F.col("total") > max_total, "excessive_total_size"),
            F.when(F.col("single") > max_single, "excessive_file_size"),
            F.when(F.col("bomb"), "zip_bomb"),
            F.when(F.col("climbs"), "path_traversal"),
            F.when(F.col("escapes"), "symlink_escape"),
        )
    )
    return stats.select("container_id", F.explode(reasons).alias("reason"))


def first_members(members: DataFrame, limit: int = K.MAX_CONTAINER_MEMBERS) -> DataFrame:
    """The members of each container that are analysed, in path order."""
    return first_n_per_group(members, ["container_id"], [F.col("path"), F.col("file_id")], limit)


def container_findings(members: DataFrame, findings: DataFrame) -> DataFrame:
    """Member findings on their container, once per id, from the first member by path."""
    joined = findings.join(members.select("container_id", "file_id", "path"), "file_id")
    place = F.struct("path", "file_id", "line_no")
    return joined.groupBy("container_id", "rule_id").agg(
        F.max_by("crit", F.struct("crit", place)).alias("crit"),
        F.min_by(F.concat(F.lit("archive:"), "path", F.lit(":"), "line_no"), place).alias("location"),
        F.count_distinct("file_id").alias("members"),
    )


def container_strings(members: DataFrame, strings: DataFrame) -> DataFrame:
    """Strings worth keeping on the container: addresses and encoded text."""
    kept = strings.filter(F.col("string_type").isin("url", "ip", "base64"))
    return kept.join(members.select("container_id", "file_id"), "file_id").select("container_id", "value", "string_type").distinct()


def container_tree(roots: DataFrame, members: DataFrame) -> DataFrame:
    """Files of each container: the root at depth 0 and id 0, members numbered by file id.

    A member path without a container mark gets the root's path in front. Numbers come
    from block totals, so a container of very many members is not one task.
    """
    counted = running_total(members.withColumn("_one", F.lit(1)), "container_id", "file_id", "_one", "_before", 1 << 16)
    marked = F.col("path").contains("!!") | F.col("path").contains("##") | F.col("path").startswith(F.col("root_path"))
    under = counted.join(roots.select("container_id", "root_path"), "container_id").select(
        "container_id",
        (F.col("_before") + 1).alias("id"),
        F.lit(0).alias("parent_id"),
        F.lit(1).alias("depth"),
        F.when(marked, F.col("path")).otherwise(ids.member_path(F.col("root_path"), F.col("path"))).alias("path"),
    )
    top = roots.select(
        "container_id",
        F.lit(0).cast("bigint").alias("id"),
        F.lit(None).cast("int").alias("parent_id"),
        F.lit(0).alias("depth"),
        F.col("root_path").alias("path"),
    )
    return top.unionByName(under)
