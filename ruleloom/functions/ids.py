"""Column expressions for rule ids, directories and criticality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom import constants as K


def rule_directory(rule_id: Column) -> Column:
    """`a/b::c` gives `a/b`; an id without `::` drops its last segment."""
    return F.when(rule_id.contains("::"), F.substring_index(rule_id, "::", 1)).otherwise(
        F.regexp_replace(rule_id, "/[^/]*$", "")
    )


def directory_at_depth(rule_id: Column, depth: int) -> Column:
    return F.substring_index(F.substring_index(rule_id, "::", 1), "/", depth)


def local_name(rule_id: Column) -> Column:
    at = F.locate("::", rule_id)
    return F.when(at > 0, F.substr(rule_id, at + 2)).otherwise(rule_id)


def rule_tier(rule_id: Column) -> Column:
    return F.substring_index(F.substring_index(rule_id, "::", 1), "/", 1)


def parent_directory(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "/+$", "")
    cut = F.regexp_replace(trimmed, "[^/]*$", "")
    return F.when(cut != "", cut)


def crit_name(crit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in K.CRITICALITIES]), crit.cast("int") + 2)


def parse_crit(name: Column) -> Column:
    """Level number of a name; null where the name is none of the allowed ones."""
    low = F.lower(name)
    return (
        F.when(low == "inert", 0)
        .when(low == "notable", 1)
        .when(low == "suspicious", 2)
        .when(low.isin("hostile", "malicious"), 3)
    )


def downgraded(crit: Column) -> Column:
    return F.greatest(crit - 1, F.lit(0))


def layer_path(parent: Column, chain: Column) -> Column:
    return F.concat(parent, F.lit("##"), F.array_join(chain, "+"))


def member_path(parent: Column, member: Column) -> Column:
    return F.concat(parent, F.lit("!!"), member)
