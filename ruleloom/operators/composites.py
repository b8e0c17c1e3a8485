"""Composite rules: boolean clauses over findings, round by round, then downgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.operators import rounds
from ruleloom.operators.matching import is_small, resolve_references
from ruleloom.session import cut_lineage

MAX_ROUNDS = 10
GATING = ("all", "any", "none", "unless")


def clause_sizes(rules: DataFrame, conds: DataFrame) -> DataFrame:
    """Rules with the number of conditions in each clause."""
    sizes = conds.groupBy("rule_id").agg(
        *[
            F.countDistinct(F.when(F.col("clause") == c, F.col("idx"))).alias(f"size_{c}")
            for c in (*GATING, "down_all", "down_any", "down_none")
        ]
    )
    return rules.join(sizes, "rule_id", "left").na.fill(0, [c for c in sizes.columns if c != "rule_id"])


def clause_hits(seen: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file_id, comp, clause, idx, target_id) for every condition that holds."""
    r = resolved.select(F.col("rule_id").alias("comp"), "clause", "idx", "target_id")
    r = F.broadcast(r) if is_small(r) else r
    return seen.join(r, seen.rule_id == r.target_id).select("file_id", "comp", "clause", "idx", "target_id")


MASK_BITS = 62


def mask_blocks(highest_idx: int) -> int:
    return highest_idx // MASK_BITS + 1


def _hit(clause: str, blocks: int) -> Column:
    """Distinct conditions of a clause that were met, as set bits of one mask per 62.

    A mask is a plain number, so the counts combine before the shuffle in a hash
    aggregation, which sets of values would not.
    """
    bit = F.expr(f"shiftleft(1L, cast(idx % {MASK_BITS} as int))")
    total = F.lit(0)
    for block in range(blocks):
        mine = (F.col("clause") == clause) & (F.floor(F.col("idx") / MASK_BITS) == block)
        total = total + F.bit_count(F.coalesce(F.bit_or(F.when(mine, bit)), F.lit(0).cast("bigint")))
    return total


def clause_counts(hits: DataFrame, blocks: int = 1) -> DataFrame:
    """Number of distinct conditions met per file, composite and clause."""
    return hits.groupBy("file_id", "comp").agg(*[_hit(c, blocks).alias(f"n_{c}") for c in GATING])


def matched_refs(hits: DataFrame, fired: DataFrame) -> DataFrame:
    """Adds `trait_refs`: the ids that met a positive condition of a fired rule."""
    positive = hits.filter(F.col("clause").isin("all", "any")).select("file_id", "comp", "target_id").distinct()
    refs = positive.groupBy("file_id", "comp").agg(F.array_sort(F.collect_list("target_id")).alias("trait_refs"))
    none = F.array().cast("array<string>")
    return fired.join(refs, ["file_id", "comp"], "left").withColumn("trait_refs", F.coalesce("trait_refs", none))


def all_met() -> Column:
    return F.col("n_all") == F.col("size_all")


def any_met() -> Column:
    """At least `needs` conditions of `any`, one if not given; no clause is met."""
    return (F.col("size_any") == 0) | (F.col("n_any") >= F.coalesce("needs", F.lit(1)))


def evaluate_composites(
    files: DataFrame, findings: DataFrame, evidence: DataFrame, rules: DataFrame, conds: DataFrame,
    with_refs: bool = False, max_rounds: int = MAX_ROUNDS, platforms: tuple[str, ...] = ("all",),
) -> DataFrame:
    """Composite findings (file_id, rule_id, crit, conf), with trait_refs if asked for.

    Rules without a `none` clause run in rounds: each sees what earlier rounds found, so
    rules may refer to each other in a circle, and an `unless` does not yet see a rule
    that fires in the same round. After the first round only rules that refer to
    something new run again, and a file is done when nothing is new or after `max_rounds`
    (a chain deeper than that stays open). Rules with `none` run once on the outcome and
    do not see each other. Downgrades are decided last, on everything found.

    The findings of a file meet in one row and all rounds are expressions over it (see
    `rounds`); a rule with proximity adds a join. The rule graph, whose size is that of the
    catalog, is read on the driver. Rules may have `platforms`; those for none of the given
    ones do not fire.
    """
    conditions = [r.asDict() for r in conds.select("rule_id", "clause", "idx", "ref_id").collect()]
    members, stands_for = _members(findings, rules, conds, with_refs)
    resolved = [{**c, "target_id": target} for c in conditions for target in (*stands_for.get(c["ref_id"], ()), None)]
    catalog = rounds.Catalog(_on_platform(rules.collect(), platforms), resolved, with_refs)
    return rounds.run(files, findings, evidence, members, catalog, max_rounds, with_refs)


def _members(findings: DataFrame, rules: DataFrame, conds: DataFrame, apart: bool) -> tuple[DataFrame, dict[str, list[str]]]:
    """(rule_id, target) of all ids that some condition stands for, and the targets of each reference.

    Atomic ids that the same references stand for are one target, unless they are to be
    kept `apart`: a directory of very many ids, as imports make, is one. So the targets are
    in proportion to the catalog, and only they are read on the driver.
    """
    known = cut_lineage(findings.select("rule_id").unionByName(rules.select("rule_id")).distinct())
    resolved = resolve_references(conds.select("ref_id").where("ref_id is not null").distinct(), known)
    refs = resolved.groupBy("target_id").agg(F.array_sort(F.collect_set("ref_id")).alias("refs"))
    own = rules.select(F.col("rule_id").alias("target_id"), F.lit(True).alias("composite")).distinct()
    shared = F.concat(F.lit("of::"), F.sha2(F.to_json("refs"), 256))
    target = F.col("target_id") if apart else F.coalesce(F.when(F.col("composite"), F.col("target_id")), shared)
    placed = cut_lineage(refs.join(F.broadcast(own), "target_id", "left").select(F.col("target_id").alias("rule_id"), target.alias("target"), "refs"))
    stands_for: dict[str, list[str]] = {}
    for r in placed.select("target", "refs").distinct().collect():
        for ref in r["refs"]:
            stands_for.setdefault(ref, []).append(r["target"])
    return placed.select("rule_id", "target"), stands_for


def _on_platform(rules: list, platforms: tuple[str, ...]) -> list:
    """The rules for any of the platforms; a rule that names none is for all."""

    def fits(r) -> bool:
        mine = r["platforms"] if "platforms" in r else None
        return not mine or "all" in mine or "all" in platforms or bool({*mine} & {*platforms})

    return [r for r in rules if fits(r)]


def derived_findings(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Atomic rules whose condition is another rule: (rule_id, ref_id, crit, count_min).

    They run after the atomic pass; the count is that of the referenced findings.
    """
    known = findings.select("rule_id").distinct()
    resolved = resolve_references(rules.select(F.col("rule_id").alias("derived"), "ref_id"), known)
    hits = findings.join(resolved, findings.rule_id == resolved.target_id).groupBy("file_id", "derived").agg(
        F.sum("hits").alias("hits")
    )
    own = rules.select(F.col("rule_id").alias("derived"), F.col("crit"), "count_min")
    return hits.join(own, "derived").filter(F.col("hits") >= F.coalesce("count_min", F.lit(1))).select(
        "file_id", F.col("derived").alias("rule_id"), "crit", "hits"
    )
