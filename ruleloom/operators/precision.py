"""Rule precision: how much a rule asks for, and the criticality that allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.operators.graph import circle_edges
from ruleloom.session import cut_lineage

UNIT = K.PARAM_UNIT
FOLDING = ("string", "raw", "encoded", "basename", "kv")


def length_score(value: Column, extra: int = 0) -> Column:
    """One unit per five characters or part of it; nothing for null or empty."""
    n = F.char_length(value) + extra
    return F.coalesce(F.when(F.char_length(value) > 0, F.ceil(n / 5.0) * UNIT), F.lit(0.0))


def list_score(names: Column) -> Column:
    """Length scores of type or platform names; `all` asks for nothing."""
    kept = F.filter(names, lambda n: n != "all")
    return T.array_sum(F.transform(kept, lambda n: length_score(n)))


def condition_score() -> Column:
    """Score of one condition; ignoring case is worth a quarter."""
    c = F.col
    searched = (
        length_score(c("exact"))
        + length_score(c("substr"))
        + length_score(F.replace(c("regex"), F.lit("\\"), F.lit("")))
        + length_score(c("word"), 2)
    )
    folded = F.when(c("case_insensitive") & c("ctype").isin(*FOLDING), searched * K.CASE_INSENSITIVE_FACTOR).otherwise(searched)
    return (
        F.when(c("ctype") == "trait", length_score(c("ref_id")))
        .when(c("ctype") == "metrics", length_score(c("metric_field")))
        .otherwise(folded)
    )


def presence(*columns: str) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.when(F.col(c).isNotNull(), UNIT).otherwise(0.0)
    return out


def atomic_precision(rules: DataFrame) -> DataFrame:
    """(rule_id, precision) of atomic rules."""
    extras = presence("size_min", "size_max", "n_not", "n_unless") + F.when(F.col("has_downgrade"), UNIT).otherwise(0.0)
    total = F.lit(K.BASE_PRECISION) + extras + list_score(F.col("for_types")) + list_score(F.col("platforms")) + condition_score()
    return rules.select("rule_id", total.alias("precision"))


def sum_of_weakest(values: Column, n: Column) -> Column:
    """Sum of the n smallest values of an array."""
    return T.array_sum(F.slice(F.array_sort(values), F.lit(1), n))


SUMS = ("_all", "_any", "_none", "_unless")


def _sums() -> list[Column]:
    """What the values `v` of some conditions add to the clauses of their rule."""
    of = lambda clause: F.when(F.col("clause") == clause, F.col("v"))
    return [
        F.sum(of("all")).alias("_all"),
        F.collect_list(of("any")).alias("_any"),
        F.sum(of("none")).alias("_none"),
        F.min(of("unless")).alias("_unless"),
    ]


def _joined(more: str) -> list[Column]:
    """The sums of a rule together with those of the columns prefixed by `more`."""
    c = F.col
    empty = F.array().cast("array<double>")
    added = lambda name: F.when(c(name).isNull(), c(more + name)).otherwise(c(name) + F.coalesce(c(more + name), F.lit(0.0)))
    return [
        added("_all").alias("_all"),
        F.concat(F.coalesce("_any", empty), F.coalesce(more + "_any", empty)).alias("_any"),
        added("_none").alias("_none"),
        F.least("_unless", more + "_unless").alias("_unless"),
    ]


def _total() -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        F.col("types")
        + zero(F.col("_all"))
        + zero(sum_of_weakest(F.col("_any"), F.greatest(F.coalesce("needs", F.lit(1)), F.lit(1))))
        + zero(F.col("_none") + UNIT)
        + zero(F.col("_unless") + UNIT)
    )


def _with_values(open_rules: DataFrame, values: DataFrame) -> DataFrame:
    """Open rules after some of their references (rule_id, clause, v) got a value."""
    more = values.groupBy("rule_id").agg(F.count("*").alias("more_n"), *[s.alias(f"more{n}") for s, n in zip(_sums(), SUMS)])
    left = (F.col("n_open") - F.coalesce("more_n", F.lit(0))).alias("n_open")
    return open_rules.join(more, "rule_id", "left").select("rule_id", "needs", "types", left, *_joined("more"))


def composite_precision(rules: DataFrame, conds: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id, precision) of composites, nested to any depth.

    `known` has the precision of atomic rules; a reference to neither counts as a bare
    rule. What conditions on atomic rules add is summed once. Then each round hands the
    rules that were finished last to those that refer to them, over the references between
    composites alone, until no rule waits for one. When only circles and what is behind
    them are left, the references inside circles count as bare rules; a rule that refers
    to a circle from outside gets the value of the member it names.

    The clause lists of a rule are short, so they may be collected.
    """
    base = F.lit(K.BASE_PRECISION)
    names = rules.select(F.col("rule_id").alias("ref_id"), F.lit(True).alias("composite")).distinct()
    target = known.select(F.col("rule_id").alias("ref_id"), "precision")
    placed = conds.select("rule_id", "clause", "ref_id").join(names, "ref_id", "left").join(target, "ref_id", "left")
    value = F.when(F.col("ref_id").isNull(), F.lit(0.0)).when(F.col("composite"), F.lit(None)).otherwise(F.coalesce("precision", base))
    # One row a rule: its sums, its heads (a rule may stand in the catalog twice) and its references
    # to composites, so conditions are read and joined once.
    head = F.struct("needs", list_score(F.col("for_types")).alias("types"))
    heads = rules.select("rule_id", head.alias("head"))
    rows = placed.where("rule_id is not null").select("rule_id", "clause", "ref_id", "composite", value.alias("v")).unionByName(heads, allowMissingColumns=True)
    open_refs = F.collect_list(F.when(F.col("composite"), F.struct("clause", "ref_id"))).alias("refs")
    sums = cut_lineage(rows.groupBy("rule_id").agg(F.count_if("composite").alias("n_open"), *_sums(), F.collect_list("head").alias("heads"), open_refs))
    state = sums.select("rule_id", F.inline("heads"), "n_open", *SUMS)
    edges = sums.where("n_open > 0").select("rule_id", F.inline("refs"))
    finished = state.where("n_open = 0").select("rule_id", _total().alias("precision"))
    done, state = [finished], state.where("n_open > 0")
    while not state.isEmpty():
        if done[-1].isEmpty():
            waiting = edges.join(state.select("rule_id"), "rule_id", "left_semi").join(state.select(F.col("rule_id").alias("ref_id")), "ref_id", "left_semi")
            inside = cut_lineage(circle_edges(waiting.select("rule_id", "ref_id"), "rule_id", "ref_id"))
            values = waiting.join(inside, ["rule_id", "ref_id"], "left_semi").select("rule_id", "clause", base.alias("v"))
            edges = cut_lineage(edges.join(inside, ["rule_id", "ref_id"], "left_anti"))
        else:
            values = edges.join(done[-1].select(F.col("rule_id").alias("ref_id"), F.col("precision").alias("v")), "ref_id").select("rule_id", "clause", "v")
        state = cut_lineage(_with_values(state, values))
        done.append(state.where("n_open = 0").select("rule_id", _total().alias("precision")))
        state = state.where("n_open > 0")
    return reduce(DataFrame.unionByName, done)


def corrected(rules: DataFrame) -> DataFrame:
    """Adds `corrected`: hostile and suspicious rules of too little precision lose a level."""
    p, crit = F.col("precision"), F.col("crit")
    lowered = (
        F.when((crit == K.HOSTILE) & (p < K.HOSTILE_MIN_PRECISION), K.SUSPICIOUS)
        .when((crit == K.SUSPICIOUS) & (p < K.SUSPICIOUS_MIN_PRECISION), K.NOTABLE)
        .otherwise(crit)
    )
    return rules.withColumn("corrected", lowered)
