"""Composite rule queries: clauses, levels, proximity, downgrades and derived rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.session import local_table
from ruleloom.operators import composites as C
from ruleloom.operators import matching, predicates as P, windows
from ruleloom.plans.registry import query
from ruleloom.plans.rules import (
    BY_ID, DIRECTORIES, base_findings, composite_conds, composite_rules, order_files, sql_ref,
)


def evaluated(spark, sf_dir, only=None):
    found = base_findings(spark, sf_dir)
    return C.evaluate_composites(
        order_files(spark, sf_dir), found, found, composite_rules(spark, only), composite_conds(spark, only)
    )


def one_clause(spark, sf_dir, rule_id):
    """Clause counts of one rule over the atomic findings."""
    found = base_findings(spark, sf_dir).select("file_id", "rule_id").distinct()
    conds = composite_conds(spark, (rule_id,))
    resolved = matching.resolve_references(conds, found.select("rule_id").distinct())
    hits = C.clause_hits(found, resolved)
    counts = C.matched_refs(hits, C.clause_counts(hits))
    sized = C.clause_sizes(composite_rules(spark, (rule_id,)), conds).withColumnRenamed("rule_id", "comp")
    return counts.join(F.broadcast(sized), "comp")


UPLOAD, ANY_OF, TWO_OF = "objectives/exfil/http::upload", "objectives/exfil/http::any-of", "objectives/exfil/http::two-of"
GUARDED, QUIET = "objectives/impact/b::guarded", "objectives/clean/x::quiet"


@query("agg1_composite_all", """
SELECT file_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS trait_refs FROM found0
WHERE file_id IN (SELECT file_id FROM fired1 WHERE rule_id = 'objectives/exfil/http::upload')
  AND (starts_with(rule_id, 'micro-behaviors/net/http') OR starts_with(rule_id, 'micro-behaviors/fs/write')) GROUP BY 1""", "fired1")
def composite_all(spark, sf_dir):
    met = one_clause(spark, sf_dir, UPLOAD).filter(C.all_met())
    return met.select("file_id", F.array_join("trait_refs", ",").alias("trait_refs"))


@query("agg2_composite_any", "SELECT file_id FROM fired1 WHERE rule_id = 'objectives/exfil/http::any-of'", "fired1")
def composite_any(spark, sf_dir):
    return one_clause(spark, sf_dir, ANY_OF).filter(F.col("n_any") >= 1).select("file_id")


@query("agg3_composite_needs", f"""
SELECT file_id, CAST({' + '.join(f"max(({sql_ref(r)})::INT)" for r in BY_ID[TWO_OF]['any'])} AS INTEGER) AS n_any FROM found0
GROUP BY 1 HAVING n_any >= 2""", "found0")
def composite_needs(spark, sf_dir):
    return one_clause(spark, sf_dir, TWO_OF).filter(C.any_met()).select("file_id", F.col("n_any").cast("int").alias("n_any"))


@query("agg4_composite_none", """
SELECT file_id, rule_id, 'exclusion' AS method FROM fired4""", "fired4")
def composite_none(spark, sf_dir):
    found = evaluated(spark, sf_dir, (GUARDED, QUIET))
    return found.select("file_id", "rule_id", F.lit("exclusion").alias("method"))


@query("agg5_composite_rule", """
SELECT file_id, conf FROM composite_findings WHERE rule_id IN ('objectives/impact/a::combo', 'objectives/impact/a::near-bytes')""",
       "composite_findings")
def composite_rule(spark, sf_dir):
    names = ("objectives/impact/a::combo", "objectives/impact/a::near-bytes")
    return evaluated(spark, sf_dir, names).select("file_id", "conf")


@query("agg6_composite_levels", "SELECT file_id, rule_id, crit, conf FROM composite_findings", "composite_findings")
def composite_levels(spark, sf_dir):
    return evaluated(spark, sf_dir)


@query("agg7_downgrade", """
SELECT rule_id, crit, count(*) AS n FROM composite_findings
WHERE rule_id IN ('well-known/x/y::chain', 'well-known/x/y::second', 'well-known/x/z::gated') GROUP BY ALL""", "composite_findings")
def downgrade(spark, sf_dir):
    names = ("well-known/x/y::chain", "well-known/x/y::second", "well-known/x/z::gated")
    found = evaluated(spark, sf_dir).filter(F.col("rule_id").isin(*names))
    return found.groupBy("rule_id", "crit").agg(F.count("*").alias("n"))


REFS = ("micro-behaviors/net/http::r1", "r25", "micro-behaviors/fs", "objectives/discovery/host", "host", "http::r3", "r9")


@query("prd18_trait_reference", " UNION ALL ".join(
    f"SELECT file_id, '{r}' AS ref_id, count(*) AS hits FROM base_findings WHERE {sql_ref(r)} GROUP BY 1" for r in REFS), "base_findings")
def trait_reference(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    refs = local_table(spark, [(r,) for r in REFS], "ref_id string")
    resolved = matching.resolve_references(refs, found.select("rule_id").distinct())
    hits = found.join(resolved, found.rule_id == resolved.target_id)
    return hits.groupBy("file_id", "ref_id").agg(F.count("*").alias("hits"))


@query("join6_reference_resolution", """
SELECT DISTINCT a.rule_id AS ref_id, b.rule_id AS target_id FROM (
  SELECT DISTINCT CASE WHEN line_no % 3 = 0 THEN rule_id WHEN line_no % 3 = 1 THEN split_part(rule_id, '::', 2)
    ELSE split_part(rule_id, '::', 1) END AS rule_id FROM base_findings) a
JOIN (SELECT DISTINCT rule_id FROM base_findings) b
  ON CASE WHEN contains(a.rule_id, '::') THEN a.rule_id = b.rule_id
     WHEN contains(a.rule_id, '/') THEN starts_with(b.rule_id, a.rule_id || '::') OR starts_with(b.rule_id, a.rule_id || '/')
     ELSE ends_with(b.rule_id, '::' || a.rule_id) OR ends_with(b.rule_id, '/' || a.rule_id) END""", "base_findings")
def reference_resolution(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    kind = F.col("line_no") % 3
    ref = (
        F.when(kind == 0, F.col("rule_id"))
        .when(kind == 1, F.substring_index("rule_id", "::", -1))
        .otherwise(F.substring_index("rule_id", "::", 1))
    )
    return matching.resolve_references(found.select(ref.alias("ref_id")).distinct(), found.select("rule_id").distinct())


DERIVED = (
    ("well-known/d::http-thrice", "micro-behaviors/net/http", 2, 3),
    ("well-known/d::r7", "r7", 3, None),
    ("well-known/d::exact", "objectives/discovery/host::r31", 1, 2),
)


@query("prd32_derived_rules", " UNION ALL ".join(
    f"SELECT file_id, '{i}' AS rule_id, {c} AS crit, count(*) AS hits FROM base_findings WHERE {sql_ref(r)} GROUP BY 1 HAVING count(*) >= {n or 1}"
    for i, r, c, n in DERIVED), "base_findings")
def derived_rules(spark, sf_dir):
    found = base_findings(spark, sf_dir).groupBy("file_id", "rule_id").agg(F.count("*").alias("hits"))
    rules = local_table(spark, DERIVED, "rule_id string, ref_id string, crit int, count_min int")
    return C.derived_findings(found, rules)


@query("win1_near_lines", """
SELECT file_id, rule_dir, max(n) AS near_count FROM (
  SELECT file_id, split_part(rule_id, '::', 1) AS rule_dir, count(*) OVER (PARTITION BY file_id, split_part(rule_id, '::', 1)
    ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n FROM base_findings) GROUP BY 1, 2 HAVING max(n) >= 2""", "base_findings")
def near_lines(spark, sf_dir):
    found = base_findings(spark, sf_dir).withColumn("rule_dir", F.substring_index("rule_id", "::", 1))
    return windows.proximity(found, ["file_id", "rule_dir"], "line_no", 15, 2)


@query("win2_near_bytes", """
SELECT file_id, rule_dir, max(n) AS near_count FROM (
  SELECT file_id, split_part(rule_id, '::', 1) AS rule_dir, count(*) OVER (PARTITION BY file_id, split_part(rule_id, '::', 1)
    ORDER BY "offset" RANGE BETWEEN CURRENT ROW AND 40000 FOLLOWING) AS n FROM base_findings) GROUP BY 1, 2 HAVING max(n) >= 2""", "base_findings")
def near_bytes(spark, sf_dir):
    found = base_findings(spark, sf_dir).withColumn("rule_dir", F.substring_index("rule_id", "::", 1))
    return windows.proximity(found, ["file_id", "rule_dir"], "offset", 40000, 2)


@query("win3_proximity_gate", """
SELECT a.file_id FROM (
  SELECT file_id, count(*) OVER (PARTITION BY file_id ORDER BY line_no RANGE BETWEEN CURRENT ROW AND 20 FOLLOWING) AS n FROM base_findings) a
JOIN (SELECT file_id, count(*) OVER (PARTITION BY file_id ORDER BY "offset" RANGE BETWEEN CURRENT ROW AND 50000 FOLLOWING) AS n
      FROM base_findings) b USING (file_id) GROUP BY 1 HAVING max(a.n) >= 3 AND max(b.n) >= 2""", "base_findings")
def proximity_gate(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    lines = windows.proximity(found, ["file_id"], "line_no", 20, 3).select("file_id")
    return lines.join(windows.proximity(found, ["file_id"], "offset", 50000, 2).select("file_id"), "file_id")
