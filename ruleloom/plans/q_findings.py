"""Scan, finding, graph and container queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids, text as T
from ruleloom.operators import composites, containers, findings as FD, graph, matching, scan, windows
from ruleloom.operators import predicates as P
from ruleloom.operators.extract import classify_strings
from ruleloom.plans.q_composites import evaluated
from ruleloom.plans.q_extract import SQL_IMPORT_NAME, SQL_KIND, payloads
from ruleloom.plans.q_predicates import sql_has_public, token_strings
from ruleloom.plans.registry import query, view
from ruleloom.plans.rules import COMPOSITES, CLAUSES, base_findings, composite_conds, composite_rules, order_files
from ruleloom.plans.tables import entries, files, functions, pick, sql_list, sql_pick, sql_rows, sql_text, symbols
from ruleloom.session import local_table
from ruleloom.sources.tables import read_table

# -- the document scan -------------------------------------------------------------------

# rule, criticality, confidence, kind, matcher, pattern, ignore case, types, sizes, counts, densities
DOC_RULES = (
    ("micro-behaviors/net/address::external-ip", 1, 0.8, "string", "external_ip", None, False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/net/address::mail", 1, 0.7, "string", "regex", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/data/secret::hex-run", 2, 0.6, "string", "regex", "[0-9a-f]{32,}", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/data/secret::token-word", 1, 0.5, "string", "exact", "token", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/data/secret::card-number", 2, 0.9, "string", "regex", "^[0-9]{16}$", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/text/word::the", 0, 0.9, "string", "exact", "THE", True, ["en"], None, None, 20, None, None, None),
    ("micro-behaviors/text/word::und", 0, 0.9, "string", "word", "und", False, ["de", "fr"], 200, None, None, 200, None, None),
    ("micro-behaviors/text/part::tion", 0, 0.3, "string", "substr", "tiontion", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/text/part::mail-host", 1, 0.4, "string", "substr", "@MAIL", True, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/text/part::percent", 0, 0.2, "string", "substr", "%%%", False, ["all"], None, None, 3, None, None, None),
    ("micro-behaviors/legal/license::apache", 1, 1.0, "raw", "substr", "Licensed under the Apache License", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/legal/license::mit", 1, 1.0, "raw", "substr", "MIT License", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/legal/license::creative", 1, 0.9, "raw", "regex", r"CC BY[-A-Z]* [0-9.]+", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/text/noise::marks", 1, 0.5, "raw", "substr", "###", False, ["all"], None, None, None, None, 1.0, None),
    ("micro-behaviors/text/noise::shout", 1, 0.5, "raw", "regex", "[A-Z]{4,}!!", False, ["all"], None, 20000, 2, None, None, None),
    ("micro-behaviors/text/phone::us", 1, 0.7, "raw", "regex", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", False, ["all"], None, None, None, None, None, None),
    ("micro-behaviors/text/word::and-dense", 0, 0.4, "raw", "word", "and", True, ["en", "es"], None, None, None, None, 2.0, 30.0),
)
DOC_COMPOSITES = (
    dict(id="objectives/collection/personal::profile", crit=2, conf=0.8, any=["micro-behaviors/net/address", "micro-behaviors/text/phone", "card-number"], needs=2),
    dict(id="objectives/collection/secret::leak", crit=3, conf=0.9, all=["micro-behaviors/data/secret::hex-run", "token-word"]),
    dict(id="objectives/collection/noise::only", crit=1, conf=0.3, all=["micro-behaviors/text/noise"], none=["micro-behaviors/data/secret"]),
)


def doc_rules(spark):
    return local_table(spark, list(DOC_RULES), scan.RULE_SCHEMA)


def doc_atomic(spark, sf_dir):
    return scan.atomic_findings(files(spark, sf_dir), token_strings(spark, sf_dir), doc_rules(spark))


# A word edge in Unicode terms; the check engine only knows the ASCII one.
WORD_EDGE = r"(^|[^\pL0-9_]){}($|[^\pL0-9_])"


def _sql_rule(r: tuple) -> str:
    rid, crit, conf, ctype, how, pat, ci, types, smin, smax, cmin, cmax, dmin, dmax = r
    flag = "(?i)" if ci else ""
    if ctype == "string":
        test = {
            "exact": lambda: f"lower(value) = {sql_text(pat.lower())}" if ci else f"value = {sql_text(pat)}",
            "substr": lambda: f"contains(lower(value), {sql_text(pat.lower())})" if ci else f"contains(value, {sql_text(pat)})",
            "regex": lambda: f"regexp_matches(value, {sql_text(flag + pat)})",
            "word": lambda: f"regexp_matches(value, {sql_text(flag + WORD_EDGE.format(pat))})",
            "external_ip": lambda: sql_has_public("value"),
        }[how]()
        hits = f"SELECT file_id, count(*) AS hits, min(value) AS sample FROM doc_tokens WHERE {test} GROUP BY 1"
    else:
        if how == "substr":
            n, sample = f"(strlen(text) - strlen(replace(text, {sql_text(pat)}, ''))) // strlen({sql_text(pat)})", pat
        else:
            body = flag + (pat if how == "regex" else rf"\b{pat}\b")
            sample = flag + (pat if how == "regex" else rf"\b\Q{pat}\E\b")
            n = f"len(regexp_extract_all(text, {sql_text(body)}))"
        hits = f"SELECT file_id, CAST({n} AS BIGINT) AS hits, {sql_text(sample)} AS sample FROM files"
    tests = [f"hits >= {cmin or 1}"]
    if types != ["all"]:
        tests.append(f"list_contains({sql_list(types)}, file_type)")
    for bound, op in ((smin, ">="), (smax, "<=")):
        if bound is not None:
            tests.append(f"size_bytes {op} {bound}")
    if cmax is not None:
        tests.append(f"hits <= {cmax}")
    for bound, op in ((dmin, ">="), (dmax, "<=")):
        if bound is not None:
            tests.append(f"hits / (size_bytes / 1024.0) {op} {bound}")
    return (f"SELECT file_id, '{rid}' AS rule_id, {crit} AS crit, CAST({conf} AS DOUBLE) AS conf, hits, sample "
            f"FROM ({hits}) JOIN files USING (file_id) WHERE {' AND '.join(tests)}")


view("doc_atomic", " UNION ALL ".join(_sql_rule(r) for r in DOC_RULES), "files", "doc_tokens")


@query("agg8_atomic_scan", "SELECT file_id, rule_id, crit, conf, hits, sample FROM doc_atomic", "doc_atomic")
def atomic_scan(spark, sf_dir):
    return doc_atomic(spark, sf_dir)


view("doc_composite", """
SELECT file_id, 'objectives/collection/personal::profile' AS rule_id, 2 AS crit, 0.8::DOUBLE AS conf FROM (
  SELECT file_id, max(starts_with(rule_id, 'micro-behaviors/net/address::')::INT) + max(starts_with(rule_id, 'micro-behaviors/text/phone::')::INT)
    + max(ends_with(rule_id, '::card-number')::INT) AS n FROM doc_atomic GROUP BY 1) WHERE n >= 2
UNION ALL SELECT file_id, 'objectives/collection/secret::leak', 3, 0.9 FROM doc_atomic GROUP BY 1
  HAVING bool_or(rule_id = 'micro-behaviors/data/secret::hex-run') AND bool_or(ends_with(rule_id, '::token-word'))
UNION ALL SELECT file_id, 'objectives/collection/noise::only', 1, 0.3 FROM doc_atomic GROUP BY 1
  HAVING bool_or(starts_with(rule_id, 'micro-behaviors/text/noise::')) AND NOT bool_or(starts_with(rule_id, 'micro-behaviors/data/secret::'))""",
     "doc_atomic")
view("doc_findings", """
SELECT file_id, rule_id, crit, conf FROM doc_atomic UNION ALL SELECT * FROM doc_composite""", "doc_atomic", "doc_composite")


def doc_findings(spark, sf_dir):
    """Atomic, then composite findings of the documents."""
    from ruleloom.session import cut_lineage

    doc = files(spark, sf_dir)
    atomic = cut_lineage(doc_atomic(spark, sf_dir))
    none = F.lit(None).cast("bigint")
    rules = local_table(spark, [(c["id"], c["crit"], c["conf"], c.get("needs"), None, None, ["all"], None, None) for c in DOC_COMPOSITES],
                        "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, size_min bigint, size_max bigint")
    conds = local_table(spark, [(c["id"], cl, i, ref) for c in DOC_COMPOSITES for cl in CLAUSES for i, ref in enumerate(c.get(cl, []))],
                        "rule_id string, clause string, idx int, ref_id string")
    evidence = atomic.withColumns({"line_no": none, "offset": none})
    combined = composites.evaluate_composites(doc.drop("text"), atomic, evidence, rules, conds)
    return FD.capped(FD.merge_stages(atomic.select("file_id", "rule_id", "crit", "conf"), combined).drop("stage"))


view("doc_report", """
SELECT file_id, path, CASE WHEN max(crit) > 0 THEN list_extract(['inert', 'notable', 'suspicious', 'hostile'], max(crit) + 1) END AS risk,
  count(*) FILTER (WHERE crit = 3) AS hostile, count(*) FILTER (WHERE crit = 2) AS suspicious,
  count(*) FILTER (WHERE crit = 1) AS notable, coalesce(max(crit), -1) AS max_crit
FROM files LEFT JOIN doc_findings USING (file_id) GROUP BY 1, 2""", "files", "doc_findings")


def doc_report(spark, sf_dir):
    return FD.file_report(files(spark, sf_dir).select("file_id", "path"), doc_findings(spark, sf_dir))


@query("scan_report", "SELECT * FROM doc_report", "doc_report")
def scan_report(spark, sf_dir):
    """Flagship: scan the documents, combine, and report the risk of each."""
    return doc_report(spark, sf_dir)


@query("prd28_fail_on_criticality", "SELECT count(*) > 0 AS failed FROM (SELECT 1 FROM doc_report WHERE max_crit >= 3 LIMIT 1)", "doc_report")
def fail_on_criticality(spark, sf_dir):
    return FD.file_report(files(spark, sf_dir).select("file_id"), doc_findings(spark, sf_dir)).transform(
        lambda r: P.fails_at(r, K.HOSTILE)
    ).agg((F.count("*") > 0).alias("failed"))


# -- merging and ranking -----------------------------------------------------------------


@query("agg9_merge_stages", """
SELECT file_id, rule_id, arg_min(crit, (stage, crit, conf)) AS crit, arg_min(conf, (stage, crit, conf)) AS conf, min(stage) AS stage FROM (
  SELECT file_id, rule_id, crit, conf, 0 AS stage FROM base_findings WHERE seq <= 3
  UNION ALL SELECT file_id, rule_id, 0, 0.95, 1 FROM base_findings WHERE seq BETWEEN 3 AND 5
  UNION ALL SELECT file_id, rule_id, crit, conf, 2 FROM base_findings WHERE seq >= 5) GROUP BY 1, 2""", "base_findings")
def merge_stages(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    keep = ["file_id", "rule_id", "crit", "conf"]
    atomic = found.filter(F.col("seq") <= 3).select(keep)
    imports = found.filter(F.col("seq").between(3, 5)).select("file_id", "rule_id", F.lit(0).alias("crit"), F.lit(0.95).alias("conf"))
    return FD.merge_stages(atomic, imports, found.filter(F.col("seq") >= 5).select(keep))


view("eco_machine", """
SELECT s.* REPLACE (CASE file_type WHEN 'elf' THEN 'elf' WHEN 'pe' THEN 'pe' WHEN 'macho' THEN 'macho' ELSE ecosystem END AS ecosystem)
FROM symbols_eco s WHERE kind = 'import'""", "symbols_eco")


@query("agg10_import_findings", f"""
SELECT file_id, CASE WHEN ecosystem IN ('elf', 'pe', 'macho') OR source = 'ast' THEN 'metadata/internal/imported::'
         ELSE 'metadata/import/' || ecosystem || '::' END || {SQL_IMPORT_NAME.format('symbol')} AS rule_id,
       NULL::BIGINT AS n_symbols, NULL AS preview, 0 AS crit, 0.95::DOUBLE AS conf FROM eco_machine GROUP BY ALL
UNION ALL
SELECT file_id, 'metadata/dylib::' || {SQL_IMPORT_NAME.format('library')}, count(*),
       array_to_string(list_sort(list_distinct(list(symbol)))[1:5], ', '), 0, 0.95
FROM eco_machine WHERE ecosystem IN ('elf', 'pe', 'macho') GROUP BY file_id, library""", "eco_machine")
def import_findings(spark, sf_dir):
    return FD.import_findings(symbols(spark, sf_dir).filter(F.col("kind") == "import"))


@query("agg11_add_once", "SELECT file_id, rule_id, min(line_no) AS line_no FROM base_findings GROUP BY 1, 2", "base_findings")
def add_once(spark, sf_dir):
    return FD.first_per_id(base_findings(spark, sf_dir).select("file_id", "rule_id", "line_no"), ["line_no"])


@query("agg12_highest_criticality", "SELECT file_id, max(crit) AS max_crit FROM base_findings GROUP BY 1", "base_findings")
def highest_criticality(spark, sf_dir):
    return FD.highest_criticality(base_findings(spark, sf_dir))


view("order_report", """
SELECT file_id, file_type, size_bytes, CASE WHEN max(crit) > 0 THEN list_extract(['inert', 'notable', 'suspicious', 'hostile'], max(crit) + 1) END AS risk,
  count(*) FILTER (WHERE crit = 3) AS hostile, count(*) FILTER (WHERE crit = 2) AS suspicious,
  count(*) FILTER (WHERE crit = 1) AS notable, coalesce(max(crit), -1) AS max_crit
FROM order_files LEFT JOIN base_findings USING (file_id) GROUP BY 1, 2, 3""", "order_files", "base_findings")


def order_report(spark, sf_dir):
    return FD.file_report(order_files(spark, sf_dir), base_findings(spark, sf_dir))


@query("agg13_file_risk", "SELECT * FROM order_report", "order_report")
def file_risk(spark, sf_dir):
    return order_report(spark, sf_dir)


@query("agg14_corpus_summary", """
SELECT count(*) AS files, CAST(max(file_id % 4) AS BIGINT) AS max_depth, CAST(sum(hostile) AS BIGINT) AS hostile, CAST(sum(suspicious) AS BIGINT) AS suspicious,
  CAST(sum(notable) AS BIGINT) AS notable, max(max_crit) AS max_crit FROM order_report""", "order_report")
def corpus_summary(spark, sf_dir):
    return FD.corpus_summary(order_report(spark, sf_dir).withColumn("depth", F.col("file_id") % 4))


SOURCES = ("catalog", "binary_analyzer", "catalog", "import_mapper", "pattern")


def sourced(spark, sf_dir):
    return base_findings(spark, sf_dir).withColumn("source", pick(F.col("line_no"), SOURCES))


@query("agg15_directory_rollup", f"""
SELECT file_id, split_part(rule_id, '::', 1) AS directory, arg_min(crit, (-crit, -conf, rule_id)) AS crit,
       arg_min(conf, (-crit, -conf, rule_id)) AS conf, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS trait_refs
FROM base_findings WHERE {sql_pick('line_no', SOURCES)} NOT IN ('binary_analyzer', 'import_mapper') GROUP BY 1, 2
UNION ALL SELECT file_id, rule_id, crit, conf, '' FROM base_findings WHERE {sql_pick('line_no', SOURCES)} IN ('binary_analyzer', 'import_mapper')""",
       "base_findings")
def directory_rollup(spark, sf_dir):
    rolled = FD.rollup_by_directory(sourced(spark, sf_dir))
    return rolled.withColumn("trait_refs", F.array_join("trait_refs", ","))


LOW_VALUE = [c["id"] for c in COMPOSITES if c.get("any") and (len(c["any"]) == 1 or (c.get("needs") or 1) <= 1)]


@query("agg16_low_value_filter", f"""
SELECT file_id, rule_id FROM found4 WHERE NOT list_contains({sql_list(LOW_VALUE)}, rule_id) AND NOT starts_with(rule_id, 'micro')
  AND NOT starts_with(rule_id, 'objectives/discovery')""", "found4")
def low_value_filter(spark, sf_dir):
    found = evaluated(spark, sf_dir).select("file_id", "rule_id")
    return FD.without_low_value(found, composite_rules(spark), composite_conds(spark))


# -- graphs ---------------------------------------------------------------------------------


def part_rules(spark, sf_dir):
    """Composite rules from orders, their references from line items."""
    o = read_table(spark, sf_dir, "orders")
    rules = o.select(
        F.concat(pick(F.col("o_orderkey"), GRAPH_DIRS), F.lit("/s"), F.col("o_custkey") % 9, F.lit("::o"), F.col("o_orderkey")).alias("rule_id"),
        (F.col("o_custkey") % 4).cast("int").alias("crit"),
    )
    li = read_table(spark, sf_dir, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    conds = li.select(
        F.concat(pick(F.col("o_orderkey"), GRAPH_DIRS), F.lit("/s"), F.col("o_custkey") % 9, F.lit("::o"), F.col("o_orderkey")).alias("rule_id"),
        pick(F.col("l_linenumber"), ("all", "any", "none", "unless")).alias("clause"),
        F.concat(pick(F.col("l_partkey"), GRAPH_DIRS), F.lit("/s"), F.col("l_suppkey") % 9, F.lit("::p"), F.col("l_partkey")).alias("ref_id"),
    )
    return rules, conds


GRAPH_DIRS = ("micro-behaviors/net", "micro-behaviors/fs", "objectives/exfil", "objectives/impact", "well-known/x", "Metadata/lib")
view("graph_rules", f"""
SELECT {sql_pick('o_orderkey', GRAPH_DIRS)} || '/s' || (o_custkey % 9) || '::o' || o_orderkey AS rule_id, CAST(o_custkey % 4 AS INTEGER) AS crit FROM orders""")
view("graph_conds", f"""
SELECT {sql_pick('o_orderkey', GRAPH_DIRS)} || '/s' || (o_custkey % 9) || '::o' || o_orderkey AS rule_id,
  {sql_pick('l_linenumber', ('all', 'any', 'none', 'unless'))} AS clause,
  {sql_pick('l_partkey', GRAPH_DIRS)} || '/s' || (l_suppkey % 9) || '::p' || l_partkey AS ref_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
_cut = "array_to_string(string_split(split_part({}, '::', 1), '/')[1:3], '/')"
_ns = "lower(split_part({}, '/', 1)) IN ('objectives', 'micro-behaviors', 'metadata')"


@query("agg17_rule_graph", f"""
WITH own AS (SELECT {_cut.format('rule_id')} AS node, count(*) AS n, max(crit) AS m, avg(crit) AS a FROM graph_rules
             WHERE {_ns.format('rule_id')} GROUP BY 1),
edges AS (SELECT {_cut.format('rule_id')} AS src, {_cut.format('ref_id')} AS dst, count(*) AS weight FROM graph_conds
  WHERE clause <> 'unless' AND {_ns.format('rule_id')} AND {_ns.format('ref_id')} GROUP BY 1, 2 HAVING src <> dst)
SELECT 'node' AS item, node AS src, '' AS dst, n AS weight, m AS max_crit, round(a, 6) AS mean_crit FROM own
UNION ALL SELECT 'node', dst, '', 0, -1, 0 FROM (SELECT DISTINCT dst FROM edges) WHERE dst NOT IN (SELECT node FROM own)
UNION ALL SELECT 'edge', src, dst, weight, NULL, NULL FROM edges WHERE weight >= 3""".replace("WITH own", "SELECT * FROM (WITH own") + ")",
       "graph_rules graph_conds")
def rule_graph(spark, sf_dir):
    rules, conds = part_rules(spark, sf_dir)
    nodes, edges = graph.rule_graph(rules, conds, 3, ["objectives", "micro-behaviors", "METADATA"], min_refs=3)
    n = nodes.select(
        F.lit("node").alias("item"), F.col("node").alias("src"), F.lit("").alias("dst"), F.col("rules").alias("weight"), "max_crit",
        F.round("mean_crit", 6).alias("mean_crit"),
    )
    e = edges.select(F.lit("edge").alias("item"), "src", "dst", "weight", F.lit(None).cast("int").alias("max_crit"), F.lit(None).cast("double").alias("mean_crit"))
    return n.unionByName(e)


def linked(spark, sf_dir):
    """Findings with up to two references to other rules."""
    r = F.col("rule_id")
    refs = F.when(F.col("line_no") % 3 == 0, F.array(F.lit("micro-behaviors/net/http::r1"), F.lit("objectives/discovery/host::r33"))).when(
        F.col("line_no") % 3 == 1, F.array(F.lit("micro-behaviors/text/zip::x"))
    ).otherwise(F.array().cast("array<string>"))
    return base_findings(spark, sf_dir).withColumn("trait_refs", refs)


view("linked", """
SELECT rule_id, crit, CASE line_no % 3 WHEN 0 THEN ['micro-behaviors/net/http::r1', 'objectives/discovery/host::r33']
  WHEN 1 THEN ['micro-behaviors/text/zip::x'] ELSE [] END AS trait_refs FROM base_findings WHERE crit >= 1""", "base_findings")
view("link_edges", f"""
SELECT src, dst, count(*) AS weight FROM (
  SELECT {_cut.format('rule_id')} AS src, {_cut.format('ref')} AS dst FROM (SELECT rule_id, unnest(trait_refs) AS ref FROM linked))
WHERE src <> dst GROUP BY 1, 2""", "linked")
view("link_nodes", f"""
SELECT {_cut.format('rule_id')} AS node, count(*) AS match_count, max(crit) AS max_crit, bool_or(len(trait_refs) > 0) AS is_composite FROM linked GROUP BY 1
UNION ALL SELECT 'micro-behaviors/text/zip', 0, -1, FALSE""", "linked")


@query("agg18_findings_graph", """
SELECT node, match_count, max_crit, is_composite FROM link_nodes""", "link_nodes")
def findings_graph(spark, sf_dir):
    return graph.findings_graph(linked(spark, sf_dir), 3, min_crit=1)[0]


@query("agg19_graph_listing", """
SELECT split_part(node, '/', 1) AS namespace, node, match_count, max_crit, is_composite,
  coalesce((SELECT string_agg(dst || '(x' || weight || ')', ', ' ORDER BY dst || '(x' || weight || ')') FROM link_edges WHERE src = node), '') AS refs
FROM link_nodes""", "link_nodes link_edges")
def graph_listing(spark, sf_dir):
    return graph.graph_listing(*graph.findings_graph(linked(spark, sf_dir), 3, min_crit=1))


@query("srt2_heaviest_edges", "SELECT src, dst, weight FROM link_edges WHERE weight >= 100 ORDER BY weight DESC", "link_edges")
def heaviest_edges(spark, sf_dir):
    return graph.heaviest_edges(graph.findings_graph(linked(spark, sf_dir), 3, min_crit=1)[1], 100)


# -- paths, lines, functions, properties -------------------------------------------------------


@query("agg20_path_directories", """
SELECT file_id, directory, count(*) AS file_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  CASE WHEN bool_or(path_type = 'dynamic' AND contains(path, '/home/')) THEN 'user_enumeration' ELSE 'multiple_specific' END AS access_pattern
FROM (SELECT *, nullif(regexp_replace(regexp_replace(path, '/+$', ''), '[^/]*$', ''), '') AS directory FROM path_facts)
WHERE directory IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""", "path_facts")
def path_directories(spark, sf_dir):
    from ruleloom.operators.extract import path_directories as directories
    from ruleloom.plans.q_extract import path_facts

    return directories(path_facts(spark, sf_dir)).withColumn("categories", F.array_join("categories", ","))


ENTRY_PATHS = ("app/main.py", "lib/x.jar!!a.class", "deep/y.txt", "run.sh##base64", "z")


def members(spark, sf_dir):
    """Line items as members of their order's container."""
    li = read_table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    return li.select(
        F.col("l_orderkey").alias("container_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
        F.concat(pick(F.col("l_linenumber"), ENTRY_PATHS), F.col("l_linenumber")).alias("path"),
    )


view("members", f"""
SELECT DISTINCT l_orderkey AS container_id, l_orderkey * 10 + l_linenumber AS file_id,
  {sql_pick('l_linenumber', ENTRY_PATHS)} || l_linenumber AS path FROM lineitem""")


def member_findings(spark, sf_dir):
    return base_findings(spark, sf_dir).withColumn("file_id", F.col("file_id") * 10 + F.col("seq"))


@query("agg31_container_guard", """
WITH s AS (SELECT container_id, count(*) AS n, sum(uncompressed) AS total, max(uncompressed) AS single,
    bool_or(compressed > 0 AND uncompressed // compressed > 100) AS bomb,
    bool_or(regexp_matches(name, '(^|/)\\.\\.(/|$)')) AS climbs,
    bool_or(coalesce(symlink_target LIKE '/%' OR regexp_matches(symlink_target, '(^|/)\\.\\.(/|$)'), FALSE)) AS escapes FROM entries GROUP BY 1)
SELECT container_id, 'excessive_file_count' AS reason FROM s WHERE n > 6 UNION ALL SELECT container_id, 'excessive_total_size' FROM s WHERE total > 8000000
UNION ALL SELECT container_id, 'excessive_file_size' FROM s WHERE single > 5000000 UNION ALL SELECT container_id, 'zip_bomb' FROM s WHERE bomb
UNION ALL SELECT container_id, 'path_traversal' FROM s WHERE climbs UNION ALL SELECT container_id, 'symlink_escape' FROM s WHERE escapes""".replace(
    "WITH s AS", "SELECT * FROM (WITH s AS") + ")", "entries")
def container_guard(spark, sf_dir):
    return containers.guard_findings(entries(spark, sf_dir), max_entries=6, max_total=8_000_000, max_single=5_000_000)


@query("agg35_container_rollup", """
SELECT container_id, rule_id, max(crit) AS crit, arg_min('archive:' || path || ':' || line_no, (path, file_id, line_no)) AS location,
  count(DISTINCT file_id) AS members
FROM (SELECT file_id * 10 + seq AS file_id, rule_id, crit, line_no FROM base_findings) JOIN (
  SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY path, file_id) <= 3) USING (file_id) GROUP BY 1, 2""",
       "members base_findings")
def container_rollup(spark, sf_dir):
    kept = containers.first_members(members(spark, sf_dir), 3)
    return containers.container_findings(kept, member_findings(spark, sf_dir))


KEPT_STRINGS = ("http://a.example/x", "10.20.30.40", "QUJDREVGR0hJSktMTU5PUA==", "plain", "/usr/bin/x", "me@x.example")
view("path_strings_all", f"SELECT l_orderkey AS file_id, {sql_pick('l_partkey', KEPT_STRINGS)} AS value FROM lineitem")


@query("agg35_container_strings", f"""
SELECT DISTINCT container_id, value, string_type FROM (SELECT file_id * 10 + 1 AS file_id, value, {SQL_KIND} AS string_type FROM path_strings_all)
JOIN members USING (file_id) WHERE string_type IN ('url', 'ip', 'base64')""", "members path_strings_all")
def container_strings(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + 1).alias("file_id"), pick(F.col("l_partkey"), KEPT_STRINGS).alias("value"))
    return containers.container_strings(members(spark, sf_dir), classify_strings(li))


@query("agg36_container_tree", """
SELECT o_orderkey AS container_id, CAST(0 AS BIGINT) AS id, NULL::INTEGER AS parent_id, 0 AS depth, 'c' || o_orderkey || '.zip' AS path FROM orders
UNION ALL SELECT container_id, row_number() OVER (PARTITION BY container_id ORDER BY file_id), 0, 1,
  CASE WHEN contains(path, '!!') OR contains(path, '##') THEN path ELSE 'c' || container_id || '.zip!!' || path END FROM members""", "members")
def container_tree(spark, sf_dir):
    roots = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("container_id"), F.concat(F.lit("c"), "o_orderkey", F.lit(".zip")).alias("root_path")
    )
    return containers.container_tree(roots, members(spark, sf_dir))


@query("agg37_payload_findings", """
SELECT file_id, 'metadata/encoded-payload/' || chain AS rule_id, 0.9::DOUBLE AS conf,
  arg_min(CASE WHEN starts_with(value, '#!/bin/') OR regexp_matches(value, 'import |def |class ') THEN 2 ELSE 1 END, "offset") AS crit
FROM payloads_sql GROUP BY 1, 2""", "payloads_sql")
def payload_findings(spark, sf_dir):
    from ruleloom.operators.decode import payload_findings as found

    return found(payloads(spark, sf_dir)).select("file_id", "rule_id", "conf", "crit")


@query("agg38_long_lines", """
SELECT file_id, CAST(max(strlen(line)) AS BIGINT) AS longest, 'objectives/anti-analysis/long-line::excessive' AS rule_id, 2 AS crit
FROM doc_lines GROUP BY 1 HAVING max(strlen(line)) > 2500""", "doc_lines")
def long_lines(spark, sf_dir):
    return FD.long_line_findings(files(spark, sf_dir), limit=2500)


@query("agg39_function_shape", """
SELECT DISTINCT file_id, rule_id FROM (
  SELECT file_id, 'complexity/high' AS rule_id FROM functions WHERE complexity > 10 AND loops > 0
  UNION ALL SELECT file_id, 'anti-analysis/obfuscation/control-flow' FROM functions WHERE complexity > 20 AND loops > 0
  UNION ALL SELECT file_id, 'data/encode' FROM functions WHERE loops >= 2)""", "functions")
def function_shape(spark, sf_dir):
    return FD.function_findings(functions(spark, sf_dir))


ANOMALIES = (None, "no_section_header", "overlapping_functions", "unusual_entry_point", "odd", None)


@query("agg40_file_properties", f"""
SELECT file_id, unnest(list_filter([CASE WHEN NOT canary AND NOT nx AND NOT pic THEN 'binary/security/none' END,
  CASE WHEN stripped THEN 'anti-analysis/stripped' END, CASE WHEN is_static THEN 'binary/linking/static' END,
  CASE anomaly WHEN 'no_section_header' THEN 'anti-analysis/format/no-sections' WHEN 'overlapping_functions' THEN 'anti-analysis/format/overlapping'
    WHEN 'unusual_entry_point' THEN 'anti-analysis/format/entry-point' WHEN 'odd' THEN 'binary/anomaly' END], lambda x: x IS NOT NULL)) AS rule_id
FROM (SELECT o_orderkey AS file_id, o_custkey % 2 = 0 AS canary, o_custkey % 3 = 0 AS nx, o_custkey % 5 = 0 AS pic,
  o_orderstatus = 'F' AS stripped, o_orderstatus = 'P' AS is_static, {sql_pick('o_orderkey', ANOMALIES)} AS anomaly FROM orders)""")
def file_properties(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    c, s = F.col("o_custkey"), F.col("o_orderstatus")
    props = o.select(
        F.col("o_orderkey").alias("file_id"), (c % 2 == 0).alias("canary"), (c % 3 == 0).alias("nx"), (c % 5 == 0).alias("pic"),
        (s == "F").alias("stripped"), (s == "P").alias("is_static"), pick(F.col("o_orderkey"), ANOMALIES).alias("anomaly"),
    )
    return FD.property_findings(props)


# -- signatures and vendors ------------------------------------------------------------------------

LABELS = ("$a", None, "$b")
MATCHED = ("cmd /c x", "", "\u0007bell", "tab\tok")


@query("agg32_signature_evidence", f"""
SELECT l_orderkey AS file_id, rule, CASE WHEN label IS NULL THEN coalesce(CASE WHEN ok THEN matched END, rule)
    WHEN ok THEN matched ELSE label END AS value,
  CASE WHEN label IS NULL THEN 'ns' ELSE 'offset:0x' || lower(to_hex(l_partkey)) END AS location
FROM (SELECT l_orderkey, l_partkey, 'sig_' || (l_suppkey % 9) AS rule, {sql_pick('l_suppkey', LABELS)} AS label,
  list_extract(['cmd /c x', '', chr(7) || 'bell', 'tab' || chr(9) || 'ok'], CAST(l_partkey % 4 AS INT) + 1) AS matched, l_partkey % 4 IN (0, 3) AS ok FROM lineitem)""")
def signature_evidence(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    matches = li.select(
        F.col("l_orderkey").alias("file_id"), F.concat(F.lit("sig_"), F.col("l_suppkey") % 9).alias("rule"), F.lit("ns").alias("namespace"),
        pick(F.col("l_suppkey"), LABELS).alias("label"), pick(F.col("l_partkey"), MATCHED).alias("matched"), F.col("l_partkey").alias("offset"),
    )
    return FD.signature_evidence(matches)


# name before and after the number, and the id tail it must give
VENDOR_NAMES = (
    ("Linux_Trojan_Mirai{}_deadbeef01", "linux/trojan/mirai{}"), ("MAL_Emotet{}_Str", "emotet{}"), ("Windows_Odd{}_cafebabe99", "windows/odd{}"),
    ("Malware_Mal_APT{}_2021_Hex", "apt{}"), ("CVE_2019_{}_Exploit_bin", "exploit"), ("Webshell{}_PHP", "webshell{}_php"),
)
NAMESPACES = ("3p.elastic", "3p.bartblaze.APT", "neo23x0")


@query("agg33_vendor_ids", f"""
SELECT p_partkey, 'third_party/' || list_extract(['elastic', 'bartblaze/APT', 'neo23x0'], CAST(p_partkey % 3 AS INT) + 1) || '/' ||
  replace({sql_pick('p_partkey // 3', [v[1] for v in VENDOR_NAMES])}, '{{}}', CAST(p_partkey AS VARCHAR)) AS trait_id FROM part""")
def vendor_ids(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    name = F.replace(pick(F.floor(F.col("p_partkey") / 3), [v[0] for v in VENDOR_NAMES]), F.lit("{}"), F.col("p_partkey").cast("string"))
    return part.select("p_partkey", FD.vendor_rule_id(pick(F.col("p_partkey"), NAMESPACES), name).alias("trait_id"))


@query("agg34_rule_costs", """
SELECT rule_id, sum(l_quantity) AS total_ms, CAST(sum(l_linenumber) AS BIGINT) AS hits, count(*) AS runs FROM (
  SELECT *, 'r' || (l_partkey % 200) AS rule_id FROM lineitem) GROUP BY 1 HAVING sum(l_quantity) >= 100 ORDER BY 2 DESC""")
def rule_costs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    runs = li.select(
        F.concat(F.lit("r"), F.col("l_partkey") % 200).alias("rule_id"), F.col("l_quantity").alias("elapsed_ms"),
        F.col("l_linenumber").alias("hits"),
    )
    return FD.rule_costs(runs, 100.0).select("rule_id", "total_ms", "hits", "runs")


@query("srt3_costliest_rules", """
SELECT rule_id, CAST(sum(size_bytes) AS BIGINT) AS bytes_matched, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS runs
FROM doc_atomic JOIN files USING (file_id) GROUP BY 1 HAVING sum(size_bytes) >= 10000 ORDER BY 2 DESC, 1""", "doc_atomic files")
def costliest_rules(spark, sf_dir):
    """Rules by the bytes of the files they matched, over a threshold; time is not measured."""
    found = doc_atomic(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "size_bytes"), "file_id")
    costs = found.groupBy("rule_id").agg(F.sum("size_bytes").alias("bytes_matched"), F.sum("hits").alias("hits"), F.count("*").alias("runs"))
    return costs.filter(F.col("bytes_matched") >= 10000).orderBy(F.desc("bytes_matched"), "rule_id")


# -- caps, firsts, unions -------------------------------------------------------------------------


@query("win4_findings_cap", """
SELECT file_id, rule_id, crit, conf FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY crit DESC, floor(conf * 100) DESC, rule_id) AS rn FROM (
    SELECT DISTINCT file_id % 50 AS g, file_id, rule_id || '/' || file_id || '/' || line_no AS rule_id, crit, conf FROM base_findings)) WHERE rn <= 500""",
       "base_findings")
def findings_cap(spark, sf_dir):
    found = base_findings(spark, sf_dir).select(
        (F.col("file_id") % 50).alias("g"), "file_id", F.concat_ws("/", "rule_id", "file_id", "line_no").alias("rule_id"), "crit", "conf"
    ).distinct()
    order = [F.col("crit").desc(), F.floor(F.col("conf") * 100).desc(), F.col("rule_id")]
    return windows.first_n_per_group(found, ["g"], order, K.MAX_FINDINGS_PER_FILE).select("file_id", "rule_id", "crit", "conf")


@query("win5_first_per_id", """
SELECT file_id, rule_id, arg_min(value, (seq, crit, conf, value)) AS value FROM base_findings GROUP BY 1, 2""", "base_findings")
def first_per_id(spark, sf_dir):
    found = base_findings(spark, sf_dir).select("file_id", "rule_id", "seq", "crit", "conf", "value")
    return FD.first_per_id(found, ["seq"]).select("file_id", "rule_id", "value")


@query("win7_first_strings", """
SELECT file_id, value, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY "offset", value) AS rn FROM (
  SELECT DISTINCT file_id % 25 AS file_id, value, "offset" FROM located)) WHERE rn <= 100""", "located")
def first_strings(spark, sf_dir):
    from ruleloom.plans.tables import located

    strings = located(spark, sf_dir).select((F.col("file_id") % 25).alias("file_id"), "value", "offset").distinct()
    return windows.first_n_per_group(strings, ["file_id"], [F.col("offset"), F.col("value")], K.MAX_EMBEDDED_STRINGS)


@query("win8_unique_names", """
SELECT value, min(file_id) AS file_id FROM (SELECT file_id, value || ' ' || "offset" AS value FROM located) GROUP BY 1 HAVING count(*) = 1""", "located")
def unique_names(spark, sf_dir):
    from ruleloom.plans.tables import located

    named = located(spark, sf_dir).select("file_id", F.concat_ws(" ", "value", "offset").alias("value"))
    return windows.unique_in(named, "value", ["file_id"])


@query("win9_running_budget", """
SELECT file_id, "offset", n_bytes FROM (
  SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY file_id ORDER BY "offset" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
  FROM (SELECT file_id % 25 AS file_id, "offset", strlen(value) AS n_bytes FROM located)) WHERE taken < 5000""", "located")
def running_budget(spark, sf_dir):
    from ruleloom.plans.tables import located

    strings = located(spark, sf_dir).select(
        (F.col("file_id") % 25).alias("file_id"), "offset", F.octet_length("value").cast("bigint").alias("n_bytes")
    )
    return windows.within_budget(strings, "file_id", "offset", "n_bytes", 5000)


@query("srt4_sorted_sample", """
SELECT file_id, array_to_string(list_sort(list_distinct(list(symbol)))[1:5], ',') AS sample FROM symbols GROUP BY 1""", "symbols")
def sorted_sample(spark, sf_dir):
    syms = symbols(spark, sf_dir).select("file_id", "symbol")
    return P.counted_per_file(syms.select("file_id").distinct(), syms, "symbol").select("file_id", F.array_join("sample", ",").alias("sample"))


@query("srt5_riskiest_files", """
SELECT * FROM order_report ORDER BY max_crit DESC, hostile DESC, suspicious DESC, notable DESC, file_id LIMIT 50""", "order_report")
def riskiest_files(spark, sf_dir):
    return FD.top_files(order_report(spark, sf_dir), 50)


@query("set1_fact_union", """
SELECT fact, count(*) AS n FROM (SELECT 'string' AS fact, value FROM doc_tokens UNION ALL SELECT kind, symbol FROM symbols) GROUP BY 1""", "doc_tokens symbols")
def fact_union(spark, sf_dir):
    facts = token_strings(spark, sf_dir).select(F.lit("string").alias("fact"), "value").unionByName(
        symbols(spark, sf_dir).select(F.col("kind").alias("fact"), F.col("symbol").alias("value"))
    )
    return facts.groupBy("fact").agg(F.count("*").alias("n"))


@query("set4_add_missing", """
SELECT file_id, rule_id, crit FROM (SELECT DISTINCT file_id, rule_id, crit FROM base_findings WHERE seq <= 2)
UNION ALL SELECT DISTINCT file_id, rule_id, 0 FROM base_findings b WHERE seq >= 2
  AND NOT EXISTS (SELECT 1 FROM base_findings a WHERE a.seq <= 2 AND a.file_id = b.file_id AND a.rule_id = b.rule_id)""", "base_findings")
def add_missing(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    first = found.filter(F.col("seq") <= 2).select("file_id", "rule_id", "crit").distinct()
    new = found.filter(F.col("seq") >= 2).select("file_id", "rule_id", F.lit(0).alias("crit")).distinct()
    return FD.add_missing(first, new)
