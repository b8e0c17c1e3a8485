"""Join queries and the comparison of two versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.operators import diff as D
from ruleloom.operators import findings as FD, joins, matching
from ruleloom.plans.q_predicates import token_strings
from ruleloom.plans.registry import query, view
from ruleloom.plans.rules import base_findings
from ruleloom.plans.tables import files, located, pick, sections, sql_pick, sql_text, symbols
from ruleloom.session import cut_lineage
from ruleloom.sources.tables import read_table

# -- pattern joins: patterns come from the parts, so their number grows with the data ----

view("token_patterns", """
SELECT 'p' || row_number() OVER (ORDER BY pattern) AS rule_id, pattern FROM (
  SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS pattern FROM benchmark)""")


def token_patterns(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))
    return read_table(spark, sf_dir, "benchmark").select(F.explode(words).alias("pattern")).distinct()


@query("join1_exact_patterns", """
SELECT file_id, pattern, count(*) AS hits FROM doc_tokens JOIN token_patterns ON value = pattern GROUP BY ALL""", "doc_tokens token_patterns")
def exact_patterns(spark, sf_dir):
    hits = matching.exact_hits(token_strings(spark, sf_dir), token_patterns(spark, sf_dir))
    return hits.groupBy("file_id", "pattern").agg(F.count("*").alias("hits"))


@query("join2_exact_patterns_ci", """
SELECT file_id, pattern, count(*) AS hits FROM doc_tokens JOIN token_patterns ON lower(value) = lower(pattern) GROUP BY ALL""", "doc_tokens token_patterns")
def exact_patterns_ci(spark, sf_dir):
    hits = matching.exact_hits(token_strings(spark, sf_dir), token_patterns(spark, sf_dir), case_insensitive=True)
    return hits.groupBy("file_id", "pattern").agg(F.count("*").alias("hits"))


view("long_patterns", "SELECT pattern FROM token_patterns WHERE length(pattern) >= 9", "token_patterns")


@query("join3_literal_then_regex", """
SELECT value, pattern, count(*) AS hits FROM doc_tokens JOIN long_patterns ON contains(value, pattern)
WHERE regexp_matches(value, pattern || '[a-z]+$') GROUP BY ALL""", "doc_tokens long_patterns")
def literal_then_regex(spark, sf_dir):
    """Regexes with a literal head: gram candidates first, the regex decides.

    Equal strings are counted first, so each distinct one is tested once.
    """
    distinct = token_strings(spark, sf_dir).groupBy("value").agg(F.count("*").alias("hits"))
    rules = token_patterns(spark, sf_dir).filter(F.char_length("pattern") >= 9).select(
        F.col("pattern").alias("rule_id"), F.concat("pattern", F.lit("[a-z]+$")).alias("pattern")
    )
    hits = matching.regex_hits(distinct, rules, ["value"])
    return hits.select("value", F.col("rule_id").alias("pattern"), "hits")


RAW_SETS = (
    ("r_tion", "all", "tion(tion)+"), ("r_token", "all", 'token = "[0-9a-f]+"'), ("r_en", "en", "[Tt]he (and|of)"),
    ("r_de", "de", "und [A-Za-z]+ung"), ("r_phone", "all", r"\+1 \([0-9]{3}\)"), ("r_fr", "fr", "[A-Z]{3,}"),
)


@query("join4_raw_regex_sets", " UNION ALL ".join(
    f"SELECT file_id, '{r}' AS rule_id, CAST(len(regexp_extract_all(text, {sql_text(p)})) AS BIGINT) AS hits FROM files "
    f"WHERE regexp_matches(text, {sql_text(p)}) AND ('{t}' = 'all' OR file_type = '{t}')" for r, t, p in RAW_SETS), "files")
def raw_regex_sets(spark, sf_dir):
    """Universal and per-type regexes over whole texts; files with a line over 1 MB are skipped."""
    from ruleloom.session import local_table

    doc = files(spark, sf_dir).select("file_id", "file_type", "text")
    longest = F.array_max(F.transform(T.text_lines(F.col("text")), F.octet_length))
    rules = local_table(spark, [(r, p, t) for r, t, p in RAW_SETS], "rule_id string, pattern string, rule_type string")
    usable = doc.filter(F.coalesce(longest, F.lit(0)) <= K.LONG_LINE_BYTES)
    hits = matching.regex_hits(usable, rules, ["file_id"], "text").filter(F.col("rule_type").isin("all") | (F.col("rule_type") == F.col("file_type")))
    return hits.select("file_id", "rule_id", F.regexp_count("text", F.col("pattern")).cast("bigint").alias("hits"))


RULE_TYPES = ("en", "de", "all", "fr", "es")


@query("join5_applicable_rules", f"""
SELECT file_id, count(*) AS n_rules, min(rule_id) AS first_rule FROM files JOIN (
  SELECT 'r' || p_partkey AS rule_id, {sql_pick('p_partkey', RULE_TYPES)} AS rule_type FROM part) ON rule_type IN ('all', file_type) GROUP BY 1""", "files")
def applicable_rules(spark, sf_dir):
    rules = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), "p_partkey").alias("rule_id"), pick(F.col("p_partkey"), RULE_TYPES).alias("file_type")
    )
    return matching.applicable_counts(files(spark, sf_dir).select("file_id", "file_type"), rules)


@query("join7_symbol_capability", """
SELECT file_id, symbol, 'cap/' || lower(p_type) AS capability, count(*) AS n FROM symbols JOIN (
  SELECT replace(p_name, ' ', '_') AS bare, min(p_type) AS p_type FROM part GROUP BY 1) ON ltrim(symbol, '_') = bare GROUP BY ALL""", "symbols")
def symbol_capability(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    table = part.groupBy(F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol")).agg(
        F.concat(F.lit("cap/"), F.lower(F.min("p_type"))).alias("capability")
    )
    hits = FD.symbol_capabilities(symbols(spark, sf_dir).select("file_id", "symbol"), table)
    return hits.groupBy("file_id", "symbol", "capability").agg(F.count("*").alias("n"))


@query("join8_offset_section", """
SELECT file_id, value, "offset", line_no, (SELECT arg_min(name, ("start", name)) FROM sections s WHERE s.file_id = l.file_id
  AND l."offset" >= s."start" AND l."offset" < s."end") AS section FROM located l""", "located sections")
def offset_section(spark, sf_dir):
    return joins.containing_section(located(spark, sf_dir), sections(spark, sf_dir))


# -- two versions of the documents --------------------------------------------------------

VERSION_NAMES = ("doc_{}.txt", "libmodule{}.so.1", "long-report-name-{}.md", "notes_{}.txt")


def _versions(spark, sf_dir):
    """Every seventh document has a path of its own before, every fifth one after; some are edited."""
    doc = files(spark, sf_dir).select("file_id", "file_type", "text", "sha256")
    key = F.col("file_id")
    halves = [n.split("{}") for n in VERSION_NAMES]

    def path(number, suffix, folder):
        before, after = pick(key, [h[0] for h in halves]), pick(key, [h[1] for h in halves])
        return F.concat(F.lit("root/"), folder, F.lit("/"), before, number.cast("string"), after, suffix)

    base = doc.withColumn("path", path(key, F.lit(""), F.when(key % 7 == 0, F.lit("retired")).otherwise(F.col("file_type"))))
    moved = F.when(key % 5 == 0, F.lit("incoming")).when(key % 11 == 0, F.lit("moved")).otherwise(F.col("file_type"))
    suffix = F.when((key % 4 == 1) & (key % 3 == 0), F.lit(".2")).when((key % 4 == 2) & (key % 3 == 0), F.lit("x")).otherwise("")
    edited = key % 6 == 0
    target = (
        doc.withColumn("path", path(key, suffix, moved))
        .withColumn("text", F.when(edited, F.concat("text", F.lit("\ncurl http://x.example token"))).otherwise(F.col("text")))
        .withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    )
    return base, target


def _sql_path(suffix: str, folder: str) -> str:
    halves = [n.split("{}") for n in VERSION_NAMES]
    return (f"'root/' || {folder} || '/' || {sql_pick('file_id', [h[0] for h in halves])} || file_id || "
            f"{sql_pick('file_id', [h[1] for h in halves])} || {suffix}")


view("baseline", f"SELECT file_id, file_type, text, sha256, {_sql_path(sql_text(''), "CASE WHEN file_id % 7 = 0 THEN 'retired' ELSE file_type END")} AS path FROM files", "files")
view("target", f"""
SELECT file_id, file_type, path, CASE WHEN file_id % 6 = 0 THEN text || chr(10) || 'curl http://x.example token' ELSE text END AS text,
  CASE WHEN file_id % 6 = 0 THEN sha256(text || chr(10) || 'curl http://x.example token') ELSE sha256 END AS sha256
FROM (SELECT * EXCLUDE (path), {_sql_path("CASE WHEN file_id % 4 = 1 AND file_id % 3 = 0 THEN '.2' WHEN file_id % 4 = 2 AND file_id % 3 = 0 THEN 'x' ELSE '' END",
                           "CASE WHEN file_id % 5 = 0 THEN 'incoming' WHEN file_id % 11 = 0 THEN 'moved' ELSE file_type END")} AS path FROM files)""", "files")
view("removed", "SELECT path FROM baseline EXCEPT SELECT path FROM target", "baseline", "target")
view("added", "SELECT path FROM target EXCEPT SELECT path FROM baseline", "baseline", "target")


def changed_paths(spark, sf_dir):
    base, target = _versions(spark, sf_dir)
    items = cut_lineage(D.added_removed(base, target, ["path"]))
    side = lambda c: items.filter(F.col("change") == c).select("path")
    return side("removed"), side("added")


@query("join9_file_alignment", """
SELECT path, CASE WHEN b.sha256 IS NULL THEN 'added' WHEN t.sha256 IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM baseline b FULL JOIN target t USING (path) WHERE b.sha256 IS DISTINCT FROM t.sha256""", "baseline target")
def file_alignment(spark, sf_dir):
    return D.align_files(*_versions(spark, sf_dir))


@query("join10_added_removed", """
SELECT path, 'removed' AS change FROM removed UNION ALL SELECT path, 'added' FROM added""", "removed added")
def added_removed(spark, sf_dir):
    return D.added_removed(*_versions(spark, sf_dir), ["path"])


@query("set2_common_paths", "SELECT path FROM baseline INTERSECT SELECT path FROM target", "baseline target")
def common_paths(spark, sf_dir):
    base, target = _versions(spark, sf_dir)
    return base.select("path").intersect(target.select("path"))


@query("set3_except_both_ways", """
SELECT 'baseline' AS side, path FROM removed UNION ALL SELECT 'target', path FROM added""", "removed added")
def except_both_ways(spark, sf_dir):
    base, target = (v.select("path") for v in _versions(spark, sf_dir))
    gone = base.exceptAll(target).select(F.lit("baseline").alias("side"), "path")
    return gone.unionByName(target.exceptAll(base).select(F.lit("target").alias("side"), "path"))


_base_name = "regexp_extract(path, '[^/]*$')"
view("renames1", f"""
SELECT r.path AS baseline_path, a.path AS target_path, 1.0::DOUBLE AS score FROM
  (SELECT {_base_name} AS n, min(path) AS path FROM removed GROUP BY 1 HAVING count(*) = 1) r JOIN
  (SELECT {_base_name} AS n, min(path) AS path FROM added GROUP BY 1 HAVING count(*) = 1) a USING (n)""", "removed", "added")
_lib = f"CASE WHEN regexp_matches({_base_name}, '\\.so($|\\.)') THEN split_part({_base_name}, '.so', 1) END"
view("renames2", f"""
SELECT r.path AS baseline_path, a.path AS target_path, 0.95::DOUBLE AS score FROM
  (SELECT {_lib} AS n, path, row_number() OVER (PARTITION BY {_lib} ORDER BY path) AS rn FROM removed WHERE path NOT IN (SELECT baseline_path FROM renames1) AND {_lib} IS NOT NULL) r JOIN
  (SELECT {_lib} AS n, path, row_number() OVER (PARTITION BY {_lib} ORDER BY path) AS rn FROM added WHERE path NOT IN (SELECT target_path FROM renames1) AND {_lib} IS NOT NULL) a USING (n, rn)""",
     "removed", "added", "renames1")
view("similar_pairs", f"""
SELECT * FROM (SELECT r.path AS baseline_path, a.path AS target_path, round(1 - levenshtein(r.n, a.n) / greatest(length(r.n), length(a.n)), 6) AS score FROM
  (SELECT {_base_name} AS n, regexp_replace(path, '/[^/]*$', '') AS d, path FROM removed WHERE path NOT IN (SELECT baseline_path FROM renames1 UNION ALL SELECT baseline_path FROM renames2)) r JOIN
  (SELECT {_base_name} AS n, regexp_replace(path, '/[^/]*$', '') AS d, path FROM added WHERE path NOT IN (SELECT target_path FROM renames1 UNION ALL SELECT target_path FROM renames2)) a USING (d))
WHERE score >= 0.9""", "removed", "added", "renames1", "renames2")
# Best score first, then by path: a pair is taken if neither of its files is taken yet.
view("renames3", """
SELECT baseline_path, target_path, score FROM (
  WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, baseline_path, target_path) AS k FROM similar_pairs),
  taken AS (
    SELECT 0::BIGINT AS k, [''] AS used, NULL::VARCHAR AS baseline_path, NULL::VARCHAR AS target_path, NULL::DOUBLE AS score
    UNION ALL
    SELECT n.k, list_append(list_append(t.used, 'b' || n.baseline_path), 't' || n.target_path), n.baseline_path, n.target_path, n.score
    FROM taken t, LATERAL (SELECT * FROM ranked r WHERE r.k > t.k AND NOT list_contains(t.used, 'b' || r.baseline_path) AND NOT list_contains(t.used, 't' || r.target_path) ORDER BY r.k LIMIT 1) n)
  SELECT * FROM taken) WHERE k > 0""", "similar_pairs")


@query("join11_unique_name_renames", "SELECT * FROM renames1", "renames1")
def unique_name_renames(spark, sf_dir):
    return D.same_name_renames(*changed_paths(spark, sf_dir))


def _after_first(spark, sf_dir):
    removed, added = changed_paths(spark, sf_dir)
    first = cut_lineage(D.same_name_renames(removed, added))
    return D._unused(removed, first, "baseline_path"), D._unused(added, first, "target_path")


@query("join12_library_renames", "SELECT * FROM renames2", "renames2")
def library_renames(spark, sf_dir):
    return D.library_renames(*_after_first(spark, sf_dir))


def _after_second(spark, sf_dir):
    r, a = _after_first(spark, sf_dir)
    second = cut_lineage(D.library_renames(r, a))
    return D._unused(r, second, "baseline_path"), D._unused(a, second, "target_path")


@query("join13_similar_names", "SELECT * FROM similar_pairs", "similar_pairs")
def similar_names(spark, sf_dir):
    return D.similar_names(*_after_second(spark, sf_dir))


@query("win6_best_rename", "SELECT * FROM renames3", "renames3")
def best_rename(spark, sf_dir):
    return D.best_pairs(D.similar_names(*_after_second(spark, sf_dir)))


@query("srt1_rename_list", """
SELECT * FROM renames1 UNION ALL SELECT * FROM renames2 UNION ALL SELECT * FROM renames3 ORDER BY score DESC, baseline_path""", "renames1 renames2 renames3")
def rename_list(spark, sf_dir):
    return D.renames(*changed_paths(spark, sf_dir))


RISK_IDS = ("execution/shell::a", "objectives/persistence/x::b", "net/http::c", "registry/write::d", "fs/read::e")


def finding_versions(spark, sf_dir):
    """Findings of orders in two versions: every row is in both, under another rule where its key says so."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rule = lambda by: F.concat(pick(F.col("l_partkey") + by, RISK_IDS), F.col("l_linenumber"))
    version = lambda changed, by: li.select(F.concat(F.lit("o/"), "l_orderkey").alias("path"), F.when(changed, rule(by)).otherwise(rule(0)).alias("rule_id"))
    return version(F.col("l_suppkey") % 3 == 0, 1), version(F.col("l_suppkey") % 4 == 0, 2)


def _sql_version(changed: str, by: int) -> str:
    rule = f"CASE WHEN {changed} THEN {sql_pick(f'(l_partkey + {by})', RISK_IDS)} ELSE {sql_pick('l_partkey', RISK_IDS)} END"
    return f"SELECT 'o/' || l_orderkey AS path, {rule} || l_linenumber AS rule_id FROM lineitem"


view("finding_items", f"""
(SELECT path, rule_id, 'added' AS change FROM ({_sql_version('l_suppkey % 4 = 0', 2)} EXCEPT {_sql_version('l_suppkey % 3 = 0', 1)}))
UNION ALL (SELECT path, rule_id, 'removed' FROM ({_sql_version('l_suppkey % 3 = 0', 1)} EXCEPT {_sql_version('l_suppkey % 4 = 0', 2)}))""")
_high = "regexp_matches(rule_id, '^(" + "|".join(K.RISK_PREFIXES) + ")')"
view("finding_changes", f"""
SELECT path, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed,
  count(*) FILTER (WHERE change = 'added') - count(*) FILTER (WHERE change = 'removed') AS capability_delta,
  count(*) FILTER (WHERE change = 'added' AND {_high}) > 0 AND count(*) FILTER (WHERE change = 'added' AND {_high}) > count(*) FILTER (WHERE change = 'removed' AND {_high}) AS risk_increase
FROM finding_items GROUP BY 1""", "finding_items")


@query("agg21_file_diff", "SELECT path, added, removed, capability_delta, risk_increase FROM finding_changes", "finding_changes")
def file_diff(spark, sf_dir):
    return D.finding_changes(*finding_versions(spark, sf_dir))


@query("agg22_risk_increase", "SELECT count(*) FILTER (WHERE risk_increase) AS risen, count(*) AS changed FROM finding_changes", "finding_changes")
def risk_increase(spark, sf_dir):
    return D.finding_changes(*finding_versions(spark, sf_dir)).agg(F.count_if(F.col("risk_increase")).alias("risen"), F.count("*").alias("changed"))


KINDS = ("finding", "trait", "string", "import", "export", "function", "syscall", "path", "env_var", "signature")


def fact_sides(spark, sf_dir):
    """Ten kinds of facts in two versions, keyed as each kind is compared."""
    syms = symbols(spark, sf_dir).withColumn("path", F.concat(F.lit("o/"), F.col("file_id"))).withColumn("side", F.col("offset") / 16 % 12)
    found = base_findings(spark, sf_dir).withColumn("path", F.concat(F.lit("o/"), F.col("file_id"))).withColumn("side", F.col("line_no") % 12)
    calls = read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("u/"), "user_id").alias("path"), F.concat("event_type", (F.col("event_id") % 40).cast("string")).alias("key"), (F.col("event_id") % 12).alias("side")
    )

    def of(kind, df, key):
        return kind, df.select("path", key.alias("key"), "side")

    by_kind = dict([
        of("finding", found, F.col("rule_id")),
        of("trait", found, F.concat_ws(":", F.lit("string"), "value")),
        of("string", found, F.col("value")),
        of("import", syms.filter(F.col("kind") == "import"), F.concat_ws(":", "source", "symbol")),
        of("export", syms.filter(F.col("kind") == "export"), F.col("symbol")),
        of("function", syms.filter(F.col("kind") == "function"), F.col("symbol")),
        of("syscall", calls, F.col("key")),
        of("path", calls, F.concat(F.lit("/tmp/"), "key")),
        of("env_var", calls, F.upper("key")),
        of("signature", found, F.concat_ws(":", F.lit("ns"), "rule_id")),
    ])
    base = {k: v.filter(F.col("side") != 0).select("path", "key") for k, v in by_kind.items()}
    target = {k: v.filter(F.col("side") != 1).select("path", "key") for k, v in by_kind.items()}
    return base, target


view("fact_rows", """
SELECT 'o/' || file_id AS path, 'finding' AS kind, rule_id AS key, line_no % 12 AS side FROM base_findings
UNION ALL SELECT 'o/' || file_id, 'trait', 'string:' || value, line_no % 12 FROM base_findings
UNION ALL SELECT 'o/' || file_id, 'string', value, line_no % 12 FROM base_findings
UNION ALL SELECT 'o/' || file_id, 'signature', 'ns:' || rule_id, line_no % 12 FROM base_findings
UNION ALL SELECT 'o/' || file_id, kind, CASE kind WHEN 'import' THEN source || ':' || symbol ELSE symbol END, "offset" // 16 % 12 FROM symbols
UNION ALL SELECT 'u/' || user_id, k, CASE k WHEN 'path' THEN '/tmp/' || x WHEN 'env_var' THEN upper(x) ELSE x END, event_id % 12
  FROM (SELECT user_id, event_id, event_type || (event_id % 40) AS x, unnest(['syscall', 'path', 'env_var']) AS k FROM events)""", "base_findings", "symbols")
view("diff_items", """
(SELECT *, 'added' AS change FROM (SELECT path, kind, key FROM fact_rows WHERE side <> 1 EXCEPT SELECT path, kind, key FROM fact_rows WHERE side <> 0))
UNION ALL (SELECT *, 'removed' FROM (SELECT path, kind, key FROM fact_rows WHERE side <> 0 EXCEPT SELECT path, kind, key FROM fact_rows WHERE side <> 1))""", "fact_rows")


@query("agg23_full_diff", "SELECT path, kind, key, change FROM diff_items", "diff_items")
def full_diff(spark, sf_dir):
    return D.full_diff(*fact_sides(spark, sf_dir))


@query("agg24_diff_counts", "SELECT path, " + ", ".join(
    f"count(*) FILTER (WHERE kind = '{k}' AND change = '{c}') AS {k}_{c}" for k in KINDS for c in ("added", "removed"))
    + " FROM diff_items GROUP BY ROLLUP (path)", "diff_items")
def diff_counts(spark, sf_dir):
    return D.diff_counts(D.full_diff(*fact_sides(spark, sf_dir)), list(KINDS))


@query("agg25_metric_deltas", """
SELECT path, CAST(strlen(t.text) - strlen(b.text) AS BIGINT) AS size_bytes, CAST(len(string_split(t.text, chr(10))) - len(string_split(b.text, chr(10))) AS BIGINT) AS total_lines
FROM baseline b JOIN target t USING (path)""", "baseline target")
def metric_deltas(spark, sf_dir):
    def measured(df):
        return df.select(
            "path", F.octet_length("text").cast("bigint").alias("size_bytes"), F.size(T.text_lines(F.col("text"))).cast("bigint").alias("total_lines")
        )

    base, target = _versions(spark, sf_dir)
    return D.metric_deltas(measured(base), measured(target), ["size_bytes", "total_lines"])


# -- names and vendors -------------------------------------------------------------------------

view("popular", "SELECT * FROM (VALUES " + ", ".join(f"('{o}', {i})" for i, (o, _) in enumerate(K.POPULAR_TYPOS)) + ") t(original, prio)")
view("typos", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{o}', {i})" for i, (o, ts) in enumerate(K.POPULAR_TYPOS) for t in ts) + ") t(name, original, prio)")
TYPO_BASES = tuple(o for o, _ in K.POPULAR_TYPOS)


def package_names(spark, sf_dir):
    """Popular names with an edit made by the customer key, and customer names."""
    c = read_table(spark, sf_dir, "customer")
    base, k = pick(F.col("c_custkey"), TYPO_BASES), F.col("c_custkey")
    edited = (
        F.when(k % 4 == 0, F.concat(base, F.lit("s")))
        .when(k % 4 == 1, F.substr(base, F.lit(2)))
        .when(k % 4 == 2, F.concat(F.substr(base, F.lit(1), F.lit(2)), F.lit("q"), F.substr(base, F.lit(3))))
        .otherwise(F.concat(F.substr(base, F.lit(1), F.lit(2)), F.lit("zz")))
    )
    return c.select(k.alias("key"), F.when(k % 5 == 0, F.lower("c_name")).otherwise(edited).alias("name"))


view("package_names", f"""
SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE CASE c_custkey % 4 WHEN 0 THEN b || 's' WHEN 1 THEN substr(b, 2)
  WHEN 2 THEN substr(b, 1, 2) || 'q' || substr(b, 3) ELSE substr(b, 1, 2) || 'zz' END END AS name
FROM (SELECT *, {sql_pick('c_custkey', TYPO_BASES)} AS b FROM customer)""")
_legit = ", ".join(f"'{n}'" for n in K.LEGITIMATE_NAMES)
view("typosquats", f"""
SELECT name, arg_min(original, prio) AS original FROM (
  SELECT name, t.original, prio FROM (SELECT DISTINCT name FROM package_names) JOIN typos t USING (name)
  UNION ALL SELECT name, original, prio FROM (SELECT DISTINCT name FROM package_names), popular WHERE levenshtein(name, original) = 1 AND name NOT IN ({_legit})) GROUP BY 1""",
     "package_names", "typos", "popular")


@query("join14_typosquat", "SELECT key, name, original FROM package_names JOIN typosquats USING (name)", "package_names typosquats")
def typosquat(spark, sf_dir):
    return joins.typosquats(package_names(spark, sf_dir))


view("part_rule_ids", "SELECT 'micro-behaviors/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '::' || p_partkey AS rule_id FROM part")


def part_rule_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("micro-behaviors/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("::"), "p_partkey").alias("rule_id")
    )


@query("join15_similar_rules", """
SELECT rule_id, CAST(levenshtein('micro-behaviors/small/hot', lower(rule_id)) AS INTEGER) AS distance FROM part_rule_ids
WHERE contains(lower(rule_id), 'micro-behaviors/small/hot') OR levenshtein('micro-behaviors/small/hot', lower(rule_id)) < 15 ORDER BY 2""", "part_rule_ids")
def similar_rules(spark, sf_dir):
    return joins.similar_rules(part_rule_ids(spark, sf_dir), "micro-behaviors/SMALL/hot")


@query("join16_directory_rules", """
SELECT DISTINCT rule_id FROM part_rule_ids WHERE starts_with(rule_id, 'micro-behaviors/economy/') ORDER BY 1""", "part_rule_ids")
def directory_rules(spark, sf_dir):
    return joins.rules_in_directory(part_rule_ids(spark, sf_dir), "micro-behaviors/economy")


VENDORS = ("elastic", "neo23x0", "other", "bartblaze")


@query("join17_criticality_override", f"""
SELECT file_id, rule_id, coalesce(o.crit, s.crit, 'notable') AS crit FROM (
  SELECT l_orderkey AS file_id, 'sig' || (l_partkey % 300) AS rule_id, {sql_pick('l_suppkey', VENDORS)} AS vendor FROM lineitem) m
LEFT JOIN (SELECT 'sig' || p_partkey AS rule_id, CASE WHEN p_partkey % 2 = 0 THEN 'hostile' END AS crit, p_partkey % 7 = 0 AS disable FROM part) o USING (rule_id)
LEFT JOIN (VALUES ('elastic', 'suspicious'), ('neo23x0', 'inert')) s(vendor, crit) USING (vendor) WHERE NOT coalesce(disable, FALSE)""")
def criticality_override(spark, sf_dir):
    from ruleloom.session import local_table

    li = read_table(spark, sf_dir, "lineitem")
    matches = li.select(
        F.col("l_orderkey").alias("file_id"), F.concat(F.lit("sig"), F.col("l_partkey") % 300).alias("rule_id"), pick(F.col("l_suppkey"), VENDORS).alias("vendor")
    )
    key = F.col("p_partkey")
    overrides = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("sig"), key).alias("rule_id"), F.when(key % 2 == 0, "hostile").alias("crit"), (key % 7 == 0).alias("disable")
    )
    sources = local_table(spark, [("elastic", "suspicious"), ("neo23x0", "inert")], "vendor string, crit string")
    return FD.override_criticality(matches, overrides, sources, "notable").select("file_id", "rule_id", "crit")
