"""Rule precision and catalog quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.operators import catalog_checks as C
from ruleloom.operators import precision as P
from ruleloom.plans import catalog_tables as T
from ruleloom.plans.q_metrics import rounded
from ruleloom.plans.registry import query, view
from ruleloom.plans.tables import sql_list
from ruleloom.sources.tables import read_table


def register(name, sql, needs, check):
    """A query named `name` over (atomic, composite, conds) tables."""

    def run(spark, sf_dir):
        return check(T.atomic_rules(spark, sf_dir), T.composites(spark, sf_dir), T.composite_conds(spark, sf_dir))

    query(name, sql, needs)(run)


_same = "ctype, exact, substr, regex, word, case_insensitive, ref_id, metric_field, size_min, size_max, count_min, count_max, platforms, n_not, n_unless"
register("cat1_identical_rules", f"""
SELECT min(rule_id) AS rule_id, max(rule_id) AS other_id, count(DISTINCT rule_id) AS n, 'identical' AS detail FROM atomic GROUP BY {_same}, types HAVING count(DISTINCT rule_id) > 1""",
         "atomic", lambda a, c, k: C.identical_rules(a))
_norm = r"lower(regexp_replace(pattern, '^(\^|\\b)|(\$|\\b)$', '', 'g'))"
register("cat2_same_pattern", f"""
SELECT norm, min(rule_id) AS rule_id, count(DISTINCT rule_id) AS n FROM (SELECT *, {_norm} AS norm FROM patterns) p GROUP BY 1
HAVING count(DISTINCT rule_id) > 1 AND (bool_or(types = 'all') OR norm IN (
  SELECT norm FROM (SELECT DISTINCT {_norm} AS norm, rule_id, unnest(string_split(types, ',')) AS t FROM patterns) GROUP BY norm, t HAVING count(*) > 1))""",
         "patterns", lambda a, c, k: C.same_pattern(a))
register("cat3_alternative_is_literal", """
SELECT rule_id, alt, other_id FROM alternatives a JOIN (SELECT pattern, min(rule_id) AS other_id, list_distinct(flatten(list(string_split(types, ',')))) AS ot
  FROM patterns WHERE how <> 'regex' GROUP BY 1) l ON alt = pattern WHERE types = 'all' OR list_contains(ot, 'all') OR list_has_any(ot, string_split(types, ','))""",
         "alternatives patterns", lambda a, c, k: C.alternative_is_literal(a))
register("cat4_shared_alternatives", "SELECT alt, min(rule_id) AS rule_id, count(DISTINCT rule_id) AS n FROM alternatives GROUP BY 1 HAVING count(DISTINCT rule_id) > 1",
         "alternatives", lambda a, c, k: C.shared_alternatives(a))
register("cat5_regex_should_be_exact", r"SELECT rule_id, pattern FROM patterns WHERE how = 'regex' AND regexp_matches(pattern, '^\^[A-Za-z0-9_-]+\$$')",
         "patterns", lambda a, c, k: C.regex_should_be_exact(a))
register("cat6_same_pattern_other_kind", "SELECT pattern, min(rule_id) AS rule_id, count(DISTINCT ctype) AS n FROM patterns GROUP BY 1 HAVING count(DISTINCT ctype) > 1",
         "patterns", lambda a, c, k: C.same_pattern_other_kind(a))
register("cat7_exact_covered_by_substr", """
SELECT p.rule_id, p.pattern, s.other_id FROM patterns p JOIN (SELECT pattern, ctype, min(rule_id) AS other_id FROM patterns WHERE how = 'substr' GROUP BY ALL) s
  ON p.pattern = s.pattern AND p.ctype = s.ctype WHERE p.how = 'exact' AND p.rule_id <> s.other_id""", "patterns", lambda a, c, k: C.exact_covered_by_substr(a))
register("cat8_covered_ignoring_case", """
SELECT p.rule_id, p.pattern, s.other_id FROM patterns p JOIN (SELECT lower(pattern) AS low, how, ctype, min(rule_id) AS other_id FROM patterns
  WHERE how <> 'regex' AND case_insensitive GROUP BY ALL) s ON lower(p.pattern) = s.low AND p.ctype = s.ctype AND p.how = s.how WHERE NOT p.case_insensitive""",
         "patterns", lambda a, c, k: C.covered_ignoring_case(a))
register("cat9_regex_contains_literal", """
SELECT r.rule_id, l.pattern, l.other_id FROM patterns r JOIN (SELECT pattern, min(rule_id) AS other_id FROM patterns WHERE how <> 'regex' AND length(pattern) >= 5 GROUP BY 1) l
  ON contains(r.pattern, l.pattern) WHERE r.how = 'regex'""", "patterns", lambda a, c, k: C.regex_contains_literal(a))
view("alt_sets", "SELECT rule_id, list_sort(list(DISTINCT alt)) AS alts FROM alternatives GROUP BY 1", "alternatives")
register("cat10_alternative_subsets", """
SELECT a.rule_id, min(b.rule_id) AS other_id FROM alt_sets a JOIN alt_sets b ON len(a.alts) < len(b.alts) AND list_has_all(b.alts, a.alts) GROUP BY 1""",
         "alt_sets", lambda a, c, k: C.alternative_subsets(a))
register("cat11_regex_matches_literal", """
SELECT r.rule_id, min(l.other_id) AS other_id, count(DISTINCT l.pattern) AS n FROM patterns r JOIN (
  SELECT pattern, crit, min(rule_id) AS other_id FROM patterns WHERE how IN ('exact', 'substr') GROUP BY 1, 2) l
  ON r.crit = l.crit AND regexp_matches(l.pattern, r.pattern) WHERE r.how = 'regex' GROUP BY 1""", "patterns", lambda a, c, k: C.regex_matches_literal(a))
register("cat12_string_and_raw", """
SELECT pattern, how, crit, min(rule_id) AS rule_id FROM patterns WHERE ctype IN ('string', 'raw') GROUP BY 1, 2, 3 HAVING count(DISTINCT ctype) = 2""",
         "patterns", lambda a, c, k: C.string_and_raw(a))
register("cat13_for_only_duplicates", f"""
SELECT min(rule_id) AS rule_id, max(rule_id) AS other_id, count(DISTINCT rule_id) AS n, 'for only' AS detail FROM atomic GROUP BY {_same}
HAVING count(DISTINCT rule_id) > 1 AND count(DISTINCT types) > 1""", "atomic", lambda a, c, k: C.for_only_duplicates(a))
register("cat14_case_merge_candidates", """
SELECT ctype, how, lower(substr(pattern, 1, 1)) || substr(pattern, 2) AS folded, min(rule_id) AS rule_id, count(DISTINCT pattern) AS n FROM patterns
WHERE how <> 'regex' AND length(pattern) > 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT pattern) > 1""", "patterns", lambda a, c, k: C.case_merge_candidates(a))
register("cat15_basename_duplicates", """
SELECT min(rule_id) AS rule_id, max(rule_id) AS other_id, count(DISTINCT rule_id) AS n, 'basename' AS detail FROM patterns WHERE ctype = 'basename'
GROUP BY pattern, how HAVING count(DISTINCT rule_id) > 1""", "patterns", lambda a, c, k: C.basename_duplicates(a))
register("cat16_inline_conditions", "SELECT rule_id, clause, ctype FROM conds WHERE clause IN ('all', 'any', 'none') AND ref_id IS NULL", "conds",
         lambda a, c, k: C.inline_conditions(k))
register("cat17_redundant_any_refs", """
SELECT rule_id, split_part(ref_id, '::', 1) AS dir, count(*) AS n FROM conds WHERE clause = 'any' AND contains(ref_id, '::')
  AND split_part(ref_id, '::', 1) <> split_part(rule_id, '::', 1) AND NOT starts_with(ref_id, 'metadata/') GROUP BY 1, 2 HAVING count(*) >= 2""", "conds",
         lambda a, c, k: C.redundant_any_refs(k, at_least=2))
view("sizes", """
SELECT rule_id, count(*) FILTER (WHERE clause = 'all') AS n_all, count(*) FILTER (WHERE clause = 'any') AS n_any,
  count(*) FILTER (WHERE clause = 'none') AS n_none, count(*) FILTER (WHERE clause = 'unless') AS n_unless FROM conds GROUP BY 1""", "conds")
view("singles", """
SELECT c.rule_id, c.clause, c.ref_id FROM conds c JOIN sizes s USING (rule_id) JOIN composite r USING (rule_id)
WHERE n_none = 0 AND n_unless = 0 AND n_any + n_all = 1 AND NOT has_downgrade AND c.clause IN ('all', 'any') AND contains(c.ref_id, '::')""", "conds", "sizes", "composite")
register("cat18_single_item_clauses", "SELECT * FROM singles", "singles", lambda a, c, k: C.single_item_clauses(c, k))
register("cat19_overlapping_conditions", """
SELECT DISTINCT a.rule_id, a.clause, b.ref_id AS dir, a.ref_id FROM conds a JOIN conds b ON a.rule_id = b.rule_id AND a.clause = b.clause
WHERE a.clause IN ('all', 'any') AND NOT contains(b.ref_id, '::') AND contains(a.ref_id, '::') AND split_part(a.ref_id, '::', 1) = b.ref_id""", "conds",
         lambda a, c, k: C.overlapping_conditions(k))
register("cat20_impossible_needs", "SELECT rule_id, needs, n_any FROM composite JOIN sizes USING (rule_id) WHERE n_any > 0 AND needs > n_any", "composite sizes",
         lambda a, c, k: C.impossible_needs(c, k))
register("cat21_impossible_sizes", """
SELECT rule_id, size_min, size_max FROM atomic WHERE size_min > size_max UNION ALL SELECT rule_id, size_min, size_max FROM composite WHERE size_min > size_max""",
         "atomic composite", lambda a, c, k: C.impossible_sizes(a).unionByName(C.impossible_sizes(c)))
register("cat22_impossible_counts", "SELECT rule_id, count_min, count_max FROM atomic WHERE count_min > count_max", "atomic", lambda a, c, k: C.impossible_counts(a))
register("cat23_empty_clauses", """
SELECT rule_id, empty_clause FROM composite WHERE empty_clause IS NOT NULL AND rule_id NOT IN (SELECT rule_id FROM conds WHERE clause IN ('all', 'any', 'none'))""",
         "composite conds", lambda a, c, k: C.empty_clauses(c, k))
register("cat24_missing_patterns", """
SELECT rule_id, ctype FROM atomic WHERE ctype IN ('string', 'raw', 'symbol') AND exact IS NULL AND substr IS NULL AND regex IS NULL AND word IS NULL""", "atomic",
         lambda a, c, k: C.missing_patterns(a))
register("cat25_pure_aliases", """
SELECT a.rule_id, a.ref_id FROM atomic a JOIN atomic b ON a.ref_id = b.rule_id WHERE a.crit = b.crit AND a.rule_id <> a.ref_id AND a.size_min IS NULL AND a.size_max IS NULL
  AND a.count_min IS NULL AND a.count_max IS NULL AND coalesce(a.n_not, 0) = 0 AND coalesce(a.n_unless, 0) = 0 AND NOT a.has_downgrade""", "atomic",
         lambda a, c, k: C.pure_aliases(a))
register("cat26_redundant_needs_one", "SELECT rule_id FROM composite JOIN sizes USING (rule_id) WHERE needs = 1 AND n_any > 0 AND n_all = 0 AND n_none = 0",
         "composite sizes", lambda a, c, k: C.redundant_needs_one(c, k))
register("cat27_short_patterns", """
SELECT rule_id, substr FROM atomic WHERE ctype = 'raw' AND strlen(substr) <= 3 AND NOT coalesce(count_min >= 2, FALSE) AND count_max IS NULL
  AND (types = 'all' OR len(string_split(types, ',')) > 3)""", "atomic", lambda a, c, k: C.short_patterns_unnarrowed(a))
_both = lambda check: (lambda a, c, k: check(a.select("rule_id", "crit").unionByName(c.select("rule_id", "crit"))))
register("cat28_hostile_capabilities", "SELECT rule_id FROM all_rules WHERE starts_with(rule_id, 'micro-behaviors/') AND crit = 3", "all_rules", _both(C.hostile_capabilities))
register("cat29_inert_objectives", "SELECT rule_id FROM all_rules WHERE starts_with(rule_id, 'objectives/') AND crit = 0", "all_rules", _both(C.inert_objectives))
register("cat30_capability_to_objective", """
SELECT rule_id, ref_id FROM conds WHERE clause <> 'unless' AND starts_with(rule_id, 'micro-behaviors/') AND starts_with(ref_id, 'objectives/')""", "conds",
         lambda a, c, k: C.capability_to_objective(k))
register("cat31_misplaced_malware", "SELECT rule_id FROM all_rules WHERE regexp_matches(rule_id, '^(objectives|micro-behaviors)/malware/')", "all_rules", _both(C.misplaced_malware))


def _segment_sql(names, extra=""):
    listed = sql_list(names)
    return (f"SELECT dir, list_filter(string_split(dir, '/'), lambda s: list_contains({listed}, lower(s)))[1] AS segment FROM directories "
            f"WHERE len(list_filter(string_split(dir, '/'), lambda s: list_contains({listed}, lower(s)))) > 0{extra}")


_dirs = lambda check: (lambda a, c, k: check(C.directories(a.select("rule_id").unionByName(c.select("rule_id")))))
register("cat32_platform_directories", _segment_sql(K.PLATFORM_DIRECTORY_NAMES, " AND NOT starts_with(dir, 'metadata/format/') AND NOT contains(dir, '/interpreter/')"),
         "directories", _dirs(C.platform_directories))
register("cat33_shared_second_level", """
SELECT split_part(dir, '/', 2) AS second, string_agg(DISTINCT split_part(dir, '/', 1), ',' ORDER BY split_part(dir, '/', 1)) AS namespaces FROM directories
WHERE split_part(dir, '/', 1) IN ('cap', 'obj', 'known', 'meta') AND contains(dir, '/') GROUP BY 1 HAVING count(DISTINCT split_part(dir, '/', 1)) > 1""",
         "directories", _dirs(C.shared_second_level))
register("cat34_wrong_depth", """
SELECT dir, depth, verdict FROM (SELECT dir, CAST(len(string_split(dir, '/')) - 1 AS INTEGER) AS depth,
  CASE WHEN len(string_split(dir, '/')) - 1 < 3 AND NOT starts_with(dir, 'micro-behaviors/dylib/') THEN 'shallow' WHEN len(string_split(dir, '/')) - 1 > 4 THEN 'deep' END AS verdict
  FROM directories WHERE regexp_matches(dir, '^(micro-behaviors|objectives)/')) WHERE verdict IS NOT NULL""", "directories", _dirs(C.wrong_depth))
register("cat35_invalid_ids", """
SELECT rule_id, regexp_extract(split_part(rule_id, '::', 2), '[^A-Za-z0-9_-]') AS character FROM all_rules WHERE regexp_matches(split_part(rule_id, '::', 2), '[^A-Za-z0-9_-]')""",
         "all_rules", _both(C.invalid_ids))
register("cat36_banned_segments", _segment_sql(K.BANNED_SEGMENTS), "directories", _dirs(C.banned_segments))
register("cat37_repeated_segments", """
SELECT dir, arg_min(c, i) AS segment FROM (SELECT dir, i, s[i] AS p, s[i + 1] AS c FROM (SELECT dir, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (SELECT dir, string_split(dir, '/') AS s FROM directories)))
WHERE p = c OR (length(p) >= 3 AND length(c) >= 3 AND (rtrim(p, 's') = rtrim(c, 's') OR starts_with(p, c) OR starts_with(c, p))) GROUP BY 1""", "directories", _dirs(C.repeated_segments))
register("cat38_oversized_directories", "SELECT split_part(rule_id, '::', 1) AS dir, count(*) AS n FROM atomic GROUP BY 1 HAVING count(*) > 40", "atomic",
         lambda a, c, k: C.oversized_directories(a, 40))
view("known_ids", "SELECT rule_id FROM atomic UNION SELECT rule_id FROM composite", "atomic", "composite")
register("cat39_dangling_references", """
SELECT ref_id, min(rule_id) AS rule_id, count(*) AS n FROM conds WHERE ref_id IS NOT NULL AND CASE WHEN contains(ref_id, '::') THEN ref_id NOT IN (SELECT rule_id FROM known_ids)
  ELSE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT split_part(rule_id, '::', 1) AS d FROM known_ids) k WHERE d = conds.ref_id OR starts_with(d, conds.ref_id || '/')) END GROUP BY 1""",
         "conds known_ids", lambda a, c, k: C.dangling_references(k, a.select("rule_id").unionByName(c.select("rule_id"))))
register("cat40_unknown_metrics", f"""
SELECT metric_field, min(rule_id) AS rule_id, (SELECT arg_min(v, (levenshtein(metric_field, v), v)) FROM (SELECT unnest({sql_list(T.VALID_METRICS)}) AS v) WHERE levenshtein(metric_field, v) <= 3) AS suggestion
FROM atomic WHERE metric_field IS NOT NULL AND NOT list_contains({sql_list(T.VALID_METRICS)}, metric_field) GROUP BY 1""", "atomic", lambda a, c, k: C.unknown_metrics(a, T.VALID_METRICS))
register("cat41_conf_out_of_range", "SELECT rule_id, conf FROM atomic WHERE conf < 0 OR conf > 1", "atomic", lambda a, c, k: C.conf_out_of_range(a))
register("cat42_poor_descriptions", """
SELECT rule_id, CASE WHEN trim(coalesce(descr, '')) = '' THEN 'empty' ELSE 'short' END AS detail FROM atomic WHERE length(trim(coalesce(descr, ''))) < 5""", "atomic",
         lambda a, c, k: C.poor_descriptions(a))
register("cat43_unusable_criticality", "SELECT rule_id, raw_crit FROM atomic WHERE raw_crit = 'filtered'", "atomic", lambda a, c, k: C.unusable_criticality(a))
register("cat44_empty_exception_lists", """
SELECT rule_id, 'not' AS list FROM atomic WHERE n_not = 0 UNION ALL SELECT rule_id, 'unless' FROM atomic WHERE n_unless = 0""", "atomic", lambda a, c, k: C.empty_exception_lists(a))
register("cat45_several_matchers", """
SELECT rule_id, string_agg(how, ',' ORDER BY list_position(['exact', 'substr', 'regex', 'word'], how)) AS matchers FROM patterns GROUP BY 1 HAVING count(*) > 1""", "patterns",
         lambda a, c, k: C.several_matchers(a))
register("cat46_case_flag_without_letters", r"""
SELECT rule_id, pattern FROM patterns WHERE ctype = 'string' AND how <> 'regex' AND case_insensitive AND NOT regexp_matches(pattern, '\pL')""", "patterns",
         lambda a, c, k: C.case_flag_without_letters(a))
register("cat47_short_ignoring_case", r"""
SELECT rule_id, pattern FROM patterns WHERE ctype IN ('string', 'raw') AND how <> 'regex' AND case_insensitive AND regexp_matches(pattern, '^\pL+$')
  AND (strlen(pattern) <= 3 OR (strlen(pattern) = 4 AND len(string_split(types, ',')) > 2))""", "patterns", lambda a, c, k: C.short_ignoring_case(a))
register("cat48_empty_patterns", "SELECT rule_id, how FROM patterns WHERE ctype IN ('string', 'raw', 'symbol') AND trim(pattern) = ''", "patterns", lambda a, c, k: C.empty_patterns(a))
register("cat49_short_patterns", """
SELECT rule_id, how, pattern FROM patterns WHERE (ctype = 'symbol' OR (ctype = 'string' AND NOT case_insensitive))
  AND strlen(pattern) < CASE how WHEN 'exact' THEN 2 WHEN 'substr' THEN 3 WHEN 'word' THEN 2 ELSE 0 END""", "patterns", lambda a, c, k: C.overly_short_patterns(a))
register("cat50_literal_regexes", r"""
SELECT rule_id, pattern FROM patterns WHERE ctype IN ('string', 'raw', 'symbol') AND how = 'regex' AND NOT regexp_matches(pattern, '[.*+?^$()\[\]{}|\\]')""", "patterns",
         lambda a, c, k: C.literal_regexes(a))
register("cat51_word_edge_regexes", r"""
SELECT rule_id, pattern FROM patterns WHERE ctype IN ('string', 'raw') AND how = 'regex' AND regexp_matches(pattern, '^\\b[\pL0-9_-]+\\b$')""", "patterns",
         lambda a, c, k: C.word_edge_regexes(a))
register("cat52_internal_references", """
SELECT rule_id, ref_id FROM conds WHERE clause IN ('all', 'any', 'none') AND starts_with(ref_id, 'metadata/internal/')""", "conds", lambda a, c, k: C.internal_references(k))
register("cat53_idle_composites", """
SELECT s.rule_id, s.ref_id FROM singles s JOIN composite c USING (rule_id) JOIN atomic a ON s.ref_id = a.rule_id WHERE c.crit = a.crit AND c.types = a.types""",
         "singles composite atomic", lambda a, c, k: C.idle_composites(c, k, a))

# -- precision ---------------------------------------------------------------------------------

_len5 = lambda x: f"coalesce(ceil(length({x}) / 5.0) * 0.3, 0)"
_list5 = lambda col, skip: f"coalesce(list_sum(list_transform(list_filter(string_split({col}, ','), lambda x: x <> '{skip}'), lambda x: ceil(length(x) / 5.0) * 0.3)), 0)"
view("cond_scores", f"""
SELECT rule_id, CASE WHEN ctype = 'trait' THEN {_len5('ref_id')} WHEN ctype = 'metrics' THEN {_len5('metric_field')} ELSE
  ({_len5('exact')} + {_len5('substr')} + coalesce(ceil(length(replace(regex, chr(92), '')) / 5.0) * 0.3, 0) + coalesce(ceil((length(word) + 2) / 5.0) * 0.3, 0))
  * CASE WHEN case_insensitive AND ctype IN ('string', 'raw', 'basename') THEN 0.25 ELSE 1 END END AS score FROM atomic""", "atomic")
view("atomic_precision", f"""
SELECT rule_id, 1.0 + 0.3 * ((size_min IS NOT NULL)::INT + (size_max IS NOT NULL)::INT + (n_not IS NOT NULL)::INT + (n_unless IS NOT NULL)::INT + has_downgrade::INT)
  + {_list5('types', 'all')} + {_list5('platforms', 'all')} + score AS precision FROM atomic JOIN cond_scores USING (rule_id)""", "atomic", "cond_scores")


@query("agg27_condition_score", "SELECT rule_id, CAST(round(score, 4) AS DOUBLE) AS score FROM cond_scores", "cond_scores")
def condition_score(spark, sf_dir):
    return rounded(T.atomic_rules(spark, sf_dir).select("rule_id", P.condition_score().alias("score")), 4)


@query("agg26_atomic_precision", "SELECT rule_id, CAST(round(precision, 4) AS DOUBLE) AS precision FROM atomic_precision", "atomic_precision")
def atomic_precision(spark, sf_dir):
    return rounded(P.atomic_precision(T.atomic_rules(spark, sf_dir)), 4)


# Composites in four levels: orders refer to parts, and three of four to the order before.
view("nested_conds", f"""
SELECT rule_id, clause, idx, ref_id FROM conds
UNION ALL SELECT {T.choose(T.O, T.DIRECTORIES)} || '::c' || o_orderkey, 'all', -1, {T.choose('(o_orderkey - 1)', T.DIRECTORIES)} || '::c' || (o_orderkey - 1)
FROM orders WHERE o_orderkey % 4 <> 0""", "conds")


def nested_conds(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 4 != 0)
    extra = spark.sql(f"""
        SELECT {T.choose(T.O, T.DIRECTORIES)} || '::c' || o_orderkey AS rule_id, 'all' AS clause, CAST(-1 AS BIGINT) AS idx,
          {T.choose('(o_orderkey - 1)', T.DIRECTORIES)} || '::c' || (o_orderkey - 1) AS ref_id FROM {{o}}""", o=o)
    return T.composite_conds(spark, sf_dir).select("rule_id", "clause", "idx", "ref_id").unionByName(extra)


def _level(name: str, known: str) -> str:
    return f"""
SELECT rule_id, coalesce(types5, 0) + coalesce(sum(v) FILTER (WHERE clause = 'all'), 0)
  + coalesce(sum(v) FILTER (WHERE clause = 'any' AND rn <= greatest(coalesce(needs, 1), 1)), 0)
  + CASE WHEN bool_or(clause = 'none') THEN 0.3 + sum(v) FILTER (WHERE clause = 'none') ELSE 0 END
  + CASE WHEN bool_or(clause = 'unless') THEN 0.3 + min(v) FILTER (WHERE clause = 'unless') ELSE 0 END AS precision
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, clause ORDER BY v) AS rn FROM (
  SELECT c.rule_id, c.needs, {_list5('c.types', 'all')} AS types5, k.clause, CASE WHEN k.clause IS NULL THEN NULL WHEN k.ref_id IS NULL THEN 0 ELSE coalesce(p.precision, 1.0) END AS v
  FROM composite c LEFT JOIN nested_conds k USING (rule_id) LEFT JOIN ({known}) p ON p.rule_id = k.ref_id)) GROUP BY rule_id, types5"""


view("precision1", _level("precision1", "SELECT rule_id, precision FROM atomic_precision"), "composite", "nested_conds", "atomic_precision")
for _n in (2, 3, 4, 5):  # the fifth changes nothing any more
    view(f"precision{_n}", _level(f"precision{_n}", f"SELECT rule_id, precision FROM atomic_precision UNION ALL SELECT rule_id, precision FROM precision{_n - 1}"),
         "composite", "nested_conds", "atomic_precision", f"precision{_n - 1}")


@query("agg28_composite_precision", "SELECT rule_id, CAST(round(precision, 4) AS DOUBLE) AS precision FROM precision5", "precision5")
def composite_precision(spark, sf_dir):
    known = P.atomic_precision(T.atomic_rules(spark, sf_dir))
    return rounded(P.composite_precision(T.composites(spark, sf_dir), nested_conds(spark, sf_dir), known), 4)


@query("agg29_criticality_correction", """
SELECT rule_id, crit, CASE WHEN crit = 3 AND round(precision, 4) < 3.5 THEN 2 WHEN crit = 2 AND round(precision, 4) < 2.0 THEN 1 ELSE crit END AS corrected
FROM composite JOIN precision5 USING (rule_id)""", "composite precision5")
def criticality_correction(spark, sf_dir):
    rules = T.composites(spark, sf_dir)
    return P.corrected(rules.join(composite_precision(spark, sf_dir), "rule_id")).select("rule_id", "crit", "corrected")

# Circles of four orders, every tenth four of them, and the rules behind them.
view("circle_conds", f"""
SELECT rule_id, clause, idx, ref_id, FALSE AS inside FROM conds
UNION ALL SELECT {T.choose(T.O, T.DIRECTORIES)} || '::c' || o_orderkey, 'all', -1, {T.choose('(o_orderkey - 1)', T.DIRECTORIES)} || '::c' || (o_orderkey - 1), o_orderkey % 40 IN (1, 2, 3)
FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 40 = 4
UNION ALL SELECT {T.choose(T.O, T.DIRECTORIES)} || '::c' || o_orderkey, 'any', -2, {T.choose('(o_orderkey + 3)', T.DIRECTORIES)} || '::c' || (o_orderkey + 3), TRUE
FROM orders WHERE o_orderkey % 40 = 0""", "conds")


def circle_conds(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    name = lambda key: f"{T.choose(key, T.DIRECTORIES)} || '::c' || {key}"
    extra = spark.sql(f"""
        SELECT {name('o_orderkey')} AS rule_id, 'all' AS clause, CAST(-1 AS BIGINT) AS idx, {name('(o_orderkey - 1)')} AS ref_id
        FROM {{o}} WHERE o_orderkey % 4 <> 0 OR o_orderkey % 40 = 4
        UNION ALL SELECT {name('o_orderkey')}, 'any', CAST(-2 AS BIGINT), {name('(o_orderkey + 3)')} FROM {{o}} WHERE o_orderkey % 40 = 0""", o=o)
    return T.composite_conds(spark, sf_dir).select("rule_id", "clause", "idx", "ref_id").unionByName(extra)


for _n in range(1, 9):  # circles, three rules of the next four, and one more that changes nothing
    _known = "SELECT rule_id, precision FROM atomic_precision" + (f" UNION ALL SELECT rule_id, precision FROM circle_precision{_n - 1}" if _n > 1 else "")
    _body = _level("", _known).replace("nested_conds", "circle_conds").replace("WHEN k.ref_id IS NULL THEN 0 ELSE", "WHEN k.ref_id IS NULL THEN 0 WHEN k.inside THEN 1.0 ELSE")
    view(f"circle_precision{_n}", _body, "composite", "circle_conds", "atomic_precision", *([f"circle_precision{_n - 1}"] if _n > 1 else []))


@query("agg28_precision_circles", "SELECT rule_id, CAST(round(precision, 4) AS DOUBLE) AS precision FROM circle_precision8", "circle_precision8")
def precision_circles(spark, sf_dir):
    """As agg28_composite_precision, with rules that refer to each other in a circle and rules behind them."""
    known = P.atomic_precision(T.atomic_rules(spark, sf_dir))
    return rounded(P.composite_precision(T.composites(spark, sf_dir), circle_conds(spark, sf_dir), known), 4)


@query("agg29_correction_circles", """
SELECT rule_id, crit, CASE WHEN crit = 3 AND round(precision, 4) < 3.5 THEN 2 WHEN crit = 2 AND round(precision, 4) < 2.0 THEN 1 ELSE crit END AS corrected
FROM composite JOIN circle_precision8 USING (rule_id)""", "composite circle_precision8")
def correction_circles(spark, sf_dir):
    return P.corrected(T.composites(spark, sf_dir).join(precision_circles(spark, sf_dir), "rule_id")).select("rule_id", "crit", "corrected")


@query("agg30_sum_weakest", """
SELECT rule_id, CAST(round(sum(precision), 4) AS DOUBLE) AS weakest FROM (
  SELECT k.rule_id, p.precision, row_number() OVER (PARTITION BY k.rule_id ORDER BY p.precision) AS rn FROM conds k JOIN atomic_precision p ON p.rule_id = k.ref_id WHERE clause = 'any') WHERE rn <= 2 GROUP BY 1""",
       "conds atomic_precision")
def sum_weakest(spark, sf_dir):
    known = P.atomic_precision(T.atomic_rules(spark, sf_dir)).withColumnRenamed("rule_id", "ref_id")
    rows = T.composite_conds(spark, sf_dir).filter("clause = 'any'").join(known, "ref_id")
    return rounded(rows.groupBy("rule_id").agg(P.sum_of_weakest(F.collect_list("precision"), F.lit(2)).alias("weakest")), 4)
