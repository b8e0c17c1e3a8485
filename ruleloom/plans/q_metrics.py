"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.operators import extract, metrics as M
from ruleloom.plans.q_extract import any_like, commented
from ruleloom.plans.q_predicates import token_strings
from ruleloom.plans.registry import query, view
from ruleloom.plans.tables import files, functions, pick, sql_pick, sql_text, symbols
from ruleloom.session import local_table
from ruleloom.sources.tables import read_table

# Last lines that hold what the documents lack.
TAILS = (
    "plain end", "\tindented\n  spaced ", "esc \\x41\\x4g \\u00e9 \\101 more text here", "run aaaaaaaaaaaa and ----------- end",
    "====================++====", "| " + "x" * 120 + " |", "nb\u00a0sp\u2003wide\u3000end", "ctl \x01\x02 del \x7f end",
    "trail \n\n \t\n12345 99999", "\\U0001F600 follow up text \\7", "a/b/c=d-e_f.g*h#i+j|k\\l", "end\r\nwith crlf\r\n",
)


def odd_files(spark, sf_dir):
    doc = files(spark, sf_dir).select("file_id", "text")
    return doc.select("file_id", F.concat("text", F.lit("\n"), pick(F.col("file_id"), TAILS)).alias("text"))


view("odd_files", f"SELECT file_id, text || chr(10) || {sql_pick('file_id', TAILS)} AS text FROM files", "files")
view("odd_lines", r"""
SELECT file_id, unnest(regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n')) AS line FROM odd_files""", "odd_files")
view("odd_chars", """
SELECT file_id, ch, count(*) AS n FROM (SELECT file_id, unnest(string_split(text, '')) AS ch FROM odd_files) GROUP BY 1, 2""", "odd_files")


def rounded(df, digits=6):
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def family(spark, sf_dir, build):
    text = F.col("text")
    return rounded(M.prepared(odd_files(spark, sf_dir)).select("file_id", *[c.alias(n) for n, c in build(text).items()]))


SQL_TRIM = "trim(line, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12) || chr(133) || chr(160))"
ART_SQL = r"[=\-*#+|/\\_.]"


@query("met1_text_lines", rf"""
SELECT file_id, count(*) AS total_lines, round(avg(strlen(line)), 6) AS avg_line_length, CAST(max(strlen(line)) AS BIGINT) AS max_line_length,
  round(stddev_pop(strlen(line)), 6) AS line_length_stddev, count(*) FILTER (WHERE strlen(line) > 200) AS lines_over_200,
  count(*) FILTER (WHERE strlen(line) > 500) AS lines_over_500, count(*) FILTER (WHERE strlen(line) > 1000) AS lines_over_1000,
  round(count(*) FILTER (WHERE {SQL_TRIM} = '') / count(*), 6) AS empty_line_ratio,
  count(*) FILTER (WHERE regexp_matches(line, '[\t\r \x{{A0}}\x{{3000}}]$')) AS trailing_whitespace_lines,
  count(*) FILTER (WHERE strlen({SQL_TRIM}) >= 20 AND len(regexp_extract_all({SQL_TRIM}, '{ART_SQL}')) / strlen({SQL_TRIM}) > 0.7) AS ascii_art_lines
FROM odd_lines GROUP BY 1""", "odd_lines")
def text_lines(spark, sf_dir):
    return family(spark, sf_dir, M.line_metrics)


SPACE_SQL = r"'^[\t\n\r \x{A0}\x{2003}\x{3000}]$'"


@query("met2_char_distribution", f"""
SELECT c.file_id, round(-sum(n / t * log2(n / t)), 6) AS char_entropy, count(*) AS unique_chars,
  arg_min(ch, (-n, ch)) FILTER (WHERE NOT regexp_matches(ch, {SPACE_SQL})) AS most_common_char,
  round(max(n) FILTER (WHERE NOT regexp_matches(ch, {SPACE_SQL})) / any_value(t), 6) AS most_common_ratio
FROM odd_chars c JOIN (SELECT file_id, sum(n) AS t FROM odd_chars GROUP BY 1) USING (file_id) GROUP BY 1""", "odd_chars")
def char_distribution(spark, sf_dir):
    return family(spark, sf_dir, M.char_metrics)


@query("met3_byte_ratios", r"""
SELECT file_id, round((strlen(text) - len(regexp_extract_all(text, '[\x00-\x7F]'))) / strlen(text), 6) AS non_ascii_ratio,
  round(len(regexp_extract_all(text, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]')) / strlen(text), 6) AS non_printable_ratio, CAST(0 AS BIGINT) AS null_byte_count
FROM odd_files""", "odd_files")
def byte_ratios(spark, sf_dir):
    return family(spark, sf_dir, M.byte_metrics)


@query("met4_whitespace", r"""
SELECT file_id, round(len(regexp_extract_all(text, '[\t\n\r \x{A0}\x{2003}\x{3000}]')) / length(text), 6) AS whitespace_ratio,
  CAST(len(regexp_extract_all(text, '\t')) AS BIGINT) AS tab_count, CAST(len(regexp_extract_all(text, ' ')) AS BIGINT) AS space_count,
  regexp_matches(text, '(^|\n) *\t') AND regexp_matches(text, '(^|\n)\t* ') AS mixed_indent,
  CAST(len(regexp_extract_all(text, '[\x{A0}\x{2003}\x{3000}]')) AS BIGINT) AS unusual_whitespace FROM odd_files""", "odd_files")
def whitespace(spark, sf_dir):
    return family(spark, sf_dir, M.whitespace_metrics)


@query("met5_escapes", r"""
SELECT *, round((hex_escape_count + unicode_escape_count + octal_escape_count) * 100.0 / n, 6) AS escape_density FROM (
  SELECT file_id, CAST(len(regexp_extract_all(text, '\\x[0-9a-fA-F]{2}')) AS BIGINT) AS hex_escape_count,
    CAST(len(regexp_extract_all(text, '\\u|\\U')) AS BIGINT) AS unicode_escape_count,
    CAST(len(regexp_extract_all(text, '\\[0-7]')) AS BIGINT) AS octal_escape_count, strlen(text) AS n FROM odd_files)""".replace(
    "SELECT *, round", "SELECT file_id, hex_escape_count, unicode_escape_count, octal_escape_count, round"), "odd_files")
def escapes(spark, sf_dir):
    return family(spark, sf_dir, M.escape_metrics)


@query("met6_long_tokens", r"""
SELECT file_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: strlen(w) > 100)) AS BIGINT) AS long_token_count FROM odd_files""",
       "odd_files")
def long_tokens(spark, sf_dir):
    return family(spark, sf_dir, M.run_metrics).select("file_id", "long_token_count")


@query("met7_repeated_runs", """
SELECT file_id, count(*) FILTER (WHERE run >= 10) AS repeated_char_sequences FROM (
  SELECT file_id, count(*) AS run FROM (
    SELECT file_id, ch, i - row_number() OVER (PARTITION BY file_id, ch ORDER BY i) AS island FROM (
      SELECT file_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM (SELECT file_id, string_split(text, '') AS cs FROM odd_files)))
  GROUP BY file_id, ch, island) GROUP BY 1""", "odd_files")
def repeated_runs(spark, sf_dir):
    return family(spark, sf_dir, M.run_metrics).select("file_id", "repeated_char_sequences")


@query("met8_digit_ratio", """
SELECT file_id, coalesce(round(len(regexp_extract_all(text, '[0-9]')) / nullif(len(regexp_extract_all(text, '[0-9A-Za-z]')), 0), 6), 0) AS digit_ratio
FROM odd_files""", "odd_files")
def digit_ratio(spark, sf_dir):
    return family(spark, sf_dir, M.run_metrics).select("file_id", "digit_ratio")


@query("met9_banner_lines", f"""
SELECT file_id, count(*) FILTER (WHERE strlen({SQL_TRIM}) >= 20 AND len(regexp_extract_all({SQL_TRIM}, '{ART_SQL}')) / strlen({SQL_TRIM}) > 0.7) AS ascii_art_lines
FROM odd_lines GROUP BY 1""", "odd_lines")
def banner_lines(spark, sf_dir):
    return family(spark, sf_dir, M.line_metrics).select("file_id", "ascii_art_lines")


# -- strings ---------------------------------------------------------------------------------

MIXED = (
    "QUJDREVGR0hJSktMTU5PUA==", "deadbeefcafe00", "0xDEADBEEF", "a%20b%2Fc%3Dd%26e", "\\u0041\\u0042&#x43;&#x44;", "http://x.example/y",
    "WSS://x.example", "/etc/passwd", "C:/x", "10.1.2.3", "fe80:0:0:1", "me@x.example", "sub.domain.org", "eval(x); function () {}",
    "curl http://a | sh", "SELECT a FROM b WHERE 1=1", "", "plain", "~/.ssh", "//host/share", "a@b", "300.1.1.1",
)


def string_facts(spark, sf_dir):
    """Tokens of the documents plus one string of each class."""
    doc = files(spark, sf_dir).select("file_id", T.tokens(F.col("text")).alias("tokens"))
    extra = F.array(*[pick(F.col("file_id") + i, MIXED) for i in range(4)])
    return doc.select("file_id", F.explode(F.concat("tokens", extra)).alias("value"))


view("string_rows", "SELECT file_id, value FROM doc_tokens UNION ALL " + " UNION ALL ".join(
    f"SELECT file_id, {sql_pick(f'(file_id + {i})', MIXED)} FROM files" for i in range(4)), "doc_tokens", "files")
view("entropies", """
SELECT value, -sum(n / t * log2(n / t)) AS e FROM (
  SELECT value, ch, count(*) AS n, any_value(length(value)) AS t FROM (SELECT value, unnest(string_split(value, '')) AS ch
    FROM (SELECT DISTINCT value FROM string_rows WHERE value <> '')) GROUP BY 1, 2) GROUP BY 1""", "string_rows")
OCTET = r"\+?0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SQL_CLASS = {
    "base64_candidates": "strlen(value) >= 16 AND strlen(value) % 4 = 0 AND regexp_matches(value, '^[A-Za-z0-9+/=]+$') AND regexp_matches(value, '[A-Z]') "
                         "AND regexp_matches(value, '[a-z]') AND (NOT contains(value, '=') OR ends_with(value, '='))",
    "hex_strings": "strlen(value) >= 8 AND strlen(value) % 2 = 0 AND regexp_matches(value, '^(0[xX])?[0-9a-fA-F]*$')",
    "url_encoded_strings": "len(regexp_extract_all(value, '%[0-9a-fA-F]{2}')) > 3",
    "unicode_heavy_strings": r"len(regexp_extract_all(value, '\\u')) + len(regexp_extract_all(value, '\\x')) + len(regexp_extract_all(value, '&#x')) + len(regexp_extract_all(value, '&#')) >= 5",
    "url_count": "regexp_matches(lower(value), '^(https?|ftp|file|wss?)://')",
    "path_count": r"(value LIKE '/_%' AND NOT value LIKE '//%') OR regexp_matches(value, '^[A-Za-z]:[\\/]') OR regexp_matches(value, '^(\./|\.\./|~)|/bin/|/etc/|/tmp/|/var/|\\Windows\\|\\System32\\|\\AppData\\')",
    "ip_count": rf"regexp_matches(value, '^({OCTET}\.){{3}}{OCTET}$') OR (regexp_matches(value, '^[0-9a-fA-F:]+$') AND len(string_split(value, ':')) BETWEEN 3 AND 8)",
    "email_count": r"strlen(value) >= 5 AND regexp_matches(value, '^[^@]+@[^@.][^@]*$') AND contains(split_part(value, '@', 2), '.') AND NOT ends_with(value, '.')",
    "domain_count": "regexp_matches(value, '^[A-Za-z0-9.-]+$') AND regexp_matches(lower(value), '(" + "|".join(t.replace(".", "\\.") for t in K.DOMAIN_TLDS) + ")$')",
    "embedded_code_candidates": any_like("lower(value)", K.EMBEDDED_CODE_MARKERS),
    "shell_command_strings": any_like("lower(value)", K.SHELL_MARKERS),
    "sql_strings": "(" + " + ".join(f"contains(upper(value), {sql_text(p)})::INT" for p in K.SQL_MARKERS) + ") >= 2",
}
view("string_metrics", f"""
SELECT file_id, count(*) AS total, CAST(sum(strlen(value)) AS BIGINT) AS total_bytes, round(avg(strlen(value)), 6) AS avg_length,
  CAST(max(strlen(value)) AS BIGINT) AS max_length, count(*) FILTER (WHERE value = '') AS empty_count, round(coalesce(avg(e), 0), 6) AS avg_entropy,
  round(coalesce(stddev_pop(e), 0), 6) AS entropy_stddev, count(*) FILTER (WHERE e > 5) AS high_entropy_count, count(*) FILTER (WHERE e > 6.5) AS very_high_entropy_count,
  count(*) FILTER (WHERE strlen(value) > 1000) AS very_long_strings,
  {', '.join(f"count(*) FILTER (WHERE value <> '' AND ({t})) AS {n}" for n, t in SQL_CLASS.items())}
FROM string_rows LEFT JOIN entropies USING (value) GROUP BY 1""", "string_rows", "entropies")


@query("met10_string_metrics", "SELECT * FROM string_metrics", "string_metrics")
def string_metrics(spark, sf_dir):
    return rounded(M.string_metrics(string_facts(spark, sf_dir)))


@query("met11_string_entropy", "SELECT value, round(e, 6) AS entropy FROM entropies", "entropies")
def string_entropy(spark, sf_dir):
    values = string_facts(spark, sf_dir).select("value").filter(F.col("value") != "").distinct()
    return rounded(M.string_entropy(values))


def class_query(names):
    body = ", ".join(f"count(*) FILTER (WHERE {SQL_CLASS[n]}) AS {n}" for n in names)
    return f"SELECT value, {body} FROM string_rows GROUP BY 1 HAVING {' OR '.join(f'({SQL_CLASS[n]})' for n in names)}"


def class_counts(spark, sf_dir, names):
    values = string_facts(spark, sf_dir).select("value")
    flagged = M.string_class_flags(values).filter(T.any_of(F.col(n) for n in names))
    return flagged.groupBy("value").agg(*[F.count_if(F.col(n)).alias(n) for n in names])


ENCODED = ("base64_candidates", "hex_strings", "url_encoded_strings", "unicode_heavy_strings")
CONTENT = ("url_count", "path_count", "ip_count", "email_count", "domain_count")
SUSPECT = ("embedded_code_candidates", "shell_command_strings", "sql_strings")


@query("met12_encoded_classes", class_query(ENCODED), "string_rows")
def encoded_classes(spark, sf_dir):
    return class_counts(spark, sf_dir, ENCODED)


@query("met13_content_classes", class_query(CONTENT), "string_rows")
def content_classes(spark, sf_dir):
    return class_counts(spark, sf_dir, CONTENT)


@query("met14_suspicious_classes", class_query(SUSPECT), "string_rows")
def suspicious_classes(spark, sf_dir):
    return class_counts(spark, sf_dir, SUSPECT)


# -- identifiers ------------------------------------------------------------------------------

NAMES = ("x", "i1", "tmp3", "__init__", "MAX_SIZE", "qwertyUiop", "deadbeef", "aB3dE5fG7h", "aaaa", "camelCase9", "_private", "foo", "foo")


def name_lists(spark, sf_dir):
    doc = files(spark, sf_dir).select("file_id", F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)).alias("words"))
    return doc.select("file_id", F.concat("words", F.array(*[pick(F.col("file_id") + i, NAMES) for i in range(5)])).alias("names"))


view("name_rows", "SELECT file_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM files UNION ALL " + " UNION ALL ".join(
    f"SELECT file_id, {sql_pick(f'(file_id + {i})', NAMES)} FROM files" for i in range(5)), "files")
view("name_entropies", """
SELECT name, -sum(n / t * log2(n / t)) AS e FROM (
  SELECT name, ch, count(*) AS n, any_value(length(name)) AS t FROM (SELECT name, unnest(string_split(name, '')) AS ch
    FROM (SELECT DISTINCT name FROM name_rows)) GROUP BY 1, 2) GROUP BY 1""", "name_rows")
SQL_NAME = {
    "single_char": "strlen(name) = 1", "all_lowercase": "regexp_matches(name, '^[a-z_]*$')", "all_uppercase": "regexp_matches(name, '^[A-Z_]*$')",
    "has_digit": "regexp_matches(name, '[0-9]')", "underscore_prefix": "starts_with(name, '_')",
    "double_underscore": "regexp_matches(name, '^__.+__$')", "numeric_suffix": "regexp_matches(name, '[A-Za-z].*[0-9]$')",
    "hex_like": "strlen(name) >= 6 AND strlen(name) % 2 = 0 AND len(regexp_extract_all(name, '[0-9a-fA-F]')) / strlen(name) > 0.9",
    "base64_like": "strlen(name) >= 8 AND len(regexp_extract_all(name, '[A-Za-z0-9+/=]')) / strlen(name) > 0.95 AND regexp_matches(name, '[A-Z]') "
                   "AND regexp_matches(name, '[a-z]') AND regexp_matches(name, '[0-9]')",
    "sequential": "regexp_matches(name, '^[A-Za-z][0-9]?$') OR regexp_matches(lower(name), '^(" + "|".join(K.COUNTER_STEMS) + ")[0-9]$')",
    "keyboard": any_like("lower(name)", K.KEYBOARD_RUNS),
    "repeated_char": "strlen(name) >= 3 AND len(list_distinct(string_split(name, ''))) = 1",
}
view("identifier_metrics", f"""
SELECT file_id, CAST(sum(c) AS BIGINT) AS total, count(*) AS unique_count, round(count(*) / sum(c), 6) AS reuse_ratio, round(avg(strlen(name)), 6) AS avg_length,
  CAST(min(strlen(name)) AS BIGINT) AS min_length, CAST(max(strlen(name)) AS BIGINT) AS max_length, round(stddev_pop(strlen(name)), 6) AS length_stddev,
  round(avg(e), 6) AS avg_entropy, count(*) FILTER (WHERE e > 3.5) AS high_entropy_count,
  {', '.join(f"count(*) FILTER (WHERE {t}) AS {n}_count" for n, t in SQL_NAME.items())},
  {', '.join(f"round(count(*) FILTER (WHERE {SQL_NAME[n]}) / count(*), 6) AS {n}_ratio" for n in ("single_char", "all_lowercase", "all_uppercase", "has_digit"))}
FROM (SELECT file_id, name, count(*) AS c FROM name_rows GROUP BY 1, 2) JOIN name_entropies USING (name) GROUP BY 1""", "name_rows", "name_entropies")


@query("met15_identifier_metrics", "SELECT * FROM identifier_metrics", "identifier_metrics")
def identifier_metrics(spark, sf_dir):
    return rounded(M.identifier_metrics(name_lists(spark, sf_dir)))


# -- comments, functions, imports -------------------------------------------------------------------

NOTES = ("todo fix me", "HACK: xxx", "if (a) return b", "see https://x.example/y", "QUJDREVGR0hJSktMTU5PUHF4", "a much longer note with Many 0dd s1gns & marks!", "")


def noted(spark, sf_dir):
    """Documents with a commented line after each of their ends."""
    doc = files(spark, sf_dir).select("file_id", "text")
    notes = [F.concat(F.lit("\nx = 1 // "), pick(F.col("file_id") + i, NOTES)) for i in range(3)]
    return doc.select("file_id", F.concat("text", *notes).alias("text"))


view("noted", "SELECT file_id, text || " + " || ".join(
    f"chr(10) || 'x = 1 // ' || {sql_pick(f'(file_id + {i})', NOTES)}" for i in range(3)) + " AS text FROM files", "files")
view("noted_comments", f"""
SELECT file_id, n_lines, unnest(cs) AS c, generate_subscripts(cs, 1) AS idx FROM (
  SELECT file_id, len(string_split(text, chr(10))) AS n_lines, list_transform(list_filter(regexp_extract_all(text, {sql_text(extract.COMMENT_RE['c'])}),
    lambda h: regexp_matches(h, '^/[/*]')), lambda h: regexp_replace(regexp_replace(h, '^(//|/\\*)', ''), '\\*/$', '')) AS cs FROM noted)""", "noted")
view("note_entropies", """
SELECT t, -sum(n / l * log2(n / l)) AS e FROM (SELECT t, ch, count(*) AS n, any_value(length(t)) AS l FROM (
  SELECT t, unnest(string_split(t, '')) AS ch FROM (SELECT DISTINCT trim(c) AS t FROM noted_comments WHERE trim(c) <> '')) GROUP BY 1, 2) GROUP BY 1""", "noted_comments")
_code = " + ".join(f"contains(lower(t), {sql_text(p)})::INT" for p in K.COMMENT_CODE_MARKERS)
view("comment_metrics", f"""
SELECT f.file_id, count(c) AS total, coalesce(CAST(sum(len(string_split(c, chr(10))) - (c = '')::INT) AS BIGINT), 0) AS lines,
  coalesce(CAST(sum(strlen(c)) AS BIGINT), 0) AS chars,
  round(coalesce(CASE WHEN count(c) > 0 AND any_value(n_lines) > lines THEN lines / (any_value(n_lines) - lines) END, 0), 6) AS to_code_ratio,
  {', '.join(f"count(*) FILTER (WHERE contains(upper(t), '{w}')) AS {w.lower()}_count" for w in ("TODO", "FIXME", "HACK", "XXX"))},
  count(*) FILTER (WHERE t = '') AS empty_comments, count(*) FILTER (WHERE strlen(t) > 20 AND e > 4.5) AS high_entropy_comments,
  count(*) FILTER (WHERE t <> '' AND ({_code}) >= 2) AS code_in_comments, count(*) FILTER (WHERE regexp_matches(t, 'http://|https://|ftp://')) AS url_in_comments,
  count(*) FILTER (WHERE len(list_filter(string_split(t, ' '), lambda w: strlen(w) >= 20
    AND len(regexp_extract_all(w, '[A-Za-z0-9+/=]')) / strlen(w) > 0.9 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]'))) > 0) AS base64_in_comments
FROM files f LEFT JOIN (SELECT *, trim(c) AS t FROM noted_comments) USING (file_id) LEFT JOIN note_entropies USING (t) GROUP BY 1""",
     "files", "noted_comments", "note_entropies")


@query("met16_comment_metrics", "SELECT * FROM comment_metrics", "comment_metrics")
def comment_metrics(spark, sf_dir):
    return rounded(M.comment_metrics(noted(spark, sf_dir), "c"))


def order_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 2000).alias("total_lines"))


view("function_metrics", """
SELECT f.*, round(coalesce(total / nullif(n, 0), 0) * 100, 6) AS density_per_100_lines, round(coalesce(sum_lines / nullif(n, 0), 0), 6) AS code_in_functions_ratio
FROM (SELECT file_id, count(*) AS total, round(avg(line_count), 6) AS avg_length_lines, CAST(max(line_count) AS BIGINT) AS max_length_lines,
    CAST(min(line_count) AS BIGINT) AS min_length_lines, round(stddev_pop(line_count), 6) AS length_stddev, sum(line_count) AS sum_lines,
    count(*) FILTER (WHERE line_count > 100) AS over_100_lines, count(*) FILTER (WHERE line_count > 500) AS over_500_lines, count(*) FILTER (WHERE line_count <= 1) AS one_liners,
    count(*) FILTER (WHERE is_anonymous) AS anonymous, count(*) FILTER (WHERE is_async) AS async_count, count(*) FILTER (WHERE is_generator) AS generator_count, count(*) FILTER (WHERE contains_nested) AS nested_functions,
    round(avg(len(param_names)), 6) AS avg_params, CAST(max(len(param_names)) AS BIGINT) AS max_params, count(*) FILTER (WHERE len(param_names) = 0) AS no_params_count,
    count(*) FILTER (WHERE len(param_names) > 7) AS many_params_count,
    round(coalesce(sum(coalesce(list_sum(list_transform(param_names, lambda p: strlen(p))), 0)) / nullif(sum(len(param_names)), 0), 0), 6) AS avg_param_name_length,
    CAST(sum(len(list_filter(param_names, lambda p: strlen(p) = 1))) AS BIGINT) AS single_char_params,
    round(coalesce(avg(strlen(name)) FILTER (WHERE name <> ''), 0), 6) AS avg_name_length, count(*) FILTER (WHERE strlen(name) = 1) AS single_char_names,
    count(*) FILTER (WHERE name IN ('aZ93kQx7Lm2P')) AS high_entropy_names, count(*) FILTER (WHERE regexp_matches(name, '[A-Za-z].*[0-9]$')) AS numeric_suffix_names,
    CAST(max(nesting_depth) AS BIGINT) AS max_nesting_depth, round(avg(nesting_depth), 6) AS avg_nesting_depth FROM functions GROUP BY 1) f
JOIN (SELECT o_orderkey AS file_id, o_custkey % 2000 AS n FROM orders) USING (file_id)""", "functions")


@query("met17_function_metrics", "SELECT * EXCLUDE (sum_lines) FROM function_metrics", "function_metrics")
def function_metrics(spark, sf_dir):
    return rounded(M.function_metrics(functions(spark, sf_dir), order_lines(spark, sf_dir)))


MODULES = ("os.path", "json", ".local", "../up", "requests", "importlib.util", "x.*", "a as b", "re", "numpy")


def module_rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file_id"), pick(F.col("l_orderkey"), ("python", "ruby")).alias("file_type"),
        pick(F.col("l_partkey"), MODULES).alias("symbol"), F.when(F.col("l_suppkey") % 4 == 0, F.lit("lib")).alias("library"),
    )


_std = ", ".join(sql_text(m) for m in K.PYTHON_STDLIB)
view("import_metrics", f"""
SELECT *, round(stdlib_count / total, 6) AS stdlib_ratio, round(third_party_count / total, 6) AS third_party_ratio, round(relative_imports / total, 6) AS relative_ratio
FROM (SELECT file_id, count(*) AS total, count(DISTINCT symbol) AS unique_modules, count(*) FILTER (WHERE std) AS stdlib_count, count(*) FILTER (WHERE NOT std) AS third_party_count,
    count(*) FILTER (WHERE starts_with(symbol, '.')) AS relative_imports, count(*) FILTER (WHERE regexp_matches(symbol, '__import__|importlib|require')) AS dynamic_imports,
    count(*) FILTER (WHERE contains(symbol, '*')) AS wildcard_imports, count(*) FILTER (WHERE lib OR contains(symbol, ' as ')) AS aliased_imports
  FROM (SELECT *, ft = 'python' AND split_part(symbol, '.', 1) IN ({_std}) AS std FROM (
    SELECT l_orderkey AS file_id, {sql_pick('l_orderkey', ('python', 'ruby'))} AS ft, {sql_pick('l_partkey', MODULES)} AS symbol, l_suppkey % 4 = 0 AS lib FROM lineitem))
  GROUP BY 1)""")


def stdlib(spark):
    return local_table(spark, [("python", m) for m in K.PYTHON_STDLIB], "file_type string, module string")


@query("met18_import_metrics", "SELECT * FROM import_metrics", "import_metrics")
def import_metrics(spark, sf_dir):
    return rounded(M.import_metrics(module_rows(spark, sf_dir), stdlib(spark)))


@query("met19_ratio_metrics", """
SELECT d.file_id, round(coalesce(s.total / nullif(f.total, 0), 0), 6) AS strings_to_functions_ratio,
  round(coalesce(i.unique_count / nullif(f.total, 0), 0), 6) AS identifiers_to_functions_ratio, round(coalesce(m.total / nullif(f.total, 0), 0), 6) AS imports_to_functions_ratio,
  round(i.total / d.n, 6) AS identifier_density, round(s.total / d.n, 6) AS string_density, round(coalesce(m.total, 0) * 100.0 / d.n, 6) AS import_density,
  round(coalesce(f.total, 0) / sqrt(d.n), 6) AS normalized_function_count, round(coalesce(m.total, 0) / sqrt(d.n), 6) AS normalized_import_count,
  round(s.total / sqrt(d.n), 6) AS normalized_string_count, round(coalesce(i.unique_count / nullif(log2(d.n), 0), 0), 6) AS normalized_unique_identifiers,
  round((i.hex_like_count + i.base64_like_count + i.sequential_count + i.keyboard_count + i.repeated_char_count) / i.unique_count, 6) AS suspicious_identifier_ratio,
  round((s.base64_candidates + s.hex_strings + s.url_encoded_strings) / s.total, 6) AS encoded_string_ratio,
  round((s.embedded_code_candidates + s.shell_command_strings + s.sql_strings) / s.total, 6) AS suspicious_string_ratio,
  round(coalesce((c.high_entropy_comments + c.base64_in_comments) / nullif(c.total, 0), 0), 6) AS suspicious_comment_ratio,
  round(coalesce(m.dynamic_imports / nullif(m.total, 0), 0), 6) AS dynamic_import_ratio, round(coalesce(f.anonymous / nullif(f.total, 0), 0), 6) AS anonymous_function_ratio
FROM (SELECT file_id, count(*) AS n FROM odd_lines GROUP BY 1) d JOIN string_metrics s USING (file_id) JOIN identifier_metrics i USING (file_id)
JOIN comment_metrics c USING (file_id) LEFT JOIN function_metrics f USING (file_id) LEFT JOIN import_metrics m USING (file_id)""",
       "odd_lines string_metrics identifier_metrics comment_metrics function_metrics import_metrics")
def ratio_metrics(spark, sf_dir):
    text = odd_files(spark, sf_dir).select("file_id", F.size(T.text_lines(F.col("text"))).alias("total_lines"))
    out = M.ratio_metrics(
        text, M.string_metrics(string_facts(spark, sf_dir)), M.identifier_metrics(name_lists(spark, sf_dir)),
        M.comment_metrics(noted(spark, sf_dir), "c"), M.function_metrics(functions(spark, sf_dir), order_lines(spark, sf_dir)),
        M.import_metrics(module_rows(spark, sf_dir), stdlib(spark)),
    )
    return rounded(out)


# -- entropy and long form ---------------------------------------------------------------------------

view("byte_entropy", """
SELECT file_id, -sum(n / t * log2(n / t)) AS e FROM (
  SELECT file_id, b, count(*) AS n, any_value(size) AS t FROM (
    SELECT page_id AS file_id, strlen(html) AS size, unnest(regexp_extract_all(hex(encode(html)), '..')) AS b FROM pages) GROUP BY 1, 2) GROUP BY 1""")


@query("met20_byte_entropy", "SELECT file_id, round(e, 6) AS entropy FROM byte_entropy", "byte_entropy")
def byte_entropy(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return rounded(pages.select(F.col("page_id").alias("file_id"), M.byte_entropy(F.col("html").cast("binary")).alias("entropy")))


@query("met21_entropy_level", """
SELECT l_orderkey AS file_id, l_linenumber, CASE WHEN l_tax * 100 < 4 THEN 'very_low' WHEN l_tax * 100 < 6 THEN 'normal' WHEN l_tax * 100 < 7.2 THEN 'elevated' ELSE 'high' END AS level
FROM lineitem""")
def entropy_level(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), "l_linenumber", T.entropy_level(F.col("l_tax") * 100).alias("level")
    )


@query("met22_metric_by_name", """
SELECT file_id, 'text.mixed_indent' AS field, (regexp_matches(text, '(^|\\n) *\\t') AND regexp_matches(text, '(^|\\n)\\t* '))::DOUBLE AS value FROM odd_files""",
       "odd_files")
def metric_by_name(spark, sf_dir):
    wide = family(spark, sf_dir, M.whitespace_metrics)
    return extract.metric_value(extract.flatten_metrics(wide, "text"), "text.mixed_indent")


@query("ext6_flatten_metrics", """
SELECT file_id, 'functions.' || field AS field, value FROM (
  UNPIVOT (SELECT file_id, total::DOUBLE AS total, avg_length_lines, anonymous::DOUBLE AS anonymous, NULL::DOUBLE AS missing FROM function_metrics)
  ON total, avg_length_lines, anonymous, missing INTO NAME field VALUE value)""", "function_metrics")
def flatten_metrics(spark, sf_dir):
    wide = function_metrics(spark, sf_dir).select("file_id", "total", "avg_length_lines", "anonymous", F.lit(None).cast("double").alias("missing"))
    return extract.flatten_metrics(wide, "functions")
