"""Rule condition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom.session import local_table
from ruleloom import constants as K
from ruleloom.functions import net, text as T
from ruleloom.operators import predicates as P
from ruleloom.plans.q_extract import ip_strings, payloads, q
from ruleloom.plans.q_sources import named_files
from ruleloom.plans.registry import query, view
from ruleloom.plans.tables import (
    entries, files, located, pick, sections, sql_list, sql_pick, symbols, syscalls,
)
from ruleloom.sources.tables import read_table


def token_strings(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.explode(T.tokens(F.col("text"))).alias("value"))


def sql_public(value: str) -> str:
    o = [f"CAST(split_part({value}, '.', {i}) AS INTEGER)" for i in range(1, 5)]
    a, b, c, d = o
    zeros = " + ".join(f"({x} = 0)::INT" for x in o)
    return f"""(greatest({', '.join(o)}) <= 255 AND NOT regexp_matches({value}, '(^|\\.)0[0-9]')
      AND {zeros} < 2 AND {a} NOT IN (10, 127) AND {a} BETWEEN 4 AND 223
      AND NOT ({a} = 172 AND {b} BETWEEN 16 AND 31) AND NOT ({a} = 192 AND {b} = 168)
      AND NOT ({a} = 169 AND {b} = 254) AND NOT ({a} = 192 AND {b} = 0 AND {c} = 2)
      AND NOT ({a} = 198 AND {b} = 51 AND {c} = 100) AND NOT ({a} = 203 AND {b} = 0 AND {c} = 113)
      AND NOT ({c} = 1 AND {d} = 1) AND NOT ({c} = 0 AND {d} IN (0, 1)))"""


def sql_has_public(value: str) -> str:
    return (f"coalesce(list_bool_or(list_transform(regexp_extract_all({value}, {q(K.IP_WORD_RE)}), "
            f"lambda z: {sql_public('z')})), FALSE)")


# -- strings, raw content, symbols ---------------------------------------------------------


@query("prd1_string_exact", "SELECT file_id, count(*) AS hits FROM doc_tokens WHERE value = 'token' GROUP BY 1", "doc_tokens")
def string_exact(spark, sf_dir):
    return P.string_evidence(token_strings(spark, sf_dir), exact="token").groupBy("file_id").agg(F.count("*").alias("hits"))


@query("prd1_string_regex_not", f"""
SELECT file_id, value, count(*) AS hits FROM doc_tokens
WHERE regexp_matches(value, {q(K.EMAIL_RE)}) AND NOT contains(lower(value), 'mail1.') AND lower(value) <> 'x@y.zz' GROUP BY ALL""",
       "doc_tokens")
def string_regex_not(spark, sf_dir):
    hits = P.string_evidence(
        token_strings(spark, sf_dir), regex=K.EMAIL_RE, exceptions=[{"substr": "MAIL1."}, {"exact": "x@y.zz"}]
    )
    return hits.groupBy("file_id", "value").agg(F.count("*").alias("hits"))


@query("prd1_string_facts_word", """
SELECT file_id, fact, count(*) AS hits FROM (
  SELECT file_id, 'string' AS fact, value FROM doc_tokens
  UNION ALL SELECT file_id, kind, regexp_replace(symbol, '^(sym\\.imp\\.)*(sym\\.)*(fcn\\.)*_*', '') FROM symbols WHERE kind IN ('import', 'export'))
WHERE regexp_matches(value, '(?i)\\bThe\\b|(?i)\\bsmall_ring\\b') GROUP BY ALL""", "doc_tokens symbols")
def string_facts_word(spark, sf_dir):
    """Strings, imports and exports are one set of facts for a string condition."""
    syms = symbols(spark, sf_dir).filter(F.col("kind").isin("import", "export"))
    facts = token_strings(spark, sf_dir).withColumn("fact", F.lit("string")).unionByName(
        syms.select("file_id", T.normalize_symbol(F.col("symbol")).alias("value"), F.col("kind").alias("fact"))
    )
    value = F.col("value")
    test = P.matcher(value, word="The", case_insensitive=True) | P.matcher(value, word="small_ring", case_insensitive=True)
    return facts.filter(test).groupBy("file_id", "fact").agg(F.count("*").alias("hits"))


@query("prd1_string_external_ip", f"""
SELECT file_id, value FROM doc_tokens WHERE {sql_has_public('value')}""", "doc_tokens")
def string_external_ip(spark, sf_dir):
    return P.string_evidence(token_strings(spark, sf_dir), external_ip=True)


@query("prd2_raw_literal", """
SELECT file_id, CAST((strlen(text) - strlen(replace(text, '###', ''))) / 3 AS BIGINT) AS hits FROM files
WHERE contains(text, '###')""", "files")
def raw_literal(spark, sf_dir):
    return P.raw_evidence(files(spark, sf_dir), substr="###").select("file_id", "hits")


@query("prd2_raw_regex", r"""
SELECT file_id, CAST(len(regexp_extract_all(text, '(?i)licen[sc]ed? under')) AS BIGINT) AS hits FROM files
WHERE regexp_matches(text, '(?i)licen[sc]ed? under')""", "files")
def raw_regex(spark, sf_dir):
    return P.raw_evidence(files(spark, sf_dir), regex="licen[sc]ed? under", case_insensitive=True).select("file_id", "hits")


@query("prd2_raw_exact", """
SELECT file_id, CAST(1 AS BIGINT) AS hits FROM files WHERE text = (SELECT min(text) FROM documents)""", "files")
def raw_exact(spark, sf_dir):
    wanted = read_table(spark, sf_dir, "documents").agg(F.min("text")).first()[0]
    return P.raw_evidence(files(spark, sf_dir), exact=wanted).select("file_id", "hits")


@query("prd3_symbol_match", """
SELECT file_id, symbol, count(*) AS hits FROM symbols
WHERE regexp_matches(regexp_replace(symbol, '^(sym\\.imp\\.)*(sym\\.)*(fcn\\.)*_*', ''), '^(red|blue)_[a-m]') AND NOT contains(lower(symbol), 'bolt')
GROUP BY ALL""", "symbols")
def symbol_match(spark, sf_dir):
    hits = P.symbol_evidence(symbols(spark, sf_dir), regex="^(red|blue)_[a-m]", exceptions=[{"substr": "BOLT"}])
    return hits.groupBy("file_id", "symbol").agg(F.count("*").alias("hits"))


@query("prd4_encoded", """
SELECT file_id, "offset" FROM payloads_sql WHERE contains(chain, 'hex') AND contains(value, 'import')""", "payloads_sql")
def encoded(spark, sf_dir):
    strings = payloads(spark, sf_dir).withColumnRenamed("chain", "encoding_chain")
    return P.encoded_evidence(strings, ["hex"], substr="import").select("file_id", "offset")


# -- structured values ------------------------------------------------------------------------

view("kv_docs", """
SELECT event_id AS file_id, '{"meta": {"kind": "' || event_type || '", "k": ' || json_extract_string(props, '$.k')
  || '}, "tags": ["' || event_type || '", "u' || (user_id % 10) || '"], "deps": [{"name": "d' || (user_id % 7) || '"}, {"name": "d'
  || (event_id % 5) || '"}]' || CASE WHEN event_id % 3 = 0 THEN ', "extra": {"a": 1, "b": 2}' ELSE '' END || '}' AS json,
  event_type, user_id FROM events""")


def kv_docs(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    s = lambda c: c.cast("string")
    user, event = F.col("user_id"), F.col("event_id")
    json = F.concat(
        F.lit('{"meta": {"kind": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"),
        F.lit('}, "tags": ["'), "event_type", F.lit('", "u'), s(user % 10), F.lit('"], "deps": [{"name": "d'),
        s(user % 7), F.lit('"}, {"name": "d'), s(event % 5), F.lit('"}]'),
        F.when(event % 3 == 0, ', "extra": {"a": 1, "b": 2}').otherwise(""), F.lit("}"),
    )
    return ev.select(event.alias("file_id"), json.alias("json"))


@query("prd5_kv_path", """
SELECT file_id FROM kv_docs WHERE json_extract_string(json, '$.meta.kind') = 'click'
  AND list_contains(json_extract_string(json, '$.deps[*].name'), 'd3')
  AND list_contains(json_extract_string(json, '$.tags[*]'), 'u' || (user_id % 10)) AND json_extract(json, '$.extra') IS NULL
  AND json_extract_string(json, '$.deps[0].name') <> 'd9'""", "kv_docs")
def kv_path(spark, sf_dir):
    j = F.col("json")
    return kv_docs(spark, sf_dir).filter(
        P.kv_test(j, "meta.kind", exact="CLICK", case_insensitive=True)
        & P.kv_test(j, "deps[*].name", exact="d3")
        & P.kv_test(j, "tags", regex="^u[0-9]$")
        & P.kv_test(j, "extra", exists=False)
        & ~P.kv_test(j, "deps[0].name", exact="d9")
    ).select("file_id")


@query("prd6_kv_size", """
SELECT file_id, CAST(json_array_length(json, '$.deps') AS BIGINT) AS n FROM kv_docs
WHERE file_id % 3 = 0 AND len(json_keys(json, '$.extra')) BETWEEN 2 AND 3""", "kv_docs")
def kv_size(spark, sf_dir):
    j = F.col("json")
    found = kv_docs(spark, sf_dir).filter(
        P.kv_test(j, "extra", size_min=2, size_max=3)
        & P.kv_test(j, "deps", size_min=1, size_max=2)
        & ~P.kv_test(j, "meta.k", size_min=0)
    )
    return found.select("file_id", P.kv_size(F.get_json_object("json", "$.deps")).cast("bigint").alias("n"))


@query("prd7_kv_navigate", """
SELECT file_id, unnest(json_extract_string(json, '$.deps[*].name')) AS value FROM kv_docs""", "kv_docs")
def kv_navigate(spark, sf_dir):
    return kv_docs(spark, sf_dir).select("file_id", F.explode(P.kv_values(F.col("json"), "deps[*].name")).alias("value"))


@query("prd8_basename", """
SELECT file_id, regexp_extract(path, '[^/]*$') AS basename FROM named_files
WHERE regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^(cargo|package)') OR path LIKE '%.whl'""", "named_files")
def basename(spark, sf_dir):
    named = named_files(spark, sf_dir).select("file_id", F.substring_index("path", "/", -1).alias("basename"))
    base = F.col("basename")
    return named.filter(
        P.matcher(base, regex="^(cargo|package)", case_insensitive=True) | P.matcher(base, substr=".whl")
    )


METRIC_BOUNDS = (("r_long", "text.size_bytes", 2000.0, 4000.0), ("r_lines", "text.total_lines", 10.0, None))


@query("prd9_metrics", """
SELECT file_id, 'r_long' AS rule_id, CAST(size_bytes AS DOUBLE) AS value FROM files WHERE size_bytes BETWEEN 2000 AND 4000
UNION ALL SELECT file_id, 'r_lines', CAST(count(*) AS DOUBLE) FROM doc_lines GROUP BY file_id HAVING count(*) >= 10""",
       "files doc_lines")
def metrics(spark, sf_dir):
    from ruleloom.operators.extract import flatten_metrics

    wide = files(spark, sf_dir).select("file_id", "size_bytes", F.size(T.text_lines(F.col("text"))).alias("total_lines"))
    bounds = local_table(spark, METRIC_BOUNDS, "rule_id string, field string, v_min double, v_max double")
    return P.metric_hits(flatten_metrics(wide, "text"), bounds).select("file_id", "rule_id", "value")


@query("prd10_hex", """
SELECT file_id FROM files WHERE regexp_matches(text, '(?s)[tT]he..?.?and')""", "files")
def hex_match(spark, sf_dir):
    doc = files(spark, sf_dir).select("file_id", F.col("text").cast("binary").alias("content"))
    upper = F.size(P.hex_hits(F.col("content"), "54 68 65 [1-3] 61 6E 64")) > 0
    lower = F.size(P.hex_hits(F.col("content"), "74 68 65 ?? [0-2] 61 6E 64")) > 0
    return doc.filter(upper | lower).select("file_id")


# -- sections, counts, combinations --------------------------------------------------------------


@query("prd11_section", """
SELECT file_id, name, size, permissions FROM sections
WHERE regexp_matches(name, 'text') AND size BETWEEN 5000 AND 40000 AND entropy >= 2 AND contains(permissions, 'r')
  AND NOT contains(permissions, 'w')""", "sections")
def section(spark, sf_dir):
    return P.section_evidence(
        sections(spark, sf_dir), regex="text", length_min=5000, length_max=40000, entropy_min=2.0, readable=True, writable=False
    ).select("file_id", "name", "size", "permissions")


@query("prd12_section_ratio", """
SELECT file_id, round(part / whole, 6) AS ratio FROM (
  SELECT file_id, sum(size) FILTER (WHERE name IN ('.text', '__text')) AS part, sum(size) AS whole FROM sections GROUP BY 1)
WHERE part / whole BETWEEN 0.3 AND 0.8""", "sections")
def section_ratio(spark, sf_dir):
    return P.section_ratio(sections(spark, sf_dir), "^(\\.text|__text)$", "total", 0.3, 0.8).select(
        "file_id", F.round("ratio", 6).alias("ratio")
    )


def symbol_files(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"))


@query("prd13_exports_count", """
SELECT file_id, count(symbol) AS n, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol), '') AS sample FROM (
  SELECT o_orderkey AS file_id, symbol FROM orders LEFT JOIN (SELECT * FROM symbols WHERE kind = 'export') s ON s.file_id = o_orderkey)
GROUP BY 1 HAVING count(symbol) <= 3""", "symbols")
def exports_count(spark, sf_dir):
    exports = symbols(spark, sf_dir).filter(F.col("kind") == "export")
    out = P.counted_per_file(symbol_files(spark, sf_dir), exports, "symbol", 0, 3)
    return out.select("file_id", "n", F.array_join("sample", ",").alias("sample"))


@query("prd14_string_count", """
SELECT f.file_id, count(value) AS n, coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE value IS NOT NULL)))[1:5], ','), '') AS sample
FROM files f LEFT JOIN (SELECT * FROM doc_tokens WHERE strlen(value) >= 18 AND regexp_matches(value, '^[a-z]+$')) t USING (file_id)
GROUP BY 1 HAVING count(value) BETWEEN 0 AND 6""", "files doc_tokens")
def string_count(spark, sf_dir):
    doc = files(spark, sf_dir)
    long = token_strings(spark, sf_dir).filter((F.octet_length("value") >= 18) & F.col("value").rlike("^[a-z]+$"))
    return P.counted_per_file(doc, long, "value", 0, 6).select("file_id", "n", F.array_join("sample", ",").alias("sample"))


@query("prd15_import_combination", """
SELECT file_id, count(*) AS total, CAST(sum(regexp_matches(symbol, 'widget')::INT + regexp_matches(symbol, '(ring|bolt)$')::INT) AS BIGINT) AS suspicious
FROM symbols WHERE kind = 'import' GROUP BY 1
HAVING bool_or(regexp_matches(symbol, '(red|blue)')) AND bool_or(regexp_matches(symbol, 'gear')) AND suspicious >= 1 AND total <= 6""", "symbols")
def import_combination(spark, sf_dir):
    wide = symbols(spark, sf_dir)
    return P.import_combination(wide, ["(red|blue)", "gear"], ["widget", "(ring|bolt)$"], min_suspicious=1, max_total=6)


@query("prd16_syscall", """
SELECT file_id, address, name FROM syscalls WHERE name IN ('click', 'error') AND number IN (3, 7, 42, 69)
  AND contains(lower(arch), 'arm')""", "syscalls")
def syscall(spark, sf_dir):
    return P.syscall_evidence(syscalls(spark, sf_dir), ["click", "error"], [3, 7, 42, 69], ["ARM"]).select("file_id", "address", "name")


FEATURES = ("binary/section/text", "binary/section", "binary/sections", "source/python", "binary/section/data")


@query("prd17_structure", f"""
SELECT file_id, count(*) AS n FROM (SELECT l_orderkey AS file_id, {sql_pick('l_partkey', FEATURES)} AS f FROM lineitem)
WHERE f = 'binary/section' OR starts_with(f, 'binary/section/') GROUP BY 1 HAVING count(*) >= 2""")
def structure(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    facts = li.select(F.col("l_orderkey").alias("file_id"), pick(F.col("l_partkey"), FEATURES).alias("feature_id"))
    return P.structure_evidence(facts, "binary/section", 2)


# -- gates, counts, exceptions, location ---------------------------------------------------------

GATE_PLATFORMS = ("linux", "macos,windows", "all", "unix,linux")
GATE_TYPES = ("en,fr", "all", "de", "es,en")


def gated(spark, sf_dir):
    """Documents with a rule each: platforms, types, sizes and count bounds by key."""
    key = F.col("file_id")
    hits = P.hit_count(F.col("text"), substr="the")
    return files(spark, sf_dir).select(
        "file_id", "file_type", "size_bytes", hits.alias("hits"),
        F.split(pick(key, GATE_PLATFORMS), ",").alias("platforms"),
        F.split(pick(F.floor(key / 3), GATE_TYPES), ",").alias("types"),
        F.when(key % 2 == 0, F.lit(600)).alias("size_min"),
        F.when(key % 3 == 0, F.lit(5000)).alias("size_max"),
        (key % 11 == 0).alias("unless_hit"),
        F.when(key % 4 == 0, F.lit(5)).alias("count_min"),
        F.when(key % 5 == 0, F.lit(4.0)).alias("per_kb_min"),
    )


view("gated", f"""
SELECT file_id, file_type, size_bytes, CAST((strlen(text) - strlen(replace(text, 'the', ''))) / 3 AS BIGINT) AS hits,
  string_split({sql_pick('file_id', GATE_PLATFORMS)}, ',') AS platforms,
  string_split({sql_pick('file_id // 3', GATE_TYPES)}, ',') AS types,
  CASE WHEN file_id % 2 = 0 THEN 600 END AS size_min, CASE WHEN file_id % 3 = 0 THEN 5000 END AS size_max,
  file_id % 11 = 0 AS unless_hit, CASE WHEN file_id % 4 = 0 THEN 5 END AS count_min,
  CASE WHEN file_id % 5 = 0 THEN 4.0 END AS per_kb_min FROM files""", "files")


@query("prd19_gates", """
SELECT file_id FROM gated WHERE (list_contains(platforms, 'all') OR list_has_any(platforms, ['linux', 'android']))
  AND (list_contains(types, 'all') OR list_contains(types, file_type))
  AND coalesce(size_bytes >= size_min, TRUE) AND coalesce(size_bytes <= size_max, TRUE)""", "gated")
def gates(spark, sf_dir):
    context = F.array(F.lit("linux"), F.lit("android"))
    return gated(spark, sf_dir).filter(
        P.platform_ok(F.col("platforms"), context)
        & (F.array_contains("types", "all") | F.array_contains(F.col("types"), F.col("file_type")))
        & P.size_ok(F.col("size_bytes"), F.col("size_min"), F.col("size_max"))
    ).select("file_id")


@query("prd20_count_density", """
SELECT file_id, hits FROM gated WHERE hits >= 3 AND hits <= 400 AND hits / (size_bytes / 1024.0) >= 2 AND hits / (size_bytes / 1024.0) <= 40""",
       "gated")
def count_density(spark, sf_dir):
    ok = P.density_ok(F.col("hits"), F.col("size_bytes"), 3, 400, 2.0, 40.0)
    return gated(spark, sf_dir).filter(ok).select("file_id", "hits")


@query("prd21_not_exceptions", """
SELECT value, count(*) AS n FROM doc_tokens WHERE starts_with(lower(value), 'the')
  AND lower(value) <> 'there' AND NOT contains(lower(value), 'tion') AND NOT regexp_matches(value, '[0-9.!#]') GROUP BY 1""", "doc_tokens")
def not_exceptions(spark, sf_dir):
    hits = P.string_evidence(
        token_strings(spark, sf_dir), regex="^(?i)the",
        exceptions=[{"exact": "THERE"}, {"substr": "TION"}, {"regex": "[0-9.!#]"}],
    )
    return hits.groupBy("value").agg(F.count("*").alias("n"))


@query("prd22_unless", """
SELECT file_id, rule_id FROM (
  SELECT DISTINCT file_id, 'r_ring' AS rule_id FROM symbols WHERE contains(symbol, 'ring')
  UNION SELECT DISTINCT file_id, 'r_gear' FROM symbols WHERE contains(symbol, 'gear')) c
WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = c.file_id AND
  ((c.rule_id = 'r_ring' AND s.library = 'Brand#2') OR (c.rule_id = 'r_gear' AND s.kind = 'export')))""", "symbols")
def unless(spark, sf_dir):
    """Candidates with an `unless` match for the same rule and file are dropped."""
    syms = symbols(spark, sf_dir)
    rules = F.array_compact(
        F.array(F.when(F.col("symbol").contains("ring"), "r_ring"), F.when(F.col("symbol").contains("gear"), "r_gear"))
    )
    blockers = F.array_compact(
        F.array(F.when(F.col("library") == "Brand#2", "r_ring"), F.when(F.col("kind") == "export", "r_gear"))
    )
    candidates = syms.select("file_id", F.explode(rules).alias("rule_id")).distinct()
    blocked = syms.select("file_id", F.explode(blockers).alias("rule_id"))
    return candidates.join(blocked, ["file_id", "rule_id"], "left_anti")


@query("prd23_location", """
SELECT file_id, value, "offset", 'file' AS scope FROM located WHERE "offset" >= 458752 - 100000 AND "offset" < 458752 - 50000
UNION ALL
SELECT l.file_id, value, "offset", 'section' FROM located l JOIN (
  SELECT file_id, arg_min("start", (CASE name WHEN '.text' THEN 1 ELSE 2 END, "start", "end")) AS lo,
         arg_min("end", (CASE name WHEN '.text' THEN 1 ELSE 2 END, "start", "end")) AS hi
  FROM sections WHERE name IN ('.text', '__text') GROUP BY 1) b USING (file_id)
WHERE "offset" >= lo + 1000 AND "offset" < lo + greatest((hi - lo) - 500, 0)""", "located sections")
def location(spark, sf_dir):
    strings = located(spark, sf_dir).drop("line_no")
    size = F.lit(7 * 65536)
    in_file = strings.filter(P.in_range(F.col("offset"), size, -100000, -50000)).withColumn("scope", F.lit("file"))
    in_text = P.strings_in_section(strings, sections(spark, sf_dir), "text", 1000, -500)
    return in_file.unionByName(in_text.withColumn("scope", F.lit("section")))


@query("prd24_section_alias", f"""
SELECT wanted, name, count(*) AS n FROM sections JOIN (SELECT * FROM (VALUES {', '.join(
    f"('{w}', '{n}')" for w, ns in K.SECTION_ALIASES.items() for n in ns)}, {', '.join(
    f"('{n}', '{n}')" for ns in K.SECTION_ALIASES.values() for n in ns)}) t(wanted, name)) a USING (name) GROUP BY ALL""", "sections")
def section_alias(spark, sf_dir):
    named = sections(spark, sf_dir).join(F.broadcast(P.section_aliases(spark)), "name")
    return named.groupBy("wanted", "name").agg(F.count("*").alias("n"))


@query("prd25_contains_external_ip", f"SELECT file_id FROM files WHERE {sql_has_public('text')}", "files")
def contains_external_ip(spark, sf_dir):
    return files(spark, sf_dir).filter(net.contains_external_ip(F.col("text"))).select("file_id")


view("plain_ips", """
SELECT event_id, (event_id % 260) || '.' || (user_id % 256) || '.' || (event_id % 3) || '.' || (event_id % 5) AS ip FROM events""")


@query("prd26_public_address", f"SELECT event_id, ip, {sql_public('ip')} AS is_public FROM plain_ips", "plain_ips")
def public_address(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    ip = F.concat_ws(".", *[x.cast("string") for x in (e % 260, u % 256, e % 3, e % 5)])
    df = read_table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    return df.withColumn("is_public", net.is_external_ip(F.col("ip")))


CTYPES = ("string", "section", "ast", "section_ratio", "structure", "raw", "kv")


@query("prd27_condition_type_fit", f"""
SELECT ctype, file_type, CASE WHEN ctype IN ('section', 'section_ratio', 'structure') THEN file_type IN ('elf', 'pe', 'macho')
  WHEN ctype = 'ast' THEN file_type IN ('python', 'javascript', 'shell') ELSE TRUE END AS fits, count(*) AS n
FROM (SELECT {sql_pick('l_partkey', CTYPES)} AS ctype, {sql_pick('l_orderkey', ('elf', 'python', 'javascript', 'pe', 'shell', 'macho', 'text'))} AS file_type
      FROM lineitem) GROUP BY ALL""")
def condition_type_fit(spark, sf_dir):
    from ruleloom.plans.tables import FILE_TYPES

    li = read_table(spark, sf_dir, "lineitem").select(
        pick(F.col("l_partkey"), CTYPES).alias("ctype"), pick(F.col("l_orderkey"), FILE_TYPES).alias("file_type")
    )
    fits = P.can_match(F.col("ctype"), F.col("file_type"))
    return li.groupBy("ctype", "file_type", fits.alias("fits")).agg(F.count("*").alias("n"))


@query("prd29_adhoc_match", r"""
SELECT file_id, 'raw' AS kind, CAST(len(regexp_extract_all(text, '\bthe\b')) AS BIGINT) AS hits FROM files
WHERE len(regexp_extract_all(text, '\bthe\b')) BETWEEN 3 AND 50
UNION ALL SELECT file_id, 'string', count(*) FROM doc_tokens WHERE regexp_matches(value, '^[0-9]{16}$') GROUP BY 1
UNION ALL SELECT file_id, 'symbol', count(*) FROM symbols WHERE contains(lower(symbol), 'widget') GROUP BY 1 HAVING count(*) >= 3""",
       "files doc_tokens symbols")
def adhoc_match(spark, sf_dir):
    raw = P.match(files(spark, sf_dir), "raw", 3, 50, word="the").withColumn("kind", F.lit("raw"))
    string = P.match(token_strings(spark, sf_dir), "string", regex="^[0-9]{16}$").withColumn("kind", F.lit("string"))
    symbol = P.match(symbols(spark, sf_dir), "symbol", 3, substr="WIDGET", case_insensitive=True)
    return raw.unionByName(string).unionByName(symbol.withColumn("kind", F.lit("symbol")))


@query("prd30_rule_explain", """
SELECT file_id, CASE WHEN NOT (list_contains(platforms, 'all') OR list_contains(platforms, 'linux')) THEN 'platform'
  WHEN NOT (list_contains(types, 'all') OR list_contains(types, file_type)) THEN 'file_type'
  WHEN size_bytes < size_min THEN 'size_too_small' WHEN size_bytes > size_max THEN 'size_too_large'
  WHEN unless_hit THEN 'unless' WHEN hits = 0 THEN 'no_match' WHEN hits < count_min THEN 'count'
  WHEN size_bytes > 0 AND hits / (size_bytes / 1024.0) < per_kb_min THEN 'density' ELSE 'matched' END AS reason
FROM gated""", "gated")
def rule_explain(spark, sf_dir):
    c = F.col
    reason = P.skip_reason(
        c("platforms"), F.array(F.lit("linux")), c("types"), c("file_type"), c("size_bytes"), c("size_min"), c("size_max"),
        c("unless_hit"), c("hits"), c("count_min"), c("per_kb_min"),
    )
    return gated(spark, sf_dir).select("file_id", reason.alias("reason"))


@query("prd31_library_paths", f"""
SELECT name AS path, count(*) AS n FROM entries
WHERE NOT ({' OR '.join(f"contains(name, '{p}')" for p in K.LIBRARY_PARTS)}) GROUP BY 1""", "entries")
def library_paths(spark, sf_dir):
    kept = P.outside_libraries(entries(spark, sf_dir).withColumnRenamed("name", "path"))
    return kept.groupBy("path").agg(F.count("*").alias("n"))
