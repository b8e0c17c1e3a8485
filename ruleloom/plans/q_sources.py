"""Sources: corpus scan, file typing, content checks and rule catalog preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.plans.registry import query, view
from ruleloom.plans.tables import files, pick, sql_list, sql_pick, sql_rows
from ruleloom.sources import catalog, files as src
from ruleloom.sources.tables import read_table

# -- files with names and leading bytes -----------------------------------------------

NAMES = (
    "package.json", "Cargo.toml", "composer.json", "pyproject.toml", "PKG-INFO", "x.vsixmanifest",
    ".github/workflows/ci.yml", "lib/app.jar", "dist/x.tar.gz", "a.py", "b.mjs", "c.tsx", "d.go",
    "e.rs", "f.rb", "g.ps1", "h.h", "i.exs", "j.whl", "k.rtf", "README", "m.unknown", "n.tgz",
    "o.swift", "p.lua", "font.woff", "font.woff2", "t.ttf", "u.otf", "v.gif", "w.bmp", "x.ico",
    "y.webp", "z.svg", "s.mp3", "s.wav", "tool.sh",
)
HEADS = (
    "", "7F454C46", "4D5A", "504B0304", "89504E470D0A1A0A", "FFD8FF", "46617364", "7B5C727466",
    "CAFEBABE00000034", "CAFEBABE00000002", "CFFAEDFE", "62706C697374", "774F4646", "47494638396121",
    "23212F62696E2F62617368", "23212F7573722F62696E2F656E7620707974686F6E", "3C3F786D6C", "49443304",
    "524946461111", "00010000",
)


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under varied names, with varied leading bytes before the text."""
    doc = read_table(spark, sf_dir, "documents")
    head = F.unhex(pick(F.floor(F.col("doc_id") / 3), HEADS))
    return doc.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", F.concat(F.lit("d"), "doc_id"), pick(F.col("doc_id"), NAMES)).alias("path"),
        F.concat(head, F.col("text").cast("binary")).alias("content"),
    )


view("named_files", f"""
SELECT doc_id AS file_id, source || '/d' || doc_id || '/' || {sql_pick('doc_id', NAMES)} AS path,
       {sql_pick('doc_id // 3', HEADS)} || substr(hex(encode(text)), 1, 400) AS head
FROM documents""")

BASE_ROWS = sql_rows([(n, k) for n, k in K.TYPE_BY_BASENAME], "base, kind")
EXT_ROWS = sql_rows([(e, k) for k, es in K.TYPE_BY_EXTENSION.items() for e in es], "ext, kind")
view("base_types", BASE_ROWS)
view("ext_types", EXT_ROWS)
view("typed_by_path", """
SELECT file_id, path, CASE WHEN b.kind IS NOT NULL THEN b.kind
  WHEN base LIKE '%.vsixmanifest' THEN 'vsixmanifest'
  WHEN low LIKE '%.github/workflows/%' AND regexp_matches(low, '\\.ya?ml$') THEN 'githubactions'
  WHEN regexp_matches(low, '\\.(jar|war|ear)$') THEN 'jar'
  WHEN regexp_matches(low, '\\.(tar\\.gz|tgz|tar\\.bz2|tar\\.xz|tar\\.zst|tar)$') THEN 'archive'
  WHEN e.kind IS NOT NULL THEN e.kind ELSE 'unknown' END AS file_type
FROM (SELECT *, lower(path) AS low, regexp_extract(lower(path), '[^/]*$') AS base,
        regexp_extract(path, '[^/]\\.([^./]*)$', 1) AS ext FROM named_files) f
LEFT JOIN base_types b USING (base) LEFT JOIN ext_types e USING (ext)""",
     "named_files", "base_types", "ext_types")


@query("src1_corpus_scan")
def corpus_scan(spark, sf_dir):
    return src.scan_corpus(spark, sf_dir).select("basename", "size_bytes", "file_type", "is_archive")


@query("src2_program_files", f"""
SELECT file_type, count(*) AS n_files FROM typed_by_path
WHERE list_contains({sql_list(K.PROGRAM_TYPES)}, file_type) GROUP BY ALL""", "typed_by_path")
def program_files(spark, sf_dir):
    typed = named_files(spark, sf_dir).select(src.type_from_path(F.col("path")).alias("file_type"))
    return typed.filter(F.col("file_type").isin(*K.PROGRAM_TYPES)).groupBy("file_type").agg(F.count("*").alias("n_files"))


@query("src3_type_from_path", "SELECT file_id, path, file_type FROM typed_by_path", "typed_by_path")
def type_from_path(spark, sf_dir):
    return named_files(spark, sf_dir).select("file_id", "path", src.type_from_path(F.col("path")).alias("file_type"))


view("magic_rows", sql_rows([(p, k, i) for i, (p, k) in enumerate(K.MAGIC_PREFIXES)], "prefix, kind, prio"))
view("shebang_rows", sql_rows([(p, k, i) for i, (p, k) in enumerate(K.SHEBANGS)], "prefix, kind, prio"))


@query("src4_type_from_content", """
SELECT file_id, CASE
  WHEN head LIKE 'CAFEBABE%' AND TRY_CAST('0x' || substr(head, 13, 4) AS INTEGER) BETWEEN 45 AND 70 THEN 'javaclass'
  WHEN regexp_matches(lower(path), '\\.(jar|war|ear)$') AND head LIKE '504B%' THEN 'jar'
  WHEN m.kind IS NOT NULL THEN m.kind
  WHEN s.kind IS NOT NULL THEN s.kind ELSE file_type END AS file_type
FROM named_files JOIN typed_by_path USING (file_id, path)
LEFT JOIN (SELECT file_id, arg_min(kind, prio) AS kind FROM named_files JOIN magic_rows ON starts_with(head, prefix)
           GROUP BY file_id) m USING (file_id)
LEFT JOIN (SELECT file_id, arg_min(kind, prio) AS kind FROM named_files
           JOIN shebang_rows ON starts_with(head, hex(encode(prefix))) GROUP BY file_id) s USING (file_id)""",
       "typed_by_path magic_rows shebang_rows")
def type_from_content(spark, sf_dir):
    return named_files(spark, sf_dir).select(
        "file_id", src.type_from_content(F.col("path"), F.col("content")).alias("file_type")
    )


view("expected_rows", sql_rows([(e, w, p) for e, w, ps in K.EXPECTED_MAGIC for p in ps], "ext, expected, prefix"))
view("hint_rows", sql_rows([(p, w, i) for i, (p, w) in enumerate(K.ACTUAL_HINTS)], "prefix, what, prio"))


@query("src5_extension_mismatch", """
SELECT file_id, expected, coalesce(h.what, CASE
         WHEN NOT regexp_matches(substr(head, 1, 200), '^(..)*[89A-F].') THEN
           CASE WHEN regexp_matches(substr(head, 1, 400), '^(3[0-9]|4[1-6]|6[1-6]|20|09|0D|0A)*$')
                THEN 'hex-encoded data' ELSE 'ASCII text' END
         ELSE 'binary data' END) AS actual,
       'T1036.005' AS attack, 3 AS crit
FROM (SELECT file_id, any_value(head) AS head, any_value(e.expected) AS expected,
             bool_or(starts_with(head, e.prefix)) AS ok
      FROM named_files JOIN expected_rows e ON regexp_extract(path, '[^/]\\.([^./]*)$', 1) = e.ext
      GROUP BY file_id) f
LEFT JOIN (SELECT file_id, arg_min(what, prio) AS what FROM named_files JOIN hint_rows ON starts_with(head, prefix)
           GROUP BY file_id) h USING (file_id)
WHERE NOT ok""", "named_files expected_rows hint_rows")
def extension_mismatch(spark, sf_dir):
    return src.extension_mismatch(named_files(spark, sf_dir))


@query("src6_content_hash", "SELECT file_id, sha256(text) AS sha256 FROM files", "files")
def content_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), src.content_hash(F.col("text").cast("binary")).alias("sha256")
    )


@query("src7_utf16_normalize", "SELECT file_id, sha256(text) AS sha256, size_bytes FROM files", "files")
def utf16_normalize(spark, sf_dir):
    doc = read_table(spark, sf_dir, "documents")
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.col("text").cast("binary"))
    )
    back = doc.select(F.col("doc_id").alias("file_id"), src.normalized_text(raw).alias("text"))
    return back.select(
        "file_id",
        src.content_hash(F.col("text").cast("binary")).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
    )


# -- rule catalog -------------------------------------------------------------------------

RAW_CRIT = ("notable", None, "none", "HOSTILE", "suspicious", "bogus", None, "inert")
RAW_FOR = (
    "scripts,-sh", "all", None, "*,-binaries", "!elf", "py, js,unknown", "binaries", "none", "-all", "c++,rs,go",
    "all,-scripts,!pe", "",
)
RAW_PLATFORMS = ("linux", None, "Linux,MACOS,beos", "all", "windows,unix")
DEFAULT_CRIT = ("suspicious", None, "malicious", "notable")


def raw_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("micro-behaviors/"), F.lower("p_type"), F.lit("::r"), key).alias("rule_id"),
        F.col("p_brand").alias("source_file"),
        pick(key, RAW_CRIT).alias("crit"),
        F.when(key % 3 == 0, F.round(F.col("p_size") / 100, 2)).alias("conf"),
        pick(key, (None, "B0001", "none")).alias("mbc"),
        pick(key, ("T1041", None)).alias("attack"),
        pick(key, RAW_FOR).alias("for_types"),
        pick(key, RAW_PLATFORMS).alias("platforms"),
        "p_name",
    )


view("raw_rules", f"""
SELECT 'micro-behaviors/' || lower(p_type) || '::r' || p_partkey AS rule_id, p_brand AS source_file,
       {sql_pick('p_partkey', RAW_CRIT)} AS crit,
       CASE WHEN p_partkey % 3 = 0 THEN round(p_size / 100, 2) END AS conf,
       {sql_pick('p_partkey', (None, 'B0001', 'none'))} AS mbc, {sql_pick('p_partkey', ('T1041', None))} AS attack,
       {sql_pick('p_partkey', RAW_FOR)} AS for_types, {sql_pick('p_partkey', RAW_PLATFORMS)} AS platforms, p_name
FROM part""")


def rule_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = read_table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source_file")).agg(
        F.min("p_partkey").alias("k")
    )
    return per_file.select(
        "source_file",
        pick(F.col("k"), DEFAULT_CRIT).alias("crit"),
        F.when(F.col("k") % 2 == 0, F.lit(0.5)).alias("conf"),
        pick(F.col("k"), ("B0009", "none")).alias("mbc"),
        pick(F.col("k"), (None, "T1059", "none")).alias("attack"),
        pick(F.col("k"), ("python", None)).alias("for_types"),
        pick(F.col("k"), (None, "linux")).alias("platforms"),
    )


view("rule_defaults", f"""
SELECT source_file, {sql_pick('k', DEFAULT_CRIT)} AS crit, CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE END AS conf,
       {sql_pick('k', ('B0009', 'none'))} AS mbc, {sql_pick('k', (None, 'T1059', 'none'))} AS attack,
       {sql_pick('k', ('python', None))} AS for_types, {sql_pick('k', (None, 'linux'))} AS platforms
FROM (SELECT p_brand AS source_file, min(p_partkey) AS k FROM part GROUP BY 1)""")

DEFAULTS_SQL = """
SELECT r.rule_id, r.source_file,
       least({cap}, CASE WHEN r.crit IS NULL THEN coalesce(CASE d.crit WHEN 'inert' THEN 0 WHEN 'notable' THEN 1
              WHEN 'suspicious' THEN 2 WHEN 'malicious' THEN 3 END, 0)
            ELSE coalesce(CASE lower(r.crit) WHEN 'notable' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'hostile' THEN 3 END, 0)
            END) AS crit,
       coalesce(r.conf, d.conf, 1.0) AS conf, nullif(coalesce(r.mbc, d.mbc), 'none') AS mbc,
       nullif(coalesce(r.attack, d.attack), 'none') AS attack,
       coalesce(nullif(coalesce(r.for_types, d.for_types), 'none'), 'all') AS for_types,
       coalesce(nullif(coalesce(r.platforms, d.platforms), 'none'), 'all') AS platforms
FROM raw_rules r LEFT JOIN rule_defaults d USING (source_file)"""


@query("src8_rule_defaults", DEFAULTS_SQL.format(cap=2), "raw_rules rule_defaults")
def rule_defaults_atomic(spark, sf_dir):
    return catalog.with_rule_defaults(raw_rules(spark, sf_dir), rule_defaults(spark, sf_dir), atomic=True)


@query("src9_composite_defaults", DEFAULTS_SQL.format(cap=3), "raw_rules rule_defaults")
def rule_defaults_composite(spark, sf_dir):
    return catalog.with_rule_defaults(raw_rules(spark, sf_dir), rule_defaults(spark, sf_dir), atomic=False)


view("type_names", sql_rows(
    [(n, t) for n, ts in K.TYPE_GROUPS.items() for t in ts]
    + [(a, t) for t, names in K.TYPE_ALIASES.items() for a in names], "name, kind"))
view("expanded_types", """
SELECT rule_id, unnest(CASE WHEN has_all AND n_out = 0 THEN ['all'] ELSE list_sort(list_filter(
    CASE WHEN has_all OR (n_in = 0 AND n_out > 0) THEN (SELECT list(DISTINCT kind) FROM type_names) ELSE ins END,
    lambda k: NOT list_contains(outs, k))) END) AS file_type
FROM (
  SELECT rule_id, bool_or(NOT neg AND name IN ('all', '*')) AS has_all,
         coalesce(list(DISTINCT kind) FILTER (WHERE NOT neg AND kind IS NOT NULL), []) AS ins,
         CASE WHEN bool_or(neg AND name IN ('all', '*')) THEN (SELECT list(DISTINCT kind) FROM type_names)
              ELSE coalesce(list(DISTINCT kind) FILTER (WHERE neg AND kind IS NOT NULL), []) END AS outs,
         count(DISTINCT kind) FILTER (WHERE NOT neg) AS n_in,
         count(DISTINCT kind) FILTER (WHERE neg) + CASE WHEN bool_or(neg AND name IN ('all', '*')) THEN 1 ELSE 0 END AS n_out
  FROM (SELECT rule_id, regexp_matches(p, '^[!-]') AS neg, regexp_replace(p, '^[!-]', '') AS name
        FROM (SELECT rule_id, lower(trim(unnest(string_split(coalesce(for_types, 'all'), ',')))) AS p FROM raw_rules)
        WHERE p <> '')
  LEFT JOIN type_names USING (name) GROUP BY rule_id)""", "raw_rules", "type_names")


@query("src10_file_type_expansion", "SELECT rule_id, file_type FROM expanded_types", "expanded_types")
def file_type_expansion(spark, sf_dir):
    spec = F.coalesce("for_types", F.lit("all"))
    return raw_rules(spark, sf_dir).select("rule_id", F.explode(catalog.expand_file_types(spec)).alias("file_type"))


@query("src11_platform_expansion", f"""
SELECT rule_id, p AS platform FROM (
  SELECT rule_id, unnest(string_split(lower(coalesce(platforms, 'all')), ',')) AS p FROM raw_rules)
WHERE list_contains({sql_list(K.PLATFORMS)}, p)""", "raw_rules")
def platform_expansion(spark, sf_dir):
    spec = F.coalesce("platforms", F.lit("all"))
    return raw_rules(spark, sf_dir).select("rule_id", F.explode(catalog.expand_platforms(spec)).alias("platform"))


REF_FORMS = ("p", "micro-behaviors/x::p", "objectives/y")


@query("src12_id_prefixing", f"""
SELECT p_partkey AS ref_key, CASE WHEN contains(r, '::') OR contains(r, '/') THEN r
       ELSE 'cap/' || lower(p_type) || '::' || r END AS ref_id
FROM (SELECT p_partkey, p_type, {sql_pick('p_partkey', REF_FORMS)} || p_partkey AS r FROM part)""")
def id_prefixing(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    name = F.concat(pick(F.col("p_partkey"), REF_FORMS), F.col("p_partkey").cast("string"))
    directory = F.concat(F.lit("cap/"), F.lower("p_type"))
    return part.select(F.col("p_partkey").alias("ref_key"), catalog.prefixed_id(directory, name).alias("ref_id"))


@query("src13_jsonl_reader", """
SELECT 'o' || l_orderkey AS path, 'objectives/a/' || l_linestatus || '::r' || l_linenumber AS rule_id,
       CASE WHEN l_returnflag = 'A' THEN 'hostile' ELSE 'notable' END AS crit, l_discount AS conf
FROM lineitem WHERE l_partkey % 5 NOT IN (1, 2, 3)""")
def jsonl_reader(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    record = F.to_json(
        F.struct(
            F.lit("file").alias("type"),
            F.concat(F.lit("o"), F.col("l_orderkey")).alias("path"),
            F.array(
                F.struct(
                    F.concat(F.lit("objectives/a/"), "l_linestatus", F.lit("::r"), F.col("l_linenumber")).alias("id"),
                    F.when(F.col("l_returnflag") == "A", "hostile").otherwise("notable").alias("crit"),
                    F.col("l_discount").alias("conf"),
                )
            ).alias("findings"),
        )
    )
    kind = F.col("l_partkey") % 5
    line = (
        F.when(kind == 1, F.lit("  "))
        .when(kind == 2, F.lit('{"type": "summary", "files_analyzed": 3}'))
        .when(kind == 3, F.lit('{"type": "file", "findings": [{'))
        .otherwise(record)
    )
    return src.parse_result_lines(li.select(line.alias("value"))).drop("trait_refs")


@query("src14_short_form_rules", f"""
SELECT 'cap/' || lower(p_type) || '::' || p_partkey AS rule_id, 'composite' AS kind, 0 AS crit,
       coalesce(CASE WHEN p_partkey % 3 = 0 THEN round(p_size / 100, 2) END, 1.0) AS conf,
       len(string_split({sql_pick('p_partkey', ('py,js', 'rb'))}, ',')) AS n_types, 'all' AS clause, 'symbol' AS ctype,
       replace(p_name, ' ', '_') AS exact
FROM part""")
def short_form_rules(spark, sf_dir):
    key = F.col("p_partkey")
    simple = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("cap/"), F.lower("p_type"), F.lit("::"), key).alias("capability"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("symbol"),
        F.when(key % 3 == 0, F.round(F.col("p_size") / 100, 2)).alias("conf"),
        pick(key, ("py,js", "rb")).alias("for_types"),
        F.lit(None).cast("string").alias("platforms"),
    )
    rules, conds = catalog.from_short_form(simple)
    return rules.join(conds, "rule_id").select(
        "rule_id", "kind", "crit", "conf", F.size("for_types").cast("bigint").alias("n_types"), "clause", "ctype", "exact"
    )




@query("src15_literal_regex", """
SELECT p_partkey AS rule_key, ctype, CASE WHEN lit THEN re ELSE sub END AS substr, CASE WHEN NOT lit THEN re END AS regex
FROM (SELECT *, re IS NOT NULL AND sub IS NULL AND ctype <> 'hex' AND NOT regexp_matches(re, '[.*+?^$()\\[\\]{}|\\\\]') AS lit
  FROM (SELECT p_partkey, list_extract(['string', 'raw', 'hex', 'symbol', 'basename'], CAST(p_partkey % 5 AS INT) + 1) AS ctype,
      CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.*' WHEN 2 THEN '^' || p_name || '$' END AS re,
      CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS sub FROM part))""")
def literal_regex(spark, sf_dir):
    key = F.col("p_partkey")
    regex = (
        F.when(key % 4 == 0, F.col("p_name"))
        .when(key % 4 == 1, F.concat("p_name", F.lit(".*")))
        .when(key % 4 == 2, F.concat(F.lit("^"), "p_name", F.lit("$")))
    )
    conds = read_table(spark, sf_dir, "part").select(
        key.alias("rule_key"),
        pick(key, ("string", "raw", "hex", "symbol", "basename")).alias("ctype"),
        F.when(key % 7 == 0, F.col("p_brand")).alias("substr"),
        regex.alias("regex"),
    )
    return catalog.literal_regex_to_substr(conds)
