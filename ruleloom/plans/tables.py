"""Fact tables read from the star schema, with the same tables as check SQL.

Text facts come straight from `documents`, `pages` and `conversations`. Facts that a
binary or manifest parser would supply (sections, system calls, archive entries,
manifests) are derived row by row from the large tables, so work grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.plans.registry import view
from ruleloom.sources.tables import files_from_documents, read_table

# -- picking a value by a key, in both dialects --------------------------------------


def pick(key: Column, values: Sequence[str | None]) -> Column:
    """The value at position key modulo the list length."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values: Sequence[str | None]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_pick(key: str, values: Sequence[str | None]) -> str:
    return f"list_extract({sql_list(values)}, CAST(({key}) % {len(values)} AS INTEGER) + 1)"


def sql_rows(rows: Sequence[Sequence], names: str) -> str:
    """A VALUES list as a table expression."""

    def cell(v):
        if v is None or isinstance(v, str):
            return sql_text(v)
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


# -- text files ----------------------------------------------------------------------


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_documents(read_table(spark, sf_dir, "documents"))


view("files", """
SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
       'doc_' || doc_id || '.txt' AS basename, lang AS file_type,
       CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256, text
FROM documents""")

view("doc_lines", """
SELECT file_id, file_type, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT file_id, file_type, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (
    SELECT file_id, file_type, regexp_split_to_array(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') AS ls
    FROM files WHERE text <> ''))""", "files")

view("doc_tokens", """
SELECT file_id, file_type, unnest(regexp_extract_all(text, '[^ \\t\\r\\n,;()<>"]+')) AS value
FROM files""", "files")

# -- names, symbols and structure ------------------------------------------------------

SYMBOL_PREFIXES = ("", "_", "sym.imp.", "sym.", "fcn.", "sym.imp.sym.", "__")
SYMBOL_KINDS = ("import", "export", "function")
SYMBOL_SOURCES = ("npm", "pip", "ast", "linker", "cargo")
FILE_TYPES = ("elf", "python", "javascript", "pe", "shell", "macho", "text")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the part is the symbol, its brand the library."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("file_id"),
        pick(F.col("l_orderkey"), FILE_TYPES).alias("file_type"),
        pick(F.col("l_linenumber"), SYMBOL_KINDS).alias("kind"),
        F.concat(
            pick(F.col("l_partkey"), SYMBOL_PREFIXES), F.replace("p_name", F.lit(" "), F.lit("_"))
        ).alias("symbol"),
        F.col("p_brand").alias("library"),
        (F.col("l_partkey") * 16).alias("offset"),
        pick(F.col("l_suppkey"), SYMBOL_SOURCES).alias("source"),
    )


view("symbols", f"""
SELECT l_orderkey AS file_id, {sql_pick('l_orderkey', FILE_TYPES)} AS file_type,
       {sql_pick('l_linenumber', SYMBOL_KINDS)} AS kind,
       {sql_pick('l_partkey', SYMBOL_PREFIXES)} || replace(p_name, ' ', '_') AS symbol,
       p_brand AS library, l_partkey * 16 AS "offset",
       {sql_pick('l_suppkey', SYMBOL_SOURCES)} AS source
FROM lineitem JOIN part ON l_partkey = p_partkey""")

SECTION_NAMES = (".text", ".data", ".rodata", "__text", "__const", ".bss", "UPX0")
SECTION_PERMISSIONS = ("r--", "rw-", "r-x", "rwx", None)
SECTION_SPAN = 65536


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") - 1).cast("bigint") * SECTION_SPAN
    size = (F.col("l_quantity") * 1000).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        pick(F.col("l_linenumber"), SECTION_NAMES).alias("name"),
        start.alias("start"),
        (start + size).alias("end"),
        size.alias("size"),
        (F.col("l_tax") * 100).alias("entropy"),
        pick(F.col("l_partkey"), SECTION_PERMISSIONS).alias("permissions"),
    )


view("sections", f"""
SELECT l_orderkey AS file_id, {sql_pick('l_linenumber', SECTION_NAMES)} AS name,
       CAST(l_linenumber - 1 AS BIGINT) * {SECTION_SPAN} AS "start",
       CAST(l_linenumber - 1 AS BIGINT) * {SECTION_SPAN} + CAST(l_quantity * 1000 AS BIGINT) AS "end",
       CAST(l_quantity * 1000 AS BIGINT) AS size, l_tax * 100 AS entropy,
       {sql_pick('l_partkey', SECTION_PERMISSIONS)} AS permissions
FROM lineitem""")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with a byte offset: the part name at a place set by the ship date."""
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("file_id"),
        F.col("p_name").alias("value"),
        F.pmod(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31, F.lit(7 * SECTION_SPAN)).alias("offset"),
        (F.col("l_linenumber").cast("bigint") * 10 + F.col("l_suppkey") % 10).alias("line_no"),
    )


view("located", f"""
SELECT l_orderkey AS file_id, p_name AS value,
       (l_partkey * 7919 + l_suppkey * 31) % {7 * SECTION_SPAN} AS "offset",
       CAST(l_linenumber AS BIGINT) * 10 + l_suppkey % 10 AS line_no
FROM lineitem JOIN part ON l_partkey = p_partkey""")

ARCHES = ("x86_64", "ARM64", "mips")


def syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("address"),
        F.get_json_object("props", "$.k").cast("int").alias("number"),
        F.col("event_type").alias("name"),
        pick(F.col("event_id"), ARCHES).alias("arch"),
    )


view("syscalls", f"""
SELECT user_id AS file_id, event_id AS address,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS number, event_type AS name,
       {sql_pick('event_id', ARCHES)} AS arch
FROM events""")

PARAM_LISTS = ("", "a", "a,b", "count,x", "request,response,next", "first,second,third,d,e,f,g,h")
FUNCTION_NAMES = ("main", "x", "handle_request", "f1", "aZ93kQx7Lm2P", "", "render")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    params = pick(F.col("l_partkey"), PARAM_LISTS)
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        pick(F.col("l_suppkey"), FUNCTION_NAMES).alias("name"),
        (F.col("l_quantity") * 12 - 11).cast("int").alias("line_count"),
        F.filter(F.split(params, ","), lambda p: p != "").alias("param_names"),
        (F.col("l_linenumber") % 5).cast("int").alias("nesting_depth"),
        (F.col("l_suppkey") % 7 == 5).alias("is_anonymous"),
        (F.col("l_partkey") % 4 == 0).alias("is_async"),
        (F.col("l_partkey") % 9 == 0).alias("is_generator"),
        (F.col("l_partkey") % 5 == 0).alias("contains_nested"),
        (F.col("l_quantity") / 2).cast("int").alias("complexity"),
        (F.col("l_linenumber") % 4).cast("int").alias("loops"),
    )


view("functions", f"""
SELECT l_orderkey AS file_id, {sql_pick('l_suppkey', FUNCTION_NAMES)} AS name,
       CAST(l_quantity * 12 - 11 AS INTEGER) AS line_count,
       list_filter(string_split({sql_pick('l_partkey', PARAM_LISTS)}, ','), lambda p: p <> '') AS param_names,
       l_linenumber % 5 AS nesting_depth, l_suppkey % 7 = 5 AS is_anonymous,
       l_partkey % 4 = 0 AS is_async, l_partkey % 9 = 0 AS is_generator,
       l_partkey % 5 = 0 AS contains_nested, CAST(floor(l_quantity / 2) AS INTEGER) AS complexity,
       l_linenumber % 4 AS loops
FROM lineitem""")

ENTRY_NAMES = (
    "app/main.py", "../../etc/passwd", "lib/com/google/Foo.class", "META-INF/x.MF", "a/../b.txt",
    "img/logo.png", "x/org/apache/Bar.class",
)
LINK_TARGETS = (None, None, "../outside", "/etc/shadow", "lib/real", None)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    packed = (F.col("l_quantity") * 1000).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("container_id"),
        F.concat(F.lit("/"), pick(F.col("l_partkey"), ENTRY_NAMES)).alias("name"),
        packed.alias("compressed"),
        (packed * (1 + F.col("l_suppkey") % 50 * (F.col("l_partkey") % 5))).alias("uncompressed"),
        pick(F.col("l_suppkey"), LINK_TARGETS).alias("symlink_target"),
    )


view("entries", f"""
SELECT l_orderkey AS container_id, '/' || {sql_pick('l_partkey', ENTRY_NAMES)} AS name,
       CAST(l_quantity * 1000 AS BIGINT) AS compressed,
       CAST(l_quantity * 1000 AS BIGINT) * (1 + l_suppkey % 50 * (l_partkey % 5)) AS uncompressed,
       {sql_pick('l_suppkey', LINK_TARGETS)} AS symlink_target
FROM lineitem""")

# -- paths and environment names ---------------------------------------------------------

PATH_HEADS = (
    "/usr/bin/tool", "/etc/app.conf", "/tmp/x", "/var/log/y.log", "/home/u/.bashrc",
    "/home/%s/mail", "/home/u/docs/", "./rel/a", "../up/b", "/dev/shm/q", "/proc/1/maps",
    "/run/z.pid", "/opt/x/../y", "~/notes", "${HOME}/c", "/sbin/init", "/etc/hosts", ".profile",
    "/srv/app/Config/k", "/home/u/%d/log", "plain", "C:\\Windows\\a.dll", "bin/bash", "a/usr/b",
)


def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        F.concat(
            pick(F.col("l_partkey"), PATH_HEADS),
            F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("_"), F.col("l_suppkey").cast("string")))
            .otherwise(F.lit("")),
        ).alias("value"),
    )


view("path_strings", f"""
SELECT l_orderkey AS file_id, {sql_pick('l_partkey', PATH_HEADS)}
       || CASE WHEN l_suppkey % 3 = 0 THEN '_' || l_suppkey ELSE '' END AS value
FROM lineitem""")

ENV_STRINGS = (
    "PATH", "HOME", "AWS_SECRET_KEY", "GITHUB_TOKEN", "LD_PRELOAD", "TMPDIR", "LANG", "LC_ALL",
    "http_proxy", "DISPLAY", "PYTHONHOME", "NODE_PATH", "ANDROID_ROOT", "EDITOR", "SHELL",
    "CI_JOB_TOKEN", "DOCKER_AUTH_KEY", "NOT_KNOWN", "lowercase", "GOPATH", "WINDIR", "USERPROFILE",
    "AWS_REGION", "TRAVIS_BUILD", "RUBYLIB", "JENKINS_HOME", "SSH_TTY", "FTP_PROXY",
)


def env_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_id")
    return ev.select(
        F.col("user_id").alias("file_id"), pick(F.col("event_id"), ENV_STRINGS).alias("value")
    )


view("env_strings", f"""
SELECT user_id AS file_id, {sql_pick('event_id', ENV_STRINGS)} AS value FROM events""")
