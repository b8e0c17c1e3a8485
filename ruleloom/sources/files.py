"""Corpus readers, file typing and content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a folder, names below it starting `.git` skipped; content is read only if used."""
    top = root.split("://")[-1].rstrip("/")
    below = F.substr("path", F.locate(top, F.col("path")) + len(top))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(~below.rlike(r"/\.git"))
    return found.select(
        "path",
        F.substring_index("path", "/", -1).alias("basename"),
        F.col("length").alias("size_bytes"),
        "content",
        type_from_path(F.col("path")).alias("file_type"),
    ).withColumn("is_archive", F.col("file_type").isin("archive", "jar"))


def type_from_path(path: Column) -> Column:
    """Manifest names, workflow files and multi-part suffixes first, then the extension."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    out = F.when(F.lit(False), "")
    for name, kind in K.TYPE_BY_BASENAME:
        out = out.when(base == name, kind)
    out = out.when(base.endswith(".vsixmanifest"), "vsixmanifest")
    workflow = T.contains_any(low, (".github/workflows/", ".github\\workflows\\"))
    out = out.when(workflow & T.ends_with_any(low, (".yml", ".yaml")), "githubactions")
    out = out.when(T.ends_with_any(low, K.JAR_SUFFIXES), "jar")
    out = out.when(T.ends_with_any(low, K.TAR_SUFFIXES), "archive")
    extension = T.file_extension(path)
    for kind, names in K.TYPE_BY_EXTENSION.items():
        out = out.when(extension.isin(*names), kind)
    return out.otherwise("unknown")


def type_from_content(path: Column, content: Column) -> Column:
    """Leading bytes and first-line interpreters; the path decides what they do not."""
    head = F.hex(F.substring(content, 1, 16))
    major = F.conv(F.substring(head, 13, 4), 16, 10).try_cast("int")
    start = F.decode(F.substring(content, 1, 100), "ISO-8859-1")
    lo, hi = K.CLASS_MAJOR_RANGE
    out = F.when(F.octet_length(content) < 4, type_from_path(path))
    out = out.when(
        head.startswith(K.CLASS_MAGIC) & (F.octet_length(content) >= 8) & major.between(lo, hi), "javaclass"
    )
    jar = T.ends_with_any(F.lower(path), K.JAR_SUFFIXES) & head.startswith("504B")
    out = out.when(jar, "jar")
    for prefix, kind in K.MAGIC_PREFIXES:
        out = out.when(head.startswith(prefix), kind)
    out = out.when(start.contains("<plist"), "plist")
    for prefix, kind in K.SHEBANGS:
        out = out.when(start.startswith(prefix), kind)
    return out.otherwise(type_from_path(path))


def extension_mismatch(files: DataFrame) -> DataFrame:
    """Files whose extension promises a format the content does not start with."""
    content = F.col("content")
    extension = T.file_extension(F.col("path"))
    head = F.hex(F.substring(content, 1, 100))
    start = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    expected = F.when(F.lit(False), "")
    accepted = F.when(F.lit(False), F.lit(False))
    for ext, what, prefixes in K.EXPECTED_MAGIC:
        expected = expected.when(extension == ext, what)
        ok = T.starts_with_any(head, prefixes)
        if ext == "svg":
            ok = ok | start.contains("<svg")
        accepted = accepted.when(extension == ext, ok)
    hint = F.when(F.lit(False), "")
    for prefix, what in K.ACTUAL_HINTS:
        hint = hint.when(head.startswith(prefix), what)
    ascii_only = ~F.decode(F.substring(content, 1, 100), "ISO-8859-1").rlike(r"[^\x00-\x7F]")
    hint = hint.when(
        ascii_only, F.when(start.rlike(r"^[0-9a-fA-F \t\r\n]*$"), "hex-encoded data").otherwise("ASCII text")
    ).otherwise("binary data")
    return (
        files.withColumn("expected", expected)
        .filter((F.octet_length(content) >= 4) & F.col("expected").isNotNull() & ~accepted)
        .select(
            "file_id",
            "expected",
            hint.alias("actual"),
            F.lit("T1036.005").alias("attack"),
            F.lit(K.HOSTILE).alias("crit"),
        )
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def normalized_text(content: Column) -> Column:
    """UTF-16 with a byte order mark becomes text; other bytes are read as UTF-8."""
    head = F.hex(F.substring(content, 1, 2))
    body = F.substr(content, F.lit(3))
    return (
        F.when(head == "FFFE", F.decode(body, "UTF-16LE"))
        .when(head == "FEFF", F.decode(body, "UTF-16BE"))
        .otherwise(content.cast("string"))
    )


RESULT_SCHEMA = (
    "type string, path string, risk string, "
    "findings array<struct<id:string,crit:string,conf:double,trait_refs:array<string>>>"
)


def parse_result_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Findings from result lines; blank, malformed and summary lines are skipped."""
    parsed = lines.select(
        F.from_json(F.col(column), RESULT_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), F.col(column).alias("raw")
    )
    good = parsed.filter(
        (F.trim("raw") != "") & F.col("r").isNotNull() & (F.coalesce("r.type", F.lit("")) != "summary")
    )
    return good.select("r.path", F.explode("r.findings").alias("f")).select(
        "path",
        F.col("f.id").alias("rule_id"),
        F.col("f.crit").alias("crit"),
        F.col("f.conf").alias("conf"),
        F.col("f.trait_refs").alias("trait_refs"),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_result_lines(spark.read.text(path))
