"""Fact extraction: typed strings, names, environment variables, paths and comments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids, net, text
from ruleloom.session import local_table


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table; its size is that of the constants, so it may be broadcast."""
    return F.broadcast(local_table(spark, rows, schema))


def runs(df: DataFrame, column: str, pattern: str, out: str = "value") -> DataFrame:
    """One row per non-overlapping match of a pattern, keeping the other columns."""
    kept = [c for c in df.columns if c != column]
    hits = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    return df.select(*kept, F.explode(hits).alias(out))


def spans(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Matches with their byte offset, as (…, value, offset).

    Spark has no expression for match positions; this batch function finds them in one
    pass over the bytes and avoids the shuffle a prefix sum over pieces would need.
    """
    import re

    @F.pandas_udf("array<struct<value:string,offset:bigint>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        regex = re.compile(pattern.encode("utf-8"))
        for batch in batches:
            yield batch.map(
                lambda s: [
                    {"value": m.group().decode("utf-8", "replace"), "offset": m.start()}
                    for m in regex.finditer(s.encode("utf-8"))
                ]
            )

    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.explode(find(F.col(column))).alias("hit")).select(
        *kept, F.col("hit.value").alias("value"), F.col("hit.offset").alias("offset")
    )


def quoted_strings(files: DataFrame) -> DataFrame:
    """Contents of single- and double-quoted strings, empties dropped, with offset."""
    hits = spans(files.select("file_id", "text"), "text", K.QUOTED_RE)
    inner = F.substr(F.col("value"), F.lit(2), F.char_length("value") - 2)
    return hits.select("file_id", inner.alias("value"), (F.col("offset") + 1).alias("offset")).filter(
        F.col("value") != ""
    )


def classify_strings(strings: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Adds `string_type`; a name in the symbol table takes that table's kind."""
    kind = text.string_kind(F.col("value"))
    if symbols is None:
        return strings.withColumn("string_type", kind)
    table = symbols.groupBy(
        "file_id", text.normalize_symbol(F.col("symbol")).alias("norm")
    ).agg(F.max("kind").alias("symbol_kind"))
    left = strings.withColumn("norm", text.normalize_symbol(F.col("value")))
    return (
        left.join(table, ["file_id", "norm"], "left")
        .withColumn("string_type", F.coalesce("symbol_kind", kind))
        .drop("norm", "symbol_kind")
    )


def list_strings(strings: DataFrame, min_length: int) -> DataFrame:
    return strings.filter(F.octet_length("value") >= min_length)


def list_symbols(*facts: DataFrame) -> DataFrame:
    """Imports, exports and functions as one listing."""
    out = facts[0]
    for other in facts[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def flatten_metrics(metrics: DataFrame, family: str, key: str = "file_id") -> DataFrame:
    """Long form (file_id, field, value); booleans become 1 and 0, nulls are dropped."""
    fields = [c for c in metrics.columns if c != key]
    numeric = metrics.select(key, *[F.col(c).cast("double").alias(f"{family}.{c}") for c in fields])
    names = [f"{family}.{c}" for c in fields]
    return numeric.unpivot(key, [F.col(f"`{n}`") for n in names], "field", "value").filter(
        F.col("value").isNotNull()
    )


def metric_value(long_form: DataFrame, field: str) -> DataFrame:
    return long_form.filter(F.col("field") == field)


def ipv4(df: DataFrame, column: str) -> DataFrame:
    hits = runs(df, column, K.IP_WORD_RE)
    return hits.filter(
        net.valid_octets(F.col("value")) & ~F.col("value").isin("0.0.0.0", "127.0.0.1")
    )


def urls(df: DataFrame, column: str) -> DataFrame:
    return runs(df, column, K.SCRIPT_URL_RE)


def paths_in(df: DataFrame, column: str) -> DataFrame:
    return runs(df, column, K.SCRIPT_PATH_RE).filter(F.octet_length("value") > 3)


def _valid_ips(value: Column) -> Column:
    hits = F.regexp_extract_all(value, F.lit(K.IP_WORD_RE), F.lit(0))
    return F.filter(hits, lambda v: net.valid_octets(v) & ~v.isin("0.0.0.0", "127.0.0.1"))


# What manifest scripts name, as arrays per script.
SCRIPT_FACTS = {
    "url": lambda s: F.regexp_extract_all(s, F.lit(K.SCRIPT_URL_RE), F.lit(0)),
    "ip": _valid_ips,
    "path": lambda s: F.filter(F.regexp_extract_all(s, F.lit(K.SCRIPT_PATH_RE), F.lit(0)), lambda v: F.octet_length(v) > 3),
}


# -- environment names ---------------------------------------------------------------


def is_credential_name(name: Column) -> Column:
    sensitive = text.ends_with_any(name, K.CREDENTIAL_SUFFIXES) | text.contains_any(
        name, K.CREDENTIAL_PARTS
    )
    return (text.starts_with_any(name, K.CREDENTIAL_PREFIXES) & sensitive) | name.isin(
        *K.CREDENTIAL_NAMES
    )


def env_category(name: Column) -> Column:
    out = F.when(is_credential_name(name), "credential")
    for category, exact, prefixes in K.ENV_CATEGORIES:
        test = name.isin(*exact) if exact else F.lit(False)
        out = out.when(test | text.starts_with_any(name, prefixes), category)
    return out.when(name.contains("proxy") | name.contains("PROXY"), "network").otherwise("other")


def env_vars(strings: DataFrame) -> DataFrame:
    """Strings that are well-known environment names, with their category."""
    name = F.col("value")
    known = name.isin(*K.KNOWN_ENV) | text.starts_with_any(name, K.KNOWN_ENV_PREFIXES)
    return strings.filter((F.octet_length(name) <= 100) & known).withColumn(
        "category", env_category(name)
    )


# -- paths -----------------------------------------------------------------------------


def path_type(path: Column) -> Column:
    return (
        F.when(text.contains_any(path, ("%s", "%d", "${", "$HOME")), "dynamic")
        .when(text.starts_with_any(path, ("./", "../")) | path.contains("/../"), "relative")
        .otherwise("absolute")
    )


def path_category(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    hidden = (path.startswith(".") & ~text.starts_with_any(path, ("./", "../"))) | (
        base.startswith(".") & ~base.isin(".", "..")
    )
    out = F.when(hidden, "hidden")
    for category, prefixes, suffixes, parts, exact in K.PATH_CATEGORIES:
        test = (
            text.starts_with_any(path, prefixes)
            | text.ends_with_any(path, suffixes)
            | text.contains_any(path, parts)
        )
        if exact:
            test = test | path.isin(*exact)
        out = out.when(test, category)
    return out.otherwise("other")


def path_facts(strings: DataFrame) -> DataFrame:
    """Path-kind strings with type and category."""
    path = F.col("value")
    return strings.filter(text.string_kind(path) == "path").select(
        "file_id",
        path.alias("path"),
        path_type(path).alias("path_type"),
        path_category(path).alias("category"),
    )


def path_directories(paths: DataFrame) -> DataFrame:
    """Directories used at least twice by one file, with the access pattern."""
    per_dir = (
        paths.withColumn("directory", ids.parent_directory(F.col("path")))
        .filter(F.col("directory").isNotNull())
        .groupBy("file_id", "directory")
        .agg(
            F.count("*").alias("file_count"),
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.bool_or((F.col("path_type") == "dynamic") & F.col("path").contains("/home/")).alias("enumerates"),
        )
    )
    return per_dir.filter(F.col("file_count") >= 2).select(
        "file_id",
        "directory",
        "file_count",
        "categories",
        F.when(F.col("enumerates"), "user_enumeration").otherwise("multiple_specific").alias("access_pattern"),
    )


# -- imports ---------------------------------------------------------------------------


def _lookup_rows(groups: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(name, group) for group, names in groups.items() for name in names]


def import_ecosystem(symbols: DataFrame) -> DataFrame:
    """Adds `ecosystem`: the source marker decides first, then the file type."""
    spark = symbols.sparkSession
    by_source = small_table(spark, _lookup_rows(K.ECOSYSTEM_BY_SOURCE), "source string, eco_source string")
    by_type = small_table(spark, _lookup_rows(K.ECOSYSTEM_BY_TYPE), "file_type string, eco_type string")
    return (
        symbols.join(by_source, "source", "left")
        .join(by_type, "file_type", "left")
        .withColumn("ecosystem", F.coalesce("eco_source", "eco_type", F.lit("unknown")))
        .drop("eco_source", "eco_type")
    )


# -- comments ----------------------------------------------------------------------------

# One alternation per style: strings are matched first so markers inside them do not count.
_STRING = r'''"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\]|\\[\s\S])*\''''
COMMENT_RE = {
    "c": _STRING + r"|//[^\n]*|/\*[\s\S]*?\*/",
    "hash": _STRING + r"|#[^\n]*",
    "lua": _STRING + r"|--\[\[[\s\S]*?\]\]|--[^\n]*",
}


def comment_array(content: Column, style: str) -> Column:
    """Comment bodies of one text, in order."""
    hits = F.regexp_extract_all(content, F.lit(COMMENT_RE[style]), F.lit(0))
    marks = {"c": "^/[/*]", "hash": "^#", "lua": "^--"}[style]
    kept = F.filter(hits, lambda h: h.rlike(marks))
    if style == "c":
        return F.transform(kept, lambda h: F.regexp_replace(h, r"^//|^/\*|\*/\z", ""))
    if style == "lua":
        return F.transform(kept, lambda h: F.regexp_replace(h, r"^--\[\[|^--|\]\]\z", ""))
    return F.transform(kept, lambda h: F.regexp_replace(h, "^#", ""))


def comments(df: DataFrame, column: str, style: str) -> DataFrame:
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(comment_array(F.col(column), style)).alias("idx", "comment"))


def embedded_code_candidates(strings: DataFrame) -> DataFrame:
    """Strings that look like code: long enough, not too random, under 1 MB.

    At most 100 per file in offset order, and only until 50 MB were taken.
    """
    from ruleloom.operators.windows import first_n_per_group, within_budget

    n = F.octet_length("value")
    floor = F.when(F.size("encoding_chain") > 0, 20).otherwise(50)
    hits = strings.filter(
        (n >= floor)
        & (n <= 1024 * 1024)
        & text.is_script_text(F.col("value"))
        & (text.char_entropy(F.col("value")) <= 7.5)
    ).withColumn("n_bytes", n.cast("bigint"))
    ranked = first_n_per_group(hits, ["file_id"], [F.col("offset"), F.col("value")], K.MAX_EMBEDDED_STRINGS)
    return within_budget(ranked, "file_id", "offset", "n_bytes", K.MAX_EMBEDDED_BYTES)
