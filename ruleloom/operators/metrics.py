"""Metric families, one row per file.

Text, string, identifier and comment metrics are computed inside the row from arrays,
so a scan of the files is the whole plan. Only facts that arrive as rows of their own
(functions, imports) are aggregated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ruleloom import constants as K
from ruleloom.functions import text as T
from ruleloom.operators.matching import is_small
from ruleloom.operators.extract import comment_array

# White space in the Unicode sense, and the part of it that is unusual in text.
WHITE = r"[\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
UNUSUAL = r"[\u00A0\u2000-\u200A\u202F\u205F\u3000]"
ART = r"[=\-*#+|/\\_.]"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n\x0b\x0c\u0085\u00a0"))


def prepared(files: DataFrame) -> DataFrame:
    """Files with the arrays several metrics read, so each is built once per row."""
    lined = files.select("*", T.text_lines(F.col("text")).alias("_lines"), T.char_counts(F.col("text")).alias("_chars"))
    return lined.select("*", F.transform("_lines", F.octet_length).alias("_sizes"))


def line_metrics(text: Column) -> dict[str, Column]:
    lines, sizes = F.col("_lines"), F.col("_sizes")
    n = F.size(lines)
    mean = T.array_mean(sizes)
    over = lambda k: T.count_where(sizes, lambda s: s > k)
    return {
        "total_lines": n.cast("bigint"),
        "avg_line_length": mean,
        "max_line_length": F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint"),
        "line_length_stddev": T.array_stddev(sizes, mean),
        "lines_over_200": over(200),
        "lines_over_500": over(500),
        "lines_over_1000": over(1000),
        "empty_line_ratio": T.ratio(T.count_where(lines, lambda s: _trimmed(s) == ""), n),
        "trailing_whitespace_lines": T.count_where(lines, lambda s: s.rlike(WHITE + r"\z")),
        "ascii_art_lines": T.count_where(
            lines,
            lambda s: (F.octet_length(_trimmed(s)) >= 20)
            & (T.count_regex(_trimmed(s), ART) / F.octet_length(_trimmed(s)) > 0.7),
        ),
    }


def char_metrics(text: Column) -> dict[str, Column]:
    """Entropy, distinct characters and the most frequent visible one (lowest on ties)."""
    total = F.char_length(text)
    counts = F.col("_chars")
    visible = F.filter(counts, lambda x: ~x["ch"].rlike(WHITE))
    top = F.aggregate(
        visible,
        F.struct(F.lit("").alias("ch"), F.lit(0).cast("bigint").alias("n")),
        lambda best, x: F.when((x["n"] > best["n"]) | ((x["n"] == best["n"]) & (x["ch"] < best["ch"])), x).otherwise(best),
    )
    return {
        "char_entropy": F.when(text == "", F.lit(0.0)).otherwise(T.entropy_of_counts(counts, total)),
        "unique_chars": F.when(text == "", F.lit(0)).otherwise(F.size(counts)).cast("bigint"),
        "most_common_char": F.nullif(top["ch"], F.lit("")),
        "most_common_ratio": T.ratio(top["n"], total),
    }


def byte_metrics(text: Column) -> dict[str, Column]:
    n = F.octet_length(text)
    high = n - T.count_regex(text, r"[\x00-\x7F]")
    return {
        "non_ascii_ratio": T.ratio(high, n),
        "non_printable_ratio": T.ratio(T.count_regex(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), n),
        "null_byte_count": T.count_regex(text, r"\x00"),
    }


def whitespace_metrics(text: Column) -> dict[str, Column]:
    return {
        "whitespace_ratio": T.ratio(T.count_regex(text, WHITE), F.char_length(text)),
        "tab_count": T.count_literal(text, "\t"),
        "space_count": T.count_literal(text, " "),
        "mixed_indent": text.rlike(r"(?m)^ *\t") & text.rlike(r"(?m)^\t* "),
        "unusual_whitespace": T.count_regex(text, UNUSUAL),
    }


def escape_metrics(text: Column) -> dict[str, Column]:
    """Escapes counted on bytes; texts without a backslash are not looked at twice."""
    latin = F.decode(text.cast("binary"), "ISO-8859-1")
    escaped = text.contains("\\")

    def count(pattern: str) -> Column:
        return F.when(escaped, T.count_regex(latin, pattern)).otherwise(F.lit(0).cast("bigint"))

    hexes = count(r"\\x[0-9a-fA-F]{2}")
    unicodes = count(r"(?s)\\u(?=.{4})|\\U(?=.{8})")
    octals = count(r"\\[0-7]")
    return {
        "hex_escape_count": hexes,
        "unicode_escape_count": unicodes,
        "octal_escape_count": octals,
        "escape_density": T.ratio((hexes + unicodes + octals) * 100.0, F.octet_length(text)),
    }


def run_metrics(text: Column) -> dict[str, Column]:
    return {
        "long_token_count": T.count_where(T.words(text), lambda w: F.octet_length(w) > 100),
        "repeated_char_sequences": T.count_regex(text, r"(?s)(.)\1{9,}"),
        "digit_ratio": T.ratio(T.count_regex(text, "[0-9]"), T.count_regex(text, "[0-9A-Za-z]")),
    }


def text_metrics(files: DataFrame) -> DataFrame:
    text = F.col("text")
    families = (line_metrics, char_metrics, byte_metrics, whitespace_metrics, escape_metrics, run_metrics)
    columns = [c.alias(name) for family in families for name, c in family(text).items()]
    return prepared(files).select("file_id", *columns)


# Characters whose entropy is taken in one go; longer strings are counted in such parts.
ENTROPY_CHARS = 1 << 18
CODE_POINTS = 0x110000


def _entropies(values: list[str]) -> np.ndarray:
    """Bits per character of some strings together, 0 for an empty one."""
    out = np.zeros(len(values))
    sizes = np.array([len(v) for v in values], np.int64)
    for i in np.flatnonzero(sizes > ENTROPY_CHARS).tolist():
        parts = (values[i][at : at + ENTROPY_CHARS] for at in range(0, len(values[i]), ENTROPY_CHARS))
        counts = sum(np.bincount(_points(part), minlength=CODE_POINTS) for part in parts)
        p = counts[counts > 0] / sizes[i]
        out[i] = 0.0 - (p * np.log2(p)).sum()
    short = np.flatnonzero(sizes <= ENTROPY_CHARS)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[short]) // ENTROPY_CHARS)) + 1
    for group in np.split(short, cuts):
        owner = np.repeat(np.arange(len(group)), sizes[group])
        keys = np.sort(owner * CODE_POINTS + _points("".join(values[i] for i in group.tolist())))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
        mine = keys[first] // CODE_POINTS
        p = np.diff(np.append(first, len(keys))) / sizes[group][mine]
        out[group] = 0.0 - np.bincount(mine, p * np.log2(p), len(group))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@F.arrow_udf(DoubleType())
def entropies(values: pa.Array) -> pa.Array:
    """`T.char_entropy` of a column of many short strings, equal ones of a batch once."""
    coded = values.dictionary_encode()
    return pa.array(_entropies(coded.dictionary.to_pylist())).take(coded.indices)


STRING_CLASSES = {
    "base64_candidates": T.is_base64_like,
    "hex_strings": T.is_hex_like,
    "url_encoded_strings": T.is_url_encoded,
    "unicode_heavy_strings": T.is_escape_heavy,
    "url_count": T.is_url,
    "path_count": T.is_file_path,
    "ip_count": T.is_ip_address,
    "email_count": T.is_email,
    "domain_count": T.is_domain,
    "embedded_code_candidates": T.has_embedded_code,
    "shell_command_strings": T.has_shell_command,
    "sql_strings": T.has_sql,
}
# Classes that letters and digits alone can make; the others hold some other sign.
WORD_CLASSES = ("base64_candidates", "hex_strings", "shell_command_strings")


def string_metrics(strings: DataFrame) -> DataFrame:
    """Metrics of string rows (file_id, value) per file.

    Equal strings of a file are counted first, so each is measured and tested once.
    """
    value, n = F.col("value"), F.col("_n")
    size = F.octet_length(value)
    filled = value != ""
    counted = strings.groupBy("file_id", "value").agg(F.count("*").alias("_n"))
    tests = {name: F.when(test(value), n).otherwise(F.lit(0)).alias(name) for name, test in STRING_CLASSES.items()}
    words = [F.when(filled, tests[name]).otherwise(F.lit(0)).alias(name) for name in WORD_CLASSES]
    signs = F.when(value.rlike("[^A-Za-z0-9]"), F.struct(*[c for name, c in tests.items() if name not in WORD_CLASSES]))
    measured = counted.select("file_id", "value", "_n", F.when(filled, entropies(value)).alias("_entropy"), *words, signs.alias("_signs"))
    e, filled_n = F.col("_entropy"), F.sum(F.when(filled, n))
    of = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    mean = F.sum(e * n) / filled_n
    spread = F.sqrt(F.greatest(F.sum(e * e * n) / filled_n - mean * mean, F.lit(0.0)))
    columns = {
        "total": F.sum(n),
        "total_bytes": F.sum(size * n),
        "avg_length": F.sum(size * n) / F.sum(F.when(value.isNotNull(), n)),
        "max_length": F.max(size).cast("bigint"),
        "empty_count": of(~filled),
        "avg_entropy": F.coalesce(mean, F.lit(0.0)),
        "entropy_stddev": F.coalesce(spread, F.lit(0.0)),
        "high_entropy_count": of(e > 5.0),
        "very_high_entropy_count": of(e > 6.5),
        "very_long_strings": of(size > 1000),
    }
    columns.update({name: F.sum(name) if name in WORD_CLASSES else F.coalesce(F.sum(f"_signs.{name}"), F.lit(0)) for name in STRING_CLASSES})
    return measured.groupBy("file_id").agg(*[c.alias(name) for name, c in columns.items()])


def string_class_flags(strings: DataFrame) -> DataFrame:
    """One boolean per string class for every string."""
    return strings.select("*", *[test(F.col("value")).alias(name) for name, test in STRING_CLASSES.items()])


def string_entropy(strings: DataFrame) -> DataFrame:
    return strings.withColumn("entropy", entropies(F.col("value")))


def _is_sequential(s: Column) -> Column:
    stems = "|".join(K.COUNTER_STEMS)
    return s.rlike("^[A-Za-z][0-9]?$") | s.rlike(f"^(?i)({stems})[0-9]$")


def _mostly(s: Column, chars: str, share: float) -> Column:
    return T.count_regex(s, chars) / F.octet_length(s) > share


IDENTIFIER_TESTS = {
    "single_char": lambda s: F.octet_length(s) == 1,
    "all_lowercase": lambda s: s.rlike("^[a-z_]*$"),
    "all_uppercase": lambda s: s.rlike("^[A-Z_]*$"),
    "has_digit": lambda s: s.rlike("[0-9]"),
    "underscore_prefix": lambda s: s.startswith("_"),
    "double_underscore": lambda s: s.startswith("__") & s.endswith("__") & (F.octet_length(s) > 4),
    "numeric_suffix": lambda s: s.rlike(r"(?s)[A-Za-z].*[0-9]\z"),
    "hex_like": lambda s: (F.octet_length(s) >= 6) & (F.octet_length(s) % 2 == 0) & _mostly(s, "[0-9a-fA-F]", 0.9),
    "base64_like": lambda s: (F.octet_length(s) >= 8) & s.rlike("[0-9]") & s.rlike("[A-Z]") & s.rlike("[a-z]")
    & _mostly(s, "[A-Za-z0-9+/=]", 0.95),
    "sequential": _is_sequential,
    "keyboard": lambda s: T.contains_any(F.lower(s), K.KEYBOARD_RUNS),
    "repeated_char": lambda s: (F.octet_length(s) >= 3) & s.rlike(r"^(?s)(.)\1*$"),
}


def identifier_metrics(identifiers: DataFrame, names: str = "names") -> DataFrame:
    """Metrics of the distinct names of each file, from an array of names per file.

    Repeats are dropped in the row, before one row per name is made.
    """
    # The whole array stays behind: beside each of its names it would be copied with every row.
    listed = identifiers.select("file_id", F.size(names).alias("_total"), F.array_distinct(names).alias("_names"))
    unique = listed.select("file_id", "_total", F.explode("_names").alias("name")).withColumn("_entropy", entropies(F.col("name")))
    # The generator keeps the tests out of the aggregation, whose code stays small.
    tested = F.struct(
        F.octet_length("name").alias("size"),
        F.col("_entropy").alias("entropy"),
        *[test(F.col("name")).cast("int").alias(k) for k, test in IDENTIFIER_TESTS.items()],
    )
    unique = unique.select("file_id", "_total", F.explode(F.array(tested)).alias("t"))
    size, n = F.col("t.size"), F.count("*")
    columns = {
        "total": F.max("_total").cast("bigint"),
        "unique_count": n,
        "reuse_ratio": n / F.max("_total"),
        "avg_length": F.avg(size),
        "min_length": F.min(size).cast("bigint"),
        "max_length": F.max(size).cast("bigint"),
        "length_stddev": F.stddev_pop(size),
        "avg_entropy": F.avg("t.entropy"),
        "high_entropy_count": F.count_if(F.col("t.entropy") > 3.5),
    }
    columns.update({f"{k}_count": F.sum(F.col(f"t.{k}")) for k in IDENTIFIER_TESTS})
    for k in ("single_char", "all_lowercase", "all_uppercase", "has_digit"):
        columns[f"{k}_ratio"] = columns[f"{k}_count"] / n
    return unique.groupBy("file_id").agg(*[c.alias(k) for k, c in columns.items()])


def _base64_word(comment: Column) -> Column:
    return F.exists(
        T.words(comment),
        lambda w: (F.octet_length(w) >= 20) & _mostly(w, "[A-Za-z0-9+/=]", 0.9) & w.rlike("[A-Z]") & w.rlike("[a-z]"),
    )


def comment_metrics(files: DataFrame, style: str) -> DataFrame:
    """Metrics of the comments of each text; markers count once per comment."""
    found = files.select("file_id", "text", comment_array(F.col("text"), style).alias("_c"))
    base = found.withColumn("_trimmed", F.filter(F.transform("_c", _trimmed), lambda c: c != ""))
    all_comments, trimmed = F.col("_c"), F.col("_trimmed")
    has = lambda word: T.count_where(trimmed, lambda c: F.upper(c).contains(word))
    lines = T.array_sum(F.transform(all_comments, lambda c: F.size(T.text_lines(c))), "bigint")
    code_lines = F.size(T.text_lines(F.col("text"))) - lines
    columns = {
        "total": F.size(all_comments).cast("bigint"),
        "lines": lines,
        "chars": T.array_sum(F.transform(all_comments, F.octet_length), "bigint"),
        "to_code_ratio": F.when((F.size(all_comments) > 0) & (code_lines > 0), lines / F.nullif(code_lines, F.lit(0))).otherwise(0.0),
        "todo_count": has("TODO"),
        "fixme_count": has("FIXME"),
        "hack_count": has("HACK"),
        "xxx_count": has("XXX"),
        "empty_comments": (F.size(all_comments) - F.size(trimmed)).cast("bigint"),
        "high_entropy_comments": T.count_where(trimmed, lambda c: (F.octet_length(c) > 20) & (T.char_entropy(c) > 4.5)),
        "code_in_comments": T.count_where(trimmed, lambda c: T.count_present(F.lower(c), K.COMMENT_CODE_MARKERS) >= 2),
        "url_in_comments": T.count_where(trimmed, lambda c: T.contains_any(c, ("http://", "https://", "ftp://"))),
        "base64_in_comments": T.count_where(trimmed, _base64_word),
    }
    return base.select("file_id", *[c.alias(name) for name, c in columns.items()])


def function_metrics(functions: DataFrame, total_lines: DataFrame) -> DataFrame:
    """Metrics of function rows, with densities from total_lines(file_id, total_lines)."""
    lines, name, params = F.col("line_count"), F.col("name"), F.col("param_names")
    # Names repeat, so the entropy of each is taken once.
    odd = functions.select("name").filter(name.isNotNull()).distinct().filter(entropies(name) > 3.5).withColumn("_odd", F.lit(1))
    functions = functions.join(F.broadcast(odd) if is_small(odd) else odd, "name", "left")
    named = F.when(name != "", F.octet_length(name))
    flag = lambda c: F.count_if(c)
    agg = functions.groupBy("file_id").agg(
        F.count("*").alias("total"),
        F.avg(lines).alias("avg_length_lines"),
        F.max(lines).cast("bigint").alias("max_length_lines"),
        F.min(lines).cast("bigint").alias("min_length_lines"),
        F.stddev_pop(lines).alias("length_stddev"),
        F.sum(lines).alias("_lines"),
        flag(lines > 100).alias("over_100_lines"),
        flag(lines > 500).alias("over_500_lines"),
        flag(lines <= 1).alias("one_liners"),
        flag(F.col("is_anonymous")).alias("anonymous"),
        flag(F.col("is_async")).alias("async_count"),
        flag(F.col("is_generator")).alias("generator_count"),
        flag(F.col("contains_nested")).alias("nested_functions"),
        F.avg(F.size(params)).alias("avg_params"),
        F.max(F.size(params)).cast("bigint").alias("max_params"),
        flag(F.size(params) == 0).alias("no_params_count"),
        flag(F.size(params) > 7).alias("many_params_count"),
        T.ratio(
            F.sum(T.array_sum(F.transform(params, F.octet_length), "bigint")).cast("double"), F.sum(F.size(params))
        ).alias("avg_param_name_length"),
        F.sum(T.count_where(params, lambda p: F.octet_length(p) == 1)).alias("single_char_params"),
        F.coalesce(F.avg(named), F.lit(0.0)).alias("avg_name_length"),
        flag(F.octet_length(name) == 1).alias("single_char_names"),
        F.count("_odd").alias("high_entropy_names"),
        flag(name.rlike("[A-Za-z].*[0-9]$")).alias("numeric_suffix_names"),
        F.max("nesting_depth").cast("bigint").alias("max_nesting_depth"),
        F.avg("nesting_depth").alias("avg_nesting_depth"),
    )
    joined = agg.join(total_lines, "file_id", "left").withColumn("_n", F.coalesce("total_lines", F.lit(0)))
    return joined.select(
        *[c for c in agg.columns if c != "_lines"],
        (T.ratio(F.col("total"), F.col("_n")) * 100).alias("density_per_100_lines"),
        T.ratio(F.col("_lines"), F.col("_n")).alias("code_in_functions_ratio"),
    )


def import_metrics(imports: DataFrame, stdlib: DataFrame) -> DataFrame:
    """Metrics of import rows; stdlib(file_type, module) lists standard modules.

    Imports are counted per module first, so a file that repeats one module very often
    shrinks before its rows meet.
    """
    module = F.col("symbol")
    per = imports.groupBy("file_id", "file_type", "symbol").agg(
        F.count("*").alias("n"), F.count("library").alias("n_lib")
    )
    std = stdlib.select("file_type", F.col("module").alias("_top"), F.lit(True).alias("_std"))
    joined = per.withColumn("_top", F.substring_index("symbol", ".", 1)).join(std, ["file_type", "_top"], "left")
    n = F.col("n")
    total = lambda test: F.sum(F.when(test, n).otherwise(0))
    is_std = F.col("_std").isNotNull()
    agg = joined.groupBy("file_id").agg(
        F.sum(n).alias("total"),
        F.count("*").alias("unique_modules"),
        total(is_std).alias("stdlib_count"),
        total(~is_std).alias("third_party_count"),
        total(module.startswith(".")).alias("relative_imports"),
        total(T.contains_any(module, ("__import__", "importlib", "require"))).alias("dynamic_imports"),
        total(module.contains("*")).alias("wildcard_imports"),
        F.sum(F.when(module.contains(" as "), n).otherwise(F.col("n_lib"))).alias("aliased_imports"),
    )
    return agg.select(
        "*",
        (F.col("stdlib_count") / F.col("total")).alias("stdlib_ratio"),
        (F.col("third_party_count") / F.col("total")).alias("third_party_ratio"),
        (F.col("relative_imports") / F.col("total")).alias("relative_ratio"),
    )


def ratio_metrics(
    text: DataFrame, strings: DataFrame, identifiers: DataFrame, comments: DataFrame, functions: DataFrame, imports: DataFrame
) -> DataFrame:
    """Ratios across families, 0 where a family is missing or a denominator is 0."""
    named = {"s": strings, "i": identifiers, "c": comments, "f": functions, "m": imports}
    joined = text.select("file_id", F.col("total_lines").alias("lines"))
    for prefix, family in named.items():
        other = family.select("file_id", *[F.col(x).alias(f"{prefix}_{x}") for x in family.columns if x != "file_id"])
        joined = joined.join(other, "file_id", "left")
    col = lambda name: F.coalesce(F.col(name), F.lit(0))
    lines = col("lines")
    log_lines = F.when(lines > 0, F.log2(F.nullif(lines, F.lit(0)))).otherwise(0.0)
    odd_names = sum((col(f"i_{k}_count") for k in ("base64_like", "sequential", "keyboard", "repeated_char")), col("i_hex_like_count"))
    columns = {
        "strings_to_functions_ratio": T.ratio(col("s_total"), col("f_total")),
        "identifiers_to_functions_ratio": T.ratio(col("i_unique_count"), col("f_total")),
        "imports_to_functions_ratio": T.ratio(col("m_total"), col("f_total")),
        "identifier_density": T.ratio(col("i_total"), lines),
        "string_density": T.ratio(col("s_total"), lines),
        "import_density": T.ratio(col("m_total") * 100.0, lines),
        "normalized_function_count": T.ratio(col("f_total"), F.sqrt(lines)),
        "normalized_import_count": T.ratio(col("m_total"), F.sqrt(lines)),
        "normalized_string_count": T.ratio(col("s_total"), F.sqrt(lines)),
        "normalized_unique_identifiers": T.ratio(col("i_unique_count"), log_lines),
        "suspicious_identifier_ratio": T.ratio(odd_names, col("i_unique_count")),
        "encoded_string_ratio": T.ratio(col("s_base64_candidates") + col("s_hex_strings") + col("s_url_encoded_strings"), col("s_total")),
        "suspicious_string_ratio": T.ratio(
            col("s_embedded_code_candidates") + col("s_shell_command_strings") + col("s_sql_strings"), col("s_total")
        ),
        "suspicious_comment_ratio": T.ratio(col("c_high_entropy_comments") + col("c_base64_in_comments"), col("c_total")),
        "dynamic_import_ratio": T.ratio(col("m_dynamic_imports"), col("m_total")),
        "anonymous_function_ratio": T.ratio(col("f_anonymous"), col("f_total")),
    }
    return joined.select("file_id", *[c.cast("double").alias(name) for name, c in columns.items()])


def byte_entropy(content: Column) -> Column:
    """Entropy of bytes, read as Latin-1 characters so every byte is one of them."""
    return T.char_entropy(F.decode(content, "ISO-8859-1"))
