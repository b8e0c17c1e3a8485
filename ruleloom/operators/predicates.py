"""Rule conditions as Column tests and as evidence queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.session import local_table
from ruleloom import constants as K
from ruleloom.functions import net, text as T
from ruleloom.operators.windows import first_n_per_group


def quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def matcher(
    value: Column,
    exact: str | None = None,
    substr: str | None = None,
    regex: str | None = None,
    word: str | None = None,
    case_insensitive: bool = False,
) -> Column:
    """Test of one value; the first matcher given decides, and none given matches all."""
    low = F.lower(value) if case_insensitive else value
    flag = "(?i)" if case_insensitive else ""
    if exact is not None:
        return low == (exact.lower() if case_insensitive else exact)
    if substr is not None:
        return low.contains(substr.lower() if case_insensitive else substr)
    if regex is not None:
        return value.rlike(flag + regex)
    if word is not None:
        return value.rlike(flag + r"\b" + quoted(word) + r"\b")
    return F.lit(True)


def hit_count(text: Column, exact=None, substr=None, regex=None, word=None, case_insensitive=False) -> Column:
    """How often a matcher hits in whole content; an exact matcher compares all of it."""
    flag = "(?i)" if case_insensitive else ""
    if exact is not None:
        return matcher(text, exact=exact, case_insensitive=case_insensitive).cast("bigint")
    if substr is not None:
        if case_insensitive:
            return T.count_literal(F.lower(text), substr.lower())
        return T.count_literal(text, substr)
    pattern = regex if regex is not None else r"\b" + quoted(word) + r"\b"
    return T.count_regex(text, flag + pattern)


def not_excepted(value: Column, exceptions: list[dict]) -> Column:
    """False for values an exception covers; exact and substring ignore case."""
    out = F.lit(True)
    for e in exceptions:
        if "exact" in e:
            out = out & (F.lower(value) != e["exact"].lower())
        elif "substr" in e:
            out = out & ~F.lower(value).contains(e["substr"].lower())
        elif "regex" in e:
            out = out & ~value.rlike(e["regex"])
    return out


def string_evidence(
    strings: DataFrame, external_ip: bool = False, exceptions: list[dict] | None = None, **how
) -> DataFrame:
    """Strings that match; `external_ip` asks for a public address in the value."""
    value = F.col("value")
    test = matcher(value, **how) & not_excepted(value, exceptions or [])
    if external_ip:
        test = test & net.contains_external_ip(value)
    return strings.filter(test)


def raw_evidence(files: DataFrame, **how) -> DataFrame:
    """Files whose content matches, with the number of hits."""
    return files.withColumn("hits", hit_count(F.col("text"), **how)).filter(F.col("hits") > 0)


def symbol_evidence(symbols: DataFrame, exceptions: list[dict] | None = None, **how) -> DataFrame:
    name = T.normalize_symbol(F.col("symbol"))
    return symbols.filter(matcher(name, **how) & not_excepted(name, exceptions or []))


def encoded_evidence(strings: DataFrame, encodings: list[str] | None = None, **how) -> DataFrame:
    """Decoded strings, of any encoding or of the given ones."""
    chain = F.col("encoding_chain")
    wanted = F.arrays_overlap(chain, F.array(*map(F.lit, encodings))) if encodings else F.size(chain) > 0
    return strings.filter(wanted & matcher(F.col("value"), **how))


# -- structured values --------------------------------------------------------------------


def json_path(path: str) -> str:
    return "$." + path


def kv_values(json: Column, path: str) -> Column:
    """Values at a path as strings; `[*]` fans out over arrays."""
    found = F.get_json_object(json, json_path(path))
    if "[*]" not in path:
        return F.array_compact(F.array(found))
    as_list = F.from_json(found, "array<string>")
    return F.when(found.isNull(), F.array().cast("array<string>")).otherwise(
        F.when(found.startswith("["), as_list).otherwise(F.array(found))
    )


def kv_size(value: Column) -> Column:
    """Number of items of a JSON array or keys of an object; null for scalars."""
    return F.coalesce(F.json_array_length(value), F.size(F.json_object_keys(value)))


def kv_test(
    json: Column, path: str, exists: bool | None = None, size_min: int | None = None,
    size_max: int | None = None, **how,
) -> Column:
    """Whether a structured file meets a condition; any value at the path may."""
    values = kv_values(json, path)
    if exists is False:
        return F.size(values) == 0

    def one(v: Column) -> Column:
        if size_min is not None or size_max is not None:
            n = F.when(v.rlike(r"^\s*\["), F.json_array_length(v)).when(
                v.rlike(r"^\s*\{"), F.size(F.json_object_keys(v))
            )
            ok = n.isNotNull()
            ok = ok & (n >= size_min) if size_min is not None else ok
            return F.coalesce(ok & (n <= size_max) if size_max is not None else ok, F.lit(False))
        as_items = F.when(v.rlike(r"^\s*\["), F.from_json(v, "array<string>")).otherwise(F.array(v))
        return F.exists(as_items, lambda x: matcher(x, **how)) | matcher(v, **how)

    return F.exists(values, one)


# -- bytes ----------------------------------------------------------------------------------


def hex_pattern(pattern: str) -> str:
    """A byte pattern (`4D 5A ?? [2-4]`) as a regex over Latin-1 characters."""
    out = []
    for part in pattern.split():
        gap = re.fullmatch(r"\[(\d+)(?:-(\d+))?\]", part)
        if gap:
            out.append(".{%s,%s}" % (gap.group(1), gap.group(2) or gap.group(1)))
        elif part == "??":
            out.append("(.)")
        else:
            out.append(r"\x" + part.upper())
    return "(?s)" + "".join(out)


def hex_hits(content: Column, pattern: str) -> Column:
    """The byte runs that match, as hex."""
    latin = F.decode(content, "ISO-8859-1")
    found = F.regexp_extract_all(latin, F.lit(hex_pattern(pattern)), F.lit(0))
    return F.transform(found, lambda h: F.hex(F.encode(h, "ISO-8859-1")))


# -- bounds -----------------------------------------------------------------------------------


def within(value: Column, low=None, high=None) -> Column:
    out = value.isNotNull()
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return out


def density_ok(
    hits: Column, size_bytes: Column, count_min=None, count_max=None, per_kb_min=None, per_kb_max=None
) -> Column:
    """Count and hits-per-kilobyte bounds; an empty file skips the density test."""
    per_kb = hits / F.nullif(size_bytes / 1024.0, F.lit(0.0))
    dense = within(per_kb, per_kb_min, per_kb_max) if per_kb_min is not None or per_kb_max is not None else F.lit(True)
    return within(hits, count_min, count_max) & ((size_bytes == 0) | F.coalesce(dense, F.lit(True)))


def metric_hits(metrics_long: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rules (rule_id, field, v_min, v_max) whose metric is within bounds."""
    v = F.col("value")
    ok = (F.col("v_min").isNull() | (v >= F.col("v_min"))) & (F.col("v_max").isNull() | (v <= F.col("v_max")))
    return metrics_long.join(bounds, "field").filter(ok)


# -- sections ----------------------------------------------------------------------------------


def section_evidence(
    sections: DataFrame, length_min=None, length_max=None, entropy_min=None, entropy_max=None,
    readable=None, writable=None, executable=None, **how,
) -> DataFrame:
    """Sections by name, length, entropy and permissions; missing permissions fail."""
    test = matcher(F.col("name"), **how) & within(F.col("size"), length_min, length_max)
    if entropy_min is not None or entropy_max is not None:
        test = test & within(F.col("entropy"), entropy_min, entropy_max)
    for flag, letter in ((readable, "r"), (writable, "w"), (executable, "x")):
        if flag is not None:
            has = F.col("permissions").contains(letter)
            test = test & (has if flag else ~has)
    return sections.filter(F.coalesce(test, F.lit(False)))


def section_ratio(sections: DataFrame, pattern: str, compare_to: str, low=None, high=None) -> DataFrame:
    """Files where matching sections' share of all (or of other matching) bytes is in bounds."""
    mine = F.when(F.col("name").rlike(pattern), F.col("size"))
    base = F.col("size") if compare_to == "total" else F.when(F.col("name").rlike(compare_to), F.col("size"))
    sums = sections.groupBy("file_id").agg(F.sum(mine).alias("part"), F.sum(base).alias("whole"))
    share = F.col("part") / F.nullif(F.col("whole"), F.lit(0))
    return sums.withColumn("ratio", share).filter(F.col("part").isNotNull() & within(F.col("ratio"), low, high))


def counted_per_file(
    files: DataFrame, facts: DataFrame, sample: str, low=None, high=None
) -> DataFrame:
    """Files whose number of facts is in bounds, files without any counting 0.

    The sample holds the five smallest distinct values. Facts are counted per value
    first, so a file with very many rows is reduced before it meets in one group.
    """
    per_value = facts.groupBy("file_id", F.col(sample).alias("_v")).agg(F.count("*").alias("_n"))
    total = F.coalesce("_total", F.lit(0)).cast("bigint")
    totals = per_value.groupBy("file_id").agg(F.sum("_n").alias("_total"))
    few = first_n_per_group(per_value.filter(F.col("_v").isNotNull()).select("file_id", "_v"), ["file_id"], [F.col("_v")], 5)
    samples = few.groupBy("file_id").agg(F.array_sort(F.collect_list("_v")).alias("sample"))
    return (
        files.select("file_id")
        .join(totals, "file_id", "left")
        .join(samples, "file_id", "left")
        .select("file_id", total.alias("n"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))
        .filter(within(F.col("n"), low, high))
    )


def import_combination(
    symbols: DataFrame, required: list[str], suspicious: list[str], min_suspicious: int | None = None,
    max_total: int | None = None,
) -> DataFrame:
    """Files importing every required pattern, enough suspicious ones and not too many."""
    imports = symbols.filter(F.col("kind") == "import")
    name = F.col("symbol")
    agg = [F.count("*").alias("total")]
    agg += [F.bool_or(name.rlike(p)).alias(f"_r{i}") for i, p in enumerate(required)]
    hits = [F.sum(name.rlike(p).cast("bigint")) for p in suspicious]
    total_hits = hits[0] if hits else F.lit(0).cast("bigint")
    for h in hits[1:]:
        total_hits = total_hits + h
    agg.append(total_hits.alias("suspicious"))
    out = imports.groupBy("file_id").agg(*agg)
    test = F.lit(True)
    for i in range(len(required)):
        test = test & F.col(f"_r{i}")
    if min_suspicious is not None:
        test = test & (F.col("suspicious") >= min_suspicious)
    if max_total is not None:
        test = test & (F.col("total") <= max_total)
    return out.filter(test).select("file_id", "total", "suspicious")


def syscall_evidence(
    syscalls: DataFrame, names: list[str] | None = None, numbers: list[int] | None = None,
    arches: list[str] | None = None,
) -> DataFrame:
    test = F.lit(True)
    if names:
        test = test & F.col("name").isin(*names)
    if numbers:
        test = test & F.col("number").isin(*numbers)
    if arches:
        test = test & T.contains_any(F.lower("arch"), [a.lower() for a in arches])
    return syscalls.filter(test)


def structure_evidence(structure: DataFrame, feature: str, min_sections: int | None = None) -> DataFrame:
    """Files with a structural feature, or one under it, at least so often."""
    under = (F.col("feature_id") == feature) | F.col("feature_id").startswith(feature + "/")
    counts = structure.filter(under).groupBy("file_id").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= (min_sections or 1))


# -- location --------------------------------------------------------------------------------


def absolute(offset: Column, size: Column) -> Column:
    """A negative offset counts from the end."""
    return F.when(offset < 0, F.greatest(size + offset, F.lit(0))).otherwise(offset)


def in_range(offset: Column, size: Column, low: int, high: int | None = None) -> Column:
    lo = absolute(F.lit(low), size)
    hi = absolute(F.lit(high), size) if high is not None else size
    return (offset >= lo) & (offset < F.least(hi, size))


def section_aliases(spark) -> DataFrame:
    rows = [(alias, name, i) for alias, names in K.SECTION_ALIASES.items() for i, name in enumerate(names, 1)]
    rows += [(name, name, 0) for names in K.SECTION_ALIASES.values() for name in names]
    return local_table(spark, rows, "wanted string, name string, prio int")


def section_bounds(sections: DataFrame, wanted: str) -> DataFrame:
    """Start and end of the section a name means: exact first, then its aliases in order."""
    names = (wanted, *K.SECTION_ALIASES.get(wanted, ()))
    prio = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    return (
        sections.filter(F.col("name").isin(*names))
        .groupBy("file_id")
        .agg(F.min_by(F.struct("start", "end"), F.struct(prio, "start", "end")).alias("b"))
        .select("file_id", F.col("b.start").alias("lo"), F.col("b.end").alias("hi"))
    )


def strings_in_section(
    strings: DataFrame, sections: DataFrame, wanted: str, low: int = 0, high: int | None = None
) -> DataFrame:
    """Strings between two offsets relative to a section."""
    b = section_bounds(sections, wanted).withColumn("_size", F.col("hi") - F.col("lo"))
    lo = F.col("lo") + absolute(F.lit(low), F.col("_size"))
    hi = F.col("lo") + (absolute(F.lit(high), F.col("_size")) if high is not None else F.col("_size"))
    return (
        strings.join(b, "file_id")
        .filter((F.col("offset") >= lo) & (F.col("offset") < hi))
        .drop("lo", "hi", "_size")
    )


# -- gates ------------------------------------------------------------------------------------

BINARY_ONLY = ("section", "section_ratio", "structure")
BINARY_TYPES = ("elf", "macho", "pe", "dll", "so", "dylib")
SOURCE_ONLY = ("ast",)


def can_match(ctype: Column, file_type: Column) -> Column:
    """Whether a condition kind can apply to a file type."""
    source = file_type.isin(
        "shell", "batch", "python", "javascript", "typescript", "ruby", "php", "perl", "lua",
        "powershell", "java", "c", "rust", "go", "csharp", "swift", "objectivec", "groovy",
        "scala", "zig", "elixir", "applescript",
    )
    return (
        F.when(ctype.isin(*BINARY_ONLY), file_type.isin(*BINARY_TYPES))
        .when(ctype.isin(*SOURCE_ONLY), source)
        .otherwise(F.lit(True))
    )


def platform_ok(rule: Column, context: Column) -> Column:
    return F.array_contains(rule, "all") | F.array_contains(context, "all") | F.arrays_overlap(rule, context)


def size_ok(size: Column, low: Column, high: Column) -> Column:
    return (low.isNull() | (size >= low)) & (high.isNull() | (size <= high))


def skip_reason(
    platforms: Column, context: Column, types: Column, file_type: Column, size: Column, size_min: Column,
    size_max: Column, unless_hit: Column, hits: Column, count_min: Column, per_kb_min: Column,
) -> Column:
    """Why a rule did not fire on a file, first failing gate first; `matched` if none did."""
    return (
        F.when(~platform_ok(platforms, context), "platform")
        .when(~(F.array_contains(types, "all") | F.array_contains(types, file_type)), "file_type")
        .when(size < size_min, "size_too_small")
        .when(size > size_max, "size_too_large")
        .when(unless_hit, "unless")
        .when(hits == 0, "no_match")
        .when(hits < count_min, "count")
        .when((size > 0) & (hits / (size / 1024.0) < per_kb_min), "density")
        .otherwise("matched")
    )


def match(facts: DataFrame, kind: str, count_min: int = 1, count_max: int | None = None, **how) -> DataFrame:
    """Ad-hoc query: files where one condition matches, with the number of hits.

    `kind` is string, symbol, raw or basename; `how` holds one matcher.
    """
    if kind == "raw":
        hits = facts.select("file_id", hit_count(F.col("text"), **how).alias("hits"))
    else:
        column = {"string": "value", "symbol": "symbol", "basename": "basename"}[kind]
        hits = facts.filter(matcher(F.col(column), **how)).groupBy("file_id").agg(F.count("*").alias("hits"))
    return hits.filter(within(F.col("hits"), count_min, count_max))


def fails_at(report: DataFrame, level: int) -> DataFrame:
    """At most one file at or above a criticality: enough to fail a run."""
    return report.filter(F.col("max_crit") >= level).limit(1)


def outside_libraries(files: DataFrame) -> DataFrame:
    """Container members that are not part of a well-known library."""
    return files.filter(~T.contains_any(F.col("path"), K.LIBRARY_PARTS))
