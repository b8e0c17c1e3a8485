"""Findings: merging, caps, per-file risk, summaries and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import ids, text as T
from ruleloom.operators.extract import import_ecosystem, small_table
from ruleloom.operators.windows import first_n_per_group


def first_per_id(findings: DataFrame, order: list[str]) -> DataFrame:
    """One finding per file and id, the first by `order`.

    An aggregation with map-side combine, so repeated ids of a hot file never meet.
    """
    rest = [c for c in findings.columns if c not in ("file_id", "rule_id")]
    best = F.min_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return findings.groupBy("file_id", "rule_id").agg(best.alias("_f")).select(
        "file_id", "rule_id", *[F.col(f"_f.{c}").alias(c) for c in rest]
    )


def merge_stages(*stages: DataFrame) -> DataFrame:
    """Findings of successive stages; an id found earlier is kept."""
    out = stages[0].withColumn("stage", F.lit(0))
    for i, s in enumerate(stages[1:], 1):
        out = out.unionByName(s.withColumn("stage", F.lit(i)), allowMissingColumns=True)
    return first_per_id(out, ["stage"])


def add_missing(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing findings and those new ones whose id the file does not have yet."""
    fresh = new.join(existing.select("file_id", "rule_id").distinct(), ["file_id", "rule_id"], "left_anti")
    return existing.unionByName(fresh)


def capped(findings: DataFrame, limit: int = K.MAX_FINDINGS_PER_FILE) -> DataFrame:
    """The most severe findings of each file, by criticality then hundredths of confidence."""
    order = [F.col("crit").desc(), F.floor(F.col("conf") * 100).desc(), F.col("rule_id")]
    return first_n_per_group(findings, ["file_id"], order, limit)


def highest_criticality(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_id").agg(F.max("crit").alias("max_crit"))


def _count_at(level: int) -> Column:
    return F.count_if(F.col("crit") == level)


def file_report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files with risk (none up to inert) and counts of the three upper levels."""
    per_file = findings.groupBy("file_id").agg(
        _count_at(K.HOSTILE).alias("hostile"),
        _count_at(K.SUSPICIOUS).alias("suspicious"),
        _count_at(K.NOTABLE).alias("notable"),
        F.max("crit").alias("max_crit"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return files.join(per_file, "file_id", "left").select(
        *files.columns,
        F.when(F.col("max_crit") > K.INERT, ids.crit_name(F.col("max_crit"))).alias("risk"),
        zero("hostile"),
        zero("suspicious"),
        zero("notable"),
        F.coalesce("max_crit", F.lit(K.FILTERED)).alias("max_crit"),
    )


def corpus_summary(report: DataFrame) -> DataFrame:
    """One row for the whole corpus."""
    return report.agg(
        F.count("*").alias("files"),
        F.max("depth").alias("max_depth"),
        F.sum("hostile").alias("hostile"),
        F.sum("suspicious").alias("suspicious"),
        F.sum("notable").alias("notable"),
        F.max("max_crit").alias("max_crit"),
    )


def rollup_by_directory(findings: DataFrame) -> DataFrame:
    """Best finding per rule directory with all ids matched; internal ones stay as they are.

    The best has the highest criticality, then confidence, then the smallest id.
    """
    internal = F.col("source").isin(*K.INTERNAL_SOURCES)
    rank = F.struct(-F.col("crit"), -F.col("conf"), F.col("rule_id"))
    grouped = (
        findings.filter(~internal)
        .groupBy("file_id", ids.rule_directory(F.col("rule_id")).alias("directory"))
        .agg(
            F.min_by("crit", rank).alias("crit"),
            F.min_by("conf", rank).alias("conf"),
            F.array_sort(F.collect_set("rule_id")).alias("trait_refs"),
        )
    )
    single = findings.filter(internal).select(
        "file_id", F.col("rule_id").alias("directory"), "crit", "conf", F.array().cast("array<string>").alias("trait_refs")
    )
    return grouped.unionByName(single)


def without_low_value(findings: DataFrame, rules: DataFrame, conds: DataFrame) -> DataFrame:
    """Drops findings of composites that any single condition satisfies."""
    sizes = conds.filter(F.col("clause") == "any").groupBy("rule_id").agg(F.count("*").alias("n"))
    low = rules.join(sizes, "rule_id").filter((F.col("n") == 1) | (F.coalesce("needs", F.lit(1)) <= 1))
    return findings.join(low.select("rule_id"), "rule_id", "left_anti")


def import_findings(symbols: DataFrame) -> DataFrame:
    """Inert findings for what files import.

    Programs name their symbols and, per library, how many come from it and the first
    five; other files name modules by ecosystem and the functions their code calls.
    """
    binary = F.col("ecosystem").isin("elf", "macho", "pe")
    name = T.normalize_import_name(F.col("symbol"))
    spark = symbols.sparkSession
    by_type = [(t, g) for g, ts in K.ECOSYSTEM_BY_TYPE.items() for t in ts if g in ("elf", "macho", "pe")]
    machine = small_table(spark, by_type, "file_type string, machine string")
    eco = import_ecosystem(symbols).join(machine, "file_type", "left").withColumn("ecosystem", F.coalesce("machine", "ecosystem"))
    named = eco.withColumn("name", name).filter(F.col("name") != "")
    internal = binary | (F.col("source") == "ast")
    prefix = F.when(internal, "metadata/internal/imported::").otherwise(
        F.concat(F.lit("metadata/import/"), "ecosystem", F.lit("::"))
    )
    single = named.select("file_id", F.concat(prefix, "name").alias("rule_id")).distinct()
    single = single.select("file_id", "rule_id", F.lit(None).cast("bigint").alias("n_symbols"), F.lit(None).cast("string").alias("preview"))
    libs = eco.filter(binary & (F.coalesce("library", F.lit("")) != ""))
    per_symbol = libs.groupBy("file_id", "library", "symbol").agg(F.count("*").alias("n"))
    few = first_n_per_group(per_symbol.filter(F.col("symbol").isNotNull()).select("file_id", "library", "symbol"), ["file_id", "library"], [F.col("symbol")], 5)
    first = few.groupBy("file_id", "library").agg(F.array_sort(F.collect_list("symbol")).alias("first"))
    per_lib = (
        per_symbol.groupBy("file_id", "library")
        .agg(F.sum("n").alias("n_symbols"))
        .join(first, ["file_id", "library"], "left")
        .withColumn("lib", T.normalize_import_name(F.col("library")))
        .filter(F.col("lib") != "")
    )
    library = per_lib.select(
        "file_id", F.concat(F.lit("metadata/dylib::"), "lib").alias("rule_id"), "n_symbols", F.array_join("first", ", ").alias("preview")
    )
    return single.unionByName(library).withColumns({"crit": F.lit(K.INERT), "conf": F.lit(0.95)})


def long_line_findings(files: DataFrame, limit: int = K.LONG_LINE_BYTES) -> DataFrame:
    """Files with a line over the limit, measured in the row."""
    longest = F.array_max(F.transform(T.text_lines(F.col("text")), F.octet_length))
    return (
        files.select("file_id", longest.cast("bigint").alias("longest"))
        .filter(F.col("longest") > limit)
        .withColumns({"rule_id": F.lit("objectives/anti-analysis/long-line::excessive"), "crit": F.lit(K.SUSPICIOUS)})
    )


def function_findings(functions: DataFrame) -> DataFrame:
    """Findings on the shape of functions: complexity and loops."""
    c, n = F.col("complexity"), F.col("loops")
    looped = (c > 10) & (n > 0)
    found = F.array_compact(
        F.array(
            F.when(looped, "complexity/high"),
            F.when(looped & (c > 20), "anti-analysis/obfuscation/control-flow"),
            F.when(n >= 2, "data/encode"),
        )
    )
    return functions.select("file_id", F.explode(found).alias("rule_id")).distinct()


def property_findings(properties: DataFrame) -> DataFrame:
    """Findings on how a program was built; hardening flags are canary, nx and pic."""
    p = F.col
    anomaly = (
        F.when(p("anomaly") == "no_section_header", "anti-analysis/format/no-sections")
        .when(p("anomaly") == "overlapping_functions", "anti-analysis/format/overlapping")
        .when(p("anomaly") == "unusual_entry_point", "anti-analysis/format/entry-point")
        .when(p("anomaly").isNotNull(), "binary/anomaly")
    )
    found = F.array_compact(
        F.array(
            F.when(~p("canary") & ~p("nx") & ~p("pic"), "binary/security/none"),
            F.when(p("stripped"), "anti-analysis/stripped"),
            F.when(p("is_static"), "binary/linking/static"),
            anomaly,
        )
    )
    return properties.select("file_id", F.explode(found).alias("rule_id"))


def signature_evidence(matches: DataFrame) -> DataFrame:
    """Evidence of signature matches: printable matched text, else its label, else the rule."""
    value = F.col("matched")
    shown = F.when(value.rlike(r"^[\x20-\x7E\n\t]+$"), value).otherwise(F.col("label"))
    located = F.when(F.col("label").isNull(), F.col("namespace")).otherwise(
        F.concat(F.lit("offset:0x"), F.lower(F.hex("offset")))
    )
    return matches.select("file_id", "rule", F.coalesce(shown, F.col("rule")).alias("value"), located.alias("location"))


def vendor_rule_id(namespace: Column, name: Column) -> Column:
    """`third_party/vendor/…` id of a vendor's signature, its noise words dropped."""
    vendor = F.replace(F.regexp_replace(namespace, r"^3p\.", ""), F.lit("."), F.lit("/"))
    hashed = name.rlike("_[0-9a-fA-F]{8,}$")
    bare = F.when(hashed, F.regexp_replace(name, "_[^_]*$", "")).otherwise(name)
    bare = F.regexp_replace(bare, "^(?i)(?:(?:malware|mal)_)+", "")
    parts = F.split(bare, "_")
    platform = F.coalesce(F.get(parts, 0), F.lit(""))
    has_platform = platform.isin(*K.VENDOR_PLATFORMS)
    after = F.when(has_platform, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    kind = F.coalesce(F.get(after, 0), F.lit(""))
    has_kind = kind.isin(*K.VENDOR_MALWARE_TYPES)
    rest = F.when(has_kind, F.slice(after, F.lit(2), F.size(after))).otherwise(after)
    typed = F.concat_ws(
        "/", F.when(has_platform, F.lower(platform)), F.when(has_kind, F.lower(kind)), F.nullif(F.lower(F.array_join(rest, "_")), F.lit(""))
    )
    no_cve = F.regexp_replace(bare, r"(?i)(^|_)cve(?:_[0-9-]+)*(?=_|$)", "$1")
    kept = F.filter(F.split(no_cve, "_"), lambda p: ~p.rlike("^[0-9]*$"))
    trailing = "(?i)(?:(?:^|_)(?:" + "|".join(K.VENDOR_TRAILING) + "))+$"
    family = F.lower(F.regexp_replace(F.array_join(kept, "_"), trailing, ""))
    tail = F.when(hashed, typed).otherwise(family)
    return F.concat_ws("/", F.lit("third_party"), vendor, F.nullif(tail, F.lit("")))


def override_criticality(matches: DataFrame, overrides: DataFrame, sources: DataFrame, default: str) -> DataFrame:
    """Criticality of vendor findings: rule override, source default, global default.

    A disabled rule yields nothing.
    """
    o = overrides.select("rule_id", F.col("crit").alias("o_crit"), "disable")
    s = sources.select("vendor", F.col("crit").alias("s_crit"))
    return (
        matches.join(o, "rule_id", "left")
        .join(s, "vendor", "left")
        .filter(~F.coalesce("disable", F.lit(False)))
        .select(*matches.columns, F.coalesce("o_crit", "s_crit", F.lit(default)).alias("crit"))
    )


def symbol_capabilities(symbols: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """Capability of each known symbol, leading underscores ignored."""
    bare = F.regexp_replace("symbol", "^_+", "")
    m = symbol_map.select(F.col("symbol").alias("_bare"), "capability")
    return symbols.withColumn("_bare", bare).join(m, "_bare").drop("_bare")


def rule_costs(runs: DataFrame, threshold_ms: float) -> DataFrame:
    """Time and hits per rule, slowest first, over a threshold."""
    totals = runs.groupBy("rule_id").agg(
        F.sum("elapsed_ms").alias("total_ms"), F.sum("hits").alias("hits"), F.count("*").alias("runs")
    )
    return totals.filter(F.col("total_ms") >= threshold_ms).orderBy(F.col("total_ms").desc(), "rule_id")


def top_files(report: DataFrame, k: int) -> DataFrame:
    """The k riskiest files."""
    order = [F.col("max_crit").desc(), F.col("hostile").desc(), F.col("suspicious").desc(), F.col("notable").desc(), F.col("file_id")]
    return report.orderBy(*order).limit(k)
