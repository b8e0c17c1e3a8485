"""Writers: result lines, samples and reduced reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.findings import capped

VERBOSE_COLUMNS = ("strings", "symbols", "sections", "paths", "env_vars", "metrics")


def result_lines(report: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON line per file, its findings inside, and one summary line at the end.

    Findings of a file are capped first, the most severe ones stay, so they may be
    collected into its line.
    """
    findings = capped(findings)
    cols = [c for c in findings.columns if c not in ("file_id", "rule_id")]
    item = F.struct(F.col("rule_id").alias("id"), *cols)
    per_file = findings.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    none = F.array().cast(per_file.schema["findings"].dataType)
    line = report.join(per_file, "file_id", "left").withColumn("findings", F.coalesce("findings", none))
    files = line.select(F.to_json(F.struct(F.lit("file").alias("type"), *line.columns)).alias("value"), F.lit(0).alias("part"))
    total = report.agg(
        F.count("*").alias("files_analyzed"), F.sum("hostile").alias("hostile"), F.sum("suspicious").alias("suspicious"), F.sum("notable").alias("notable")
    )
    summary = total.select(F.to_json(F.struct(F.lit("summary").alias("type"), *total.columns)).alias("value"), F.lit(1).alias("part"))
    return files.unionByName(summary)


def write_result_lines(report: DataFrame, findings: DataFrame, path: str) -> None:
    """Result lines as text; the summary goes to a file of its own beside the others."""
    result_lines(report, findings).write.mode("overwrite").partitionBy("part").text(path)


def samples(files: DataFrame, findings: DataFrame, min_crit: int) -> DataFrame:
    """Content of files with a finding at a criticality, keyed by hash, each hash once."""
    wanted = findings.filter(F.col("crit") >= min_crit).select("file_id").distinct()
    # The file that stands for a hash is chosen without its content, which is then read for it only.
    chosen = files.select("file_id", "sha256").join(wanted, "file_id").groupBy("sha256").agg(F.min("file_id").alias("file_id"))
    kept = files.select("file_id", "sha256", F.col("text").alias("content")).join(chosen, ["sha256", "file_id"], "left_semi")
    return kept.withColumn("sha_prefix", F.substr("sha256", F.lit(1), F.lit(2)))


def write_samples(files: DataFrame, findings: DataFrame, min_crit: int, path: str) -> None:
    samples(files, findings, min_crit).write.mode("overwrite").partitionBy("sha_prefix").parquet(path)


def minimized(report: DataFrame) -> DataFrame:
    """The report without its fact arrays."""
    return report.drop(*VERBOSE_COLUMNS)
