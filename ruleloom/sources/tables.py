"""Readers that turn stored tables into the `files` fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.session import tune

TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small_scan(df) if name in TEXT_TABLES else df


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Give a text scan with fewer splits than cores one partition per core.

    A text table of a few row groups would run its per-row work on a few cores. With
    as many splits as cores, the usual case on a cluster, the scan is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def files_from_documents(documents: DataFrame) -> DataFrame:
    """files(file_id, path, basename, file_type, size_bytes, sha256, text)."""
    base = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select(
        F.col("doc_id").alias("file_id"),
        F.concat_ws("/", "source", "lang", base).alias("path"),
        base.alias("basename"),
        F.col("lang").alias("file_type"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        "text",
    )
