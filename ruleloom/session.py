"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app: str = "ruleloom", cores: int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster supplies its own."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RULELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


# Generated methods over 8000 bytes are never compiled by the JVM, which makes wide
# aggregations several times slower than running without whole-stage code.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def tune(spark: SparkSession) -> None:
    """Lower the limit for generated methods, unless the session sets its own."""
    key, default, better = HUGE_METHOD
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, better)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's setting wins, always.

    Only a local session that names none gets a temporary folder; a cluster
    without the setting is an error, since executors cannot share local disk.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="ruleloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and read that instead.

    Lost executors then cost a re-read, not a re-run of every earlier step. Unlike an
    RDD checkpoint this runs the plan once, with adaptive execution.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table of literal rows, kept in the plan instead of a job of its own."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    names = arrow.names
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(names, tuple(r))) for r in rows], schema=arrow), schema
    )
