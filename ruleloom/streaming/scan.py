"""The scan as a stream: rules over arriving rows, composites per batch, running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ruleloom.functions import text as T
from ruleloom.operators import findings as FD
from ruleloom.operators import scan
from ruleloom.operators.composites import evaluate_composites
from ruleloom.session import cut_lineage
from ruleloom.sources.tables import files_from_documents, spread_small_scan


def document_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """Arriving document files as the `files` table, at most so many files per batch."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return files_from_documents(raw)


def stateless_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Atomic string hits of each arriving file, in its own row.

    The catalog is joined as a static table and the hits of a file are counted in the
    row, so the stream keeps no state and may append.
    """
    values = files.select("file_id", "sha256", F.explode(T.tokens(F.col("text"))).alias("value"))
    found = scan.hits_of(values, rules.filter((F.col("ctype") == "string")), "value")
    gate = F.broadcast(rules.select("rule_id", "crit", "conf"))
    return found.select("file_id", "rule_id", "value").join(gate, "rule_id")


def result_rows(files: DataFrame, rules: DataFrame) -> DataFrame:
    """One JSON line per hit, for an append sink."""
    hits = stateless_hits(files, rules)
    return hits.select(F.to_json(F.struct(*hits.columns)).alias("value"))


def alerts(hits: DataFrame, level: int) -> DataFrame:
    return hits.filter(F.col("crit") >= level)


def scan_batch(files: DataFrame, rules: DataFrame, composites: DataFrame, conds: DataFrame) -> DataFrame:
    """All findings of one batch: a file's evidence arrives whole, so composites can run."""
    strings = files.select("file_id", F.explode(T.tokens(F.col("text"))).alias("value"))
    atomic = cut_lineage(scan.atomic_findings(files, strings, rules))  # read by several parts
    none = F.lit(None).cast("bigint")
    combined = evaluate_composites(
        files.select("file_id", "file_type", "size_bytes"), atomic, atomic.withColumns({"line_no": none, "offset": none}), composites, conds
    )
    keep = ["file_id", "rule_id", "crit", "conf"]
    return FD.capped(FD.merge_stages(atomic.select(keep), combined.select(keep)).drop("stage"))


def scan_stream(
    files: DataFrame, rules: DataFrame, composites: DataFrame, conds: DataFrame, out: str, checkpoint: str,
    fail_at: int | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Findings of each batch as parquet under its batch number.

    A batch that is run again after a failure overwrites its own folder, so no finding is
    written twice. With `fail_at`, a finding at that criticality stops the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = scan_batch(spread_small_scan(batch), rules, composites, conds)
        path = f"{out}/batch={number}"
        found.write.mode("overwrite").parquet(path)
        if fail_at is not None and batch.sparkSession.read.parquet(path).filter(F.col("crit") >= fail_at).limit(1).count():
            raise RuntimeError(f"a finding of criticality {fail_at} or above in batch {number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def seen_once(files: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Arriving files whose content was not seen within the watermark delay."""
    return files.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["sha256"])


def severity_counts(events: DataFrame, time_column: str, width: str, delay: str) -> DataFrame:
    """Events per time bucket and kind; rows later than the delay are dropped."""
    bucket = F.window(time_column, width)
    counts = events.withWatermark(time_column, delay).groupBy(bucket, "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(events: DataFrame, time_column: str, gap: str, delay: str) -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    session = F.session_window(time_column, gap)
    counts = events.withWatermark(time_column, delay).groupBy(session, "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all available input and read back what it wrote.

    Complete results are replaced batch by batch; appended ones are written by the sink.
    """
    spark = stream.sparkSession
    stream = transform(stream) if transform else stream
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
