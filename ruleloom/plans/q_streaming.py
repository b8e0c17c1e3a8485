"""Streaming queries, run over all available input, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.plans.q_findings import CLAUSES, DOC_COMPOSITES, doc_findings, doc_report, doc_rules, order_report
from ruleloom.plans.registry import query
from ruleloom.plans.rules import base_findings
from ruleloom.plans.tables import files
from ruleloom.session import ensure_checkpoint_dir, local_table
from ruleloom.sources import sinks
from ruleloom.streaming import scan as S


def work_folder(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def stream_of(spark, sf_dir, table):
    """A table as a stream; the pattern lets one file stand where a folder usually does."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")


def event_stream(spark, sf_dir):
    return stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def doc_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return S.document_stream(spark, f"{sf_dir}/documents.parque[t]", schema)


def string_rules(spark):
    """Rules of the catalog that need no count, so a hit is a finding."""
    return doc_rules(spark).filter(
        (F.col("ctype") == "string") & F.col("count_min").isNull() & F.array_contains("for_types", "all")
    )


HITS = """SELECT file_id, rule_id, crit, hits FROM doc_atomic WHERE rule_id IN (
  'micro-behaviors/net/address::external-ip', 'micro-behaviors/net/address::mail', 'micro-behaviors/data/secret::hex-run', 'micro-behaviors/data/secret::token-word',
  'micro-behaviors/data/secret::card-number', 'micro-behaviors/text/part::tion', 'micro-behaviors/text/part::mail-host')"""


@query("str1_continuous_scan", HITS, "doc_atomic")
def continuous_scan(spark, sf_dir):
    out = work_folder(spark)
    hits = S.run_to_table(S.stateless_hits(doc_stream(spark, sf_dir), string_rules(spark)), f"{out}/data", f"{out}/state")
    return hits.groupBy("file_id", "rule_id", "crit").agg(F.count("*").alias("hits"))


@query("str2_jsonl_stream", HITS.replace("SELECT file_id, rule_id, crit, hits", "SELECT rule_id, CAST(sum(hits) AS BIGINT) AS lines") + " GROUP BY 1", "doc_atomic")
def jsonl_stream(spark, sf_dir):
    out = work_folder(spark)
    lines = S.result_rows(doc_stream(spark, sf_dir), string_rules(spark))
    lines.writeStream.format("text").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema("rule_id string, file_id bigint").json(f"{out}/data")
    return written.groupBy("rule_id").agg(F.count("*").alias("lines"))


@query("str3_alert_stream", HITS.replace("SELECT file_id, rule_id, crit, hits FROM doc_atomic WHERE", "SELECT file_id, rule_id, hits FROM doc_atomic WHERE crit >= 2 AND"), "doc_atomic")
def alert_stream(spark, sf_dir):
    out = work_folder(spark)
    found = S.alerts(S.stateless_hits(doc_stream(spark, sf_dir), string_rules(spark)), K.SUSPICIOUS)
    return S.run_to_table(found, f"{out}/data", f"{out}/state").groupBy("file_id", "rule_id").agg(F.count("*").alias("hits"))


@query("str4_composite_stream", "SELECT file_id, rule_id, crit, conf FROM doc_findings", "doc_findings")
def composite_stream(spark, sf_dir):
    out = work_folder(spark)
    rules = local_table(spark, [(c["id"], c["crit"], c["conf"], c.get("needs"), None, None, ["all"], None, None) for c in DOC_COMPOSITES],
                        "rule_id string, crit int, conf double, needs int, near_lines int, near_bytes int, for_types array<string>, size_min bigint, size_max bigint")
    conds = local_table(spark, [(c["id"], cl, i, ref) for c in DOC_COMPOSITES for cl in CLAUSES for i, ref in enumerate(c.get(cl, []))],
                        "rule_id string, clause string, idx int, ref_id string")
    S.scan_stream(doc_stream(spark, sf_dir), doc_rules(spark), rules, conds, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.schema("file_id bigint, rule_id string, crit int, conf double").parquet(f"{out}/data").select("file_id", "rule_id", "crit", "conf")


@query("str5_seen_once", "SELECT sha256, count(*) AS n FROM (SELECT DISTINCT sha256 FROM files) GROUP BY 1", "files")
def seen_once(spark, sf_dir):
    out = work_folder(spark)
    timed = doc_stream(spark, sf_dir).select("file_id", "sha256", F.timestamp_seconds(F.col("file_id") + 1700000000).alias("ts"))
    kept = S.run_to_table(S.seen_once(timed, "ts", "30 days"), f"{out}/data", f"{out}/state")
    return kept.groupBy("sha256").agg(F.count("*").alias("n"))


@query("str6_severity_counts", """
SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def severity_counts(spark, sf_dir):
    out = work_folder(spark)
    counts = S.severity_counts(event_stream(spark, sf_dir), "ts", "10 minutes", "1 hour")
    return S.run_to_table(counts, f"{out}/data", f"{out}/state", mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str6_user_sessions", """
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (
    SELECT user_id, ts, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '2 hours', TRUE))::INT AS fresh FROM events)) GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    out = work_folder(spark)
    sessions = S.user_sessions(event_stream(spark, sf_dir), "ts", "2 hours", "1 hour")
    back = S.run_to_table(sessions, f"{out}/data", f"{out}/state", mode="complete")
    return back.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# -- sinks ------------------------------------------------------------------------------------------


@query("snk1_result_lines", """
SELECT 'file' AS type, path, risk, (SELECT count(*) FROM doc_findings f WHERE f.file_id = r.file_id) AS n_findings, NULL::BIGINT AS files_analyzed FROM doc_report r
UNION ALL SELECT 'summary', NULL, NULL, NULL, count(*) FROM doc_report""", "doc_report doc_findings")
def result_lines(spark, sf_dir):
    """Written as text and read back line by line."""
    out = work_folder(spark)
    found = doc_findings(spark, sf_dir)
    report = sinks_report(spark, sf_dir, found)
    sinks.write_result_lines(report, found, out)
    value = F.col("value")
    field = lambda name: F.get_json_object(value, f"$.{name}")
    return spark.read.text(out).select(
        field("type").alias("type"), field("path").alias("path"), field("risk").alias("risk"),
        F.json_array_length(field("findings")).cast("bigint").alias("n_findings"), field("files_analyzed").cast("bigint").alias("files_analyzed"),
    )


def sinks_report(spark, sf_dir, found):
    from ruleloom.operators.findings import file_report

    return file_report(files(spark, sf_dir).select("file_id", "path"), found)


@query("snk2_sample_export", """
SELECT sha256, substr(sha256, 1, 2) AS sha_prefix, min(file_id) AS file_id, CAST(max(size_bytes) AS BIGINT) AS n_bytes FROM files
WHERE file_id IN (SELECT file_id FROM doc_atomic WHERE crit >= 2) GROUP BY 1""", "files doc_atomic")
def sample_export(spark, sf_dir):
    from ruleloom.plans.q_findings import doc_atomic

    out = work_folder(spark)
    sinks.write_samples(files(spark, sf_dir), doc_atomic(spark, sf_dir), K.SUSPICIOUS, out)
    back = spark.read.parquet(out)
    return back.select("sha256", F.col("sha_prefix").cast("string").alias("sha_prefix"), "file_id", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("snk3_minimized_report", "SELECT file_id, file_type, size_bytes, risk, hostile, suspicious, notable, max_crit FROM order_report", "order_report")
def minimized_report(spark, sf_dir):
    strings = base_findings(spark, sf_dir).groupBy("file_id").agg(F.collect_set("value").alias("strings"))
    verbose = order_report(spark, sf_dir).join(strings, "file_id", "left")
    return sinks.minimized(verbose)
