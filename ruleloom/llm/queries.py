"""The registered queries: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import ann, bpe, chat, langid, linededup, media, neardup, packing, pii, repair, spelling, toxicity, warc
from ruleloom.llm.common import documents
from ruleloom.llm.registry import RUN, SQL, query
from ruleloom.session import local_table

__all__ = ["RUN", "SQL"]


@query("op1_line_dedup", linededup.SPANS_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages removed: where they were, and the document that keeps them."""
    done = linededup.dedup_units(documents(spark, sf_dir))
    spans = done.select("doc_id", F.explode("removed").alias("r"))
    return spans.select("doc_id", "r.start", "r.end", "r.words", F.col("r.holder").alias("kept_doc_id"))


@query("op2_tool_calls", chat.SQL)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls and results of every conversation, linked, ordered, validated and serialised."""
    calls, results = chat.of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = local_table(spark, list(chat.SCHEMAS), "tool string, parameter string, type string, required boolean")
    linked = chat.link_calls(calls, results, schemas)
    return linked.select("conv_id", "call_id", "tool", "position", "depth", "result_position", "status", F.array_join("errors", ",").alias("errors"), "json")


@query("op3_seekable_warc")
def seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page into seekable bundles and read the records back by their places."""
    stored = warc.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_bundles(stored)


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack the token pieces of every document into sequences of 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir))


@query("op5_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that disclose it, in every document."""
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


@query("op5_whole_documents")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_personal_data, with shares that are not shrunk where few documents are behind them."""
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir), **pii.UNSHRUNK))


@query("op6_lsh_forest")
def lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return neardup.near_duplicates(documents(spark, sf_dir)).drop("text_hash")


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode its ids, and digest both."""
    coded = bpe.round_trip(documents(spark, sf_dir))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_png_media")
def png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a PNG file, read the files back, test and hash them."""
    stored = media.store_media(documents(spark, sf_dir))
    return media.read_media(stored).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


@query("op8_learned_partitions")
def learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every row whose id is divisible by 20."""
    rows = ann.valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.search(rows, rows.where(F.col("vec_id") % ann.QUERY_STEP == 0), ann.build(rows))


@query("op9_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted to the labelled ones."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.severity(model, "text").alias("s"))
    return scored.select("doc_id", F.round("s.severity", 6).alias("severity"), "s.grade", (F.col("s.severity") >= toxicity.TOXIC_FROM).alias("toxic"))


@query("op11_language_models")
def language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the documents that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    told = langid.predict(docs.drop("lang"), langid.fit(docs))
    held_out = langid.fold("doc_id") == langid.HELD_OUT
    return told.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.round("language.score", 6).alias("score"), F.round("language.bits", 6).alias("bits"), "language.rejected")


@query("op12_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents, the form it is a variant of, and its root."""
    return spelling.group_variants(spelling.vocabulary(documents(spark, sf_dir)))


@query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    return repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
