"""The operators over the public tables, with the columns their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import chat, exact, html, mixing, packing, quality, simhash, token_store, warc, winnow
from folium.llm._io import materialize, table
from folium.llm.tokens import tokenizer_file


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_store.verify_store(spark, path)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    captures = warc.assemble(materialize(warc.read_records(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records"))
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.branched(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_store, op2_quality, op3_packing, op4_mixing, op5_winnowing, op6_exact_dedup, op7_html, op8_simhash, op9_warc, op10_preferences, pipeline)}
ORACLES: dict[str, str] = {"op4_mixing": mixing.ORACLE, "op6_exact_dedup": exact.ORACLE, "op9_warc": warc.ORACLE, "op10_preferences": chat.ORACLE}
