"""The registered queries of the training-data operators: one for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.audio import align_recordings, spoken
from quillon.llm.chat import chat_digest
from quillon.llm.common import table
from quillon.llm.extract import extract
from quillon.llm.lines import dedup_lines, line_dedup_sql
from quillon.llm.mixing import schedule, schedule_sql, stepped_weights
from quillon.llm.packing import pack_documents
from quillon.llm.quality import classify
from quillon.llm.simhash import simhash_components
from quillon.llm.substring import substring_digest
from quillon.llm.vectors import near_dedup


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), n_words=4, bits=4)


MIN_SITES = 10


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_sites=MIN_SITES, counts=True).select("doc_id", "text", "n_lines", "n_removed")


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"), k=20)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"), least=0.98)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return schedule(docs, stepped_weights(docs), block_docs=4)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(chats.union(probe))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has a media column, so every row of `conversations` is spoken: conv_id * 100000 + turn is its recording."""
    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("rec_id"), "text")
    return align_recordings(said, "rec_id", "text", decode=spoken)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), size=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_lines, op4_extract, op5_substring, op6_vectors, op7_mixing, op8_chat, op9_audio, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": line_dedup_sql(MIN_SITES), "op7_mixing": schedule_sql("1 + (i - 1) % 4", 4)}
