"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import crc_mod5, spare, stored, table
from quillon.llm.lines import dedup_lines
from quillon.llm.mixing import mix, stepped_weights
from quillon.llm.packing import pack_documents_ordered
from quillon.llm.quality import score, train
from quillon.llm.similar import similar_dedup

THRESHOLD = 0.3
MIN_SITES = 10
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores below THRESHOLD go. It learns from the labels outside the held-out fold."""
    model = train(docs, table(spark, sf_dir, "labels"), where=crc_mod5(F.col("doc_id")) != 0)
    (name,) = spare(docs, "score")
    return score(docs, model, score_col=name).where(F.col(name) >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on MIN_SITES sources or more stay in their first document only; no document goes. n_chars follows the text."""
    out = dedup_lines(docs, MIN_SITES)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 of five-word shingles, the document with the smallest id stays.

    SimHash's byte-position index with count filtering finds links first, prefix filtering exactly those that it misses.
    """
    return similar_dedup(docs, SIMILARITY, n_words=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mix(docs, stepped_weights(docs), block_docs=4)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens, which follow the order of the documents."""
    return pack_documents_ordered(docs, size=1024)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A linear-chain CRF and a BPE tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
