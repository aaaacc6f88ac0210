"""Odd rows through every stage of the pipeline, and the registered queries' shapes."""

from __future__ import annotations

import pytest

import corpus_pipeline as C
from quillon.llm import queries as Q

NAMES = "doc_id long, text string, lang string, source string, n_chars long, k1 int, gone string, key string, slot int, score double, keep string, name string, rank int, bucket int, t string, id int, block int"


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (1, words, "en", "a"), (1, words + " other", "en", "b"), (2, words, None, None), (None, words, "en", "a"), (None, None, None, None), (None, None, None, None),
        (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n \t", "de", "b"), (6, "x " * 30000, "en", "c"), (7, "line\n" * 5000, "en", "c"), (8, "<|endoftext|> été 日本 \U0001d11e", "ja", "d"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "g", "k", 2, 0.5, "x", "n", 3, 4, "t", 5, 6) for r in rows], NAMES).repartition(3)


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_stage_takes_odd_rows(spark, odd, name, stage):
    sf = "/root/testdata/sf0.001"
    got = stage(spark, odd, sf)
    n = got.count()
    if name != "packing":
        assert got.columns == odd.columns
    if name in ("line_dedup", "mixing"):
        assert n == odd.count()
    if name == "near_dedup":
        # the empty ones are one group, texts that differ by one word of sixty may or may not be
        assert 4 <= n <= 7 and got.where("doc_id = 3").count() + got.where("doc_id = 4").count() == 1
    if name == "packing":
        assert n >= odd.count()
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_queries_are_named_and_whole(spark):
    names = list(Q.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(Q.oracle_sql()) <= set(names)


COLUMNS = {
    1: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    2: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    4: {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    5: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    6: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    8: {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    10: {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}
TABLE = {1: "documents", 2: "documents", 4: "pages", 5: "documents", 6: "embeddings"}


@pytest.mark.parametrize("n", COLUMNS)
def test_contract(spark, n):
    name = next(q for q in Q.queries() if q.startswith(f"op{n}_"))
    got = Q.queries()[name](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == COLUMNS[n]
    if n in TABLE:
        assert got.count() == spark.read.parquet(f"/root/testdata/sf0.001/{TABLE[n]}.parquet").count()
