from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from quillon.llm import quality as Q
from quillon.llm.common import crc_mod5
from quillon.llm.lines import line_dedup_sql
from quillon.llm.packing import tokenizer_path
from test_similar import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source").collect()))


def test_columns(steps):
    names = steps["documents"].columns
    assert all(steps[n].columns == names for n, _ in C.STAGES[:-1])


def test_quality_keeps_what_the_model_accepts(spark, steps):
    model = Q.train(steps["documents"], spark.read.parquet(f"{SF}/labels.parquet"), where=crc_mod5(Q.F.col("doc_id")) != 0)
    before = rows(steps["documents"])
    score = model.scores(pa.array([r[1] for r in before]))
    assert rows(steps["quality"]) == [r for r, s in zip(before, score) if s >= 0.3]
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    kept = {r[0] for r in rows(steps["quality"])}
    known = [i for i, *_ in before if i in labels]
    assert np.mean([(i in kept) == labels[i] for i in known]) > 0.97


def test_line_dedup_against_sql(steps):
    con = duckdb.connect()
    con.register("documents", steps["quality"].toPandas())
    want = con.execute(f"SELECT doc_id, text FROM ({line_dedup_sql(C.MIN_SITES)}) ORDER BY 1").fetchall()
    assert [(r[0], r[1]) for r in rows(steps["line_dedup"])] == want


def test_near_dedup_against_brute_force(steps):
    before = rows(steps["line_dedup"])
    leads = brute([(r[0], r[1]) for r in before])
    assert rows(steps["near_dedup"]) == [r for r in before if r[0] in leads]


def test_mixing_keeps_every_row(steps):
    assert rows(steps["mixing"]) == rows(steps["near_dedup"])


def test_packing_against_the_tokenizer(steps):
    tok, got = Tokenizer.from_file(tokenizer_path()), steps["packing"].collect()
    want = Counter()
    for i, text, *_ in rows(steps["mixing"]):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got) == want
    fill = Counter()
    for g in got:
        fill[g.sequence_id] += g.length
    assert max(fill.values()) <= 1024


def test_run(spark, steps):
    assert C.run(spark, SF).count() == steps["packing"].count()


def test_packed_prefixes_hold_the_weights(spark, tmp_path):
    """What mixing decides shows in the packed sequences: each prefix has the target shares but for one span of 1,024 documents."""
    rows = [(i, " ".join([f"w{i}"] * (5 + i * 7919 % 40)), "en", f"s{i % 4}") for i in range(16_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    stages = dict(C.STAGES)
    stages["mixing"](spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    got = stages["packing"](spark, mixed, SF).orderBy("sequence_id", "offset").collect()
    assert Counter(g.doc_id for g in got if g.start == 0) == Counter(range(16_000))
    seen = Counter()
    for n, g in enumerate((g for g in got if g.start == 0), 1):
        seen[g.doc_id % 4] += 1
        if n <= 9_000:  # the last source, 4 of 10 shares, has 4,000 documents
            assert all(abs(seen[s] - n * (s + 1) / 10) <= 300 for s in range(4)), (n, seen)
    assert len({g.sequence_id for g in got}) == 1 + max(g.sequence_id for g in got)
    fill = Counter()
    for g in got:
        assert g.offset == fill[g.sequence_id]
        fill[g.sequence_id] += g.length
    assert max(fill.values()) <= 1024 and sum(fill.values()) > 0.99 * 1024 * len(fill)
    # the order comes from the files, not from the documents
    other = stages["packing"](spark, docs.orderBy("doc_id"), SF)
    first = [r.doc_id for r in other.where("sequence_id = 0").collect()]
    assert max(first) < 1024
