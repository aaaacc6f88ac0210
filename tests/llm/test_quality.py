from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quillon.llm import quality as Q


def brute_marginals(score, trans):
    """By all labellings of one chain."""
    n, good, pairs, z = len(score), np.zeros(len(score)), np.zeros((2, 2)), 0.0
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        p = np.exp(sum(s for s, v in zip(score, y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += p
        good += p * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    return good / z, pairs / z, np.log(z)


def test_forward_backward_against_all_labellings():
    r = np.random.default_rng(3)
    sizes = [3, 0, 1, 6, 2, 0]
    first = np.cumsum([0, *sizes])
    score, trans = r.normal(size=first[-1]), r.normal(size=(2, 2))
    good, pairs, z = Q.marginals(score, trans, first)
    want = [brute_marginals(score[a:b], trans) for a, b in zip(first, first[1:]) if b > a]
    assert np.allclose(good, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want))
    assert np.isclose(z, sum(w[2] for w in want))


def test_features_do_not_depend_on_the_batch():
    texts = ["A line.\n\n the same\n the same", None, "", " \n\t", "x", "ÄÖ ** 12 | ! a a a\nend", "w " * 5000]
    x, size, first = Q.line_features(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 0, 1, 2, 1]
    for i, t in enumerate(texts):
        one, s, f = Q.line_features(pa.array([t], pa.string()))
        assert np.allclose(one, x[first[i] : first[i + 1]]) and s.tolist() == size[first[i] : first[i + 1]].tolist()
    assert size[:3].tolist() == [6, 7, 7] and x[1, -1] == x[2, -1] == 1 and x[0, -1] == 0


def corpus(n=300):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abdelnrst") for _ in range(r.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        lines = [" ".join(word() + ("" if good else "$$$") for _ in range(8)) + "." for _ in range(r.randrange(1, 9))]
        docs.append((i, "\n".join(lines), "en", 1.0))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    odd = [(None, "some words here.", None, None), (900, None, "x", 0.0), (901, "", "x", 0.0), (902, "\n \n", "x", 0.0), (1, docs[1][1], "en", 1.0), (903, "long " * 20000, None, None)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, t string, score double").repartition(3)
    y = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    out = Q.classify(df, y)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    assert {x.score for x in rows if x.doc_id in (900, 901, 902)} == {0.0}
    assert [x.held_out for x in rows if x.doc_id is None] == [False]
    truth = dict(labels)
    held = [x for x in rows if x.held_out and x.doc_id in truth]
    assert len(held) > 30 and all(x.predicted == truth[x.doc_id] for x in held)


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x.doc_id: x.score for x in Q.classify(df, none).collect()}[2] == 0
    assert Q.classify(df.limit(0), none).count() == 0
    kept = Q.score(df.withColumn("text_of_row", Q.F.lit(1)), Q.train(df, none))
    assert kept.columns == ["doc_id", "text", "text_of_row", "score"] and kept.count() == 2
