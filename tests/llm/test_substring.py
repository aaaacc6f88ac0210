from __future__ import annotations

import hashlib
import random
import re

import pytest

from quillon.llm import substring as S


def brute(rows, k):
    docs = [(i, j, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for j, (i, t) in enumerate(rows)]
    first, out = {}, []
    for i, _, ws in docs:
        for s in range(len(ws) - k + 1):
            w = tuple(ws[s : s + k])
            at = (i is None, i or 0, s)
            first[w] = min(first.get(w, at), at)
    for i, _, ws in docs:
        gone = [False] * len(ws)
        for s in range(len(ws) - k + 1):
            if first[tuple(ws[s : s + k])] != (i is None, i or 0, s):
                gone[s : s + k] = [True] * k
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, k):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "Straße", "x", "été", "日本", "q" * 40]) + str(r.randrange(60))
    shared = [[word() for _ in range(r.randrange(k - 3, 4 * k))] for _ in range(6)]
    rows = []
    for i in range(90):
        ws = []
        for _ in range(r.randrange(5)):
            ws += r.choice(shared) if r.random() < 0.6 else [word() for _ in range(r.randrange(30))]
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t \r"]) for w in ws)))
    return rows + [(200, None), (201, ""), (202, " \n "), (5, rows[5][1]), (None, rows[7][1]), (300, "a " * 400), (301, "a " * 30)]


@pytest.mark.parametrize(("seed", "k", "slab"), [(1, 20, 16 << 20), (2, 8, 30000), (3, 8, 3000), (4, 8, 400)])
def test_against_brute_force(spark, seed, k, slab):
    rows = made(seed, k)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k1 int").repartition(5)
    got = sorted(map(tuple, S.substring_digest(df, k=k, m=3, slab=slab).collect()), key=str)
    assert got == brute(rows, k)


def test_text_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, line), (2, f"so\n{line}  it goes"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, S.substring_dedup(df).collect())) == [(1, line), (2, "so it goes"), (3, "")]
    assert S.substring_digest(df.limit(0)).count() == 0
