from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash as S


def brute_fp(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute(rows, n=4, bits=4):
    fps = [brute_fp(t, n) for _, t in rows]
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                part[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def made(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = ["The", "of", "ÄRGER", "straße", "x", "in", "Data", "été", "well", "so", "z9"]
    rows = [(i, " ".join(r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.randrange(1, 90)))) for i in range(n)]
    for i in range(n, n + 60):
        ws = rows[r.randrange(n)][1].split()
        for _ in range(r.randrange(2)):
            ws[r.randrange(len(ws))] = "changed"
        rows.append((i, r.choice([" ", "\n", " \t"]).join(ws)))
    return rows + [(900, ""), (901, None), (902, " \n"), (None, "a b"), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (903, "word " * 3000)]


def test_triples_meet_every_four_positions():
    from itertools import combinations

    assert len(S.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in S.TRIPLES) for q in combinations(range(8), 4))


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, part string")
    got = sorted(map(tuple, S.simhash_components(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("most", [64, 100])
def test_hot_lists_are_split_not_capped(spark, most):
    r = np.random.default_rng(most)
    base = int(r.integers(1 << 62))
    fps = {base}
    while len(fps) < 400:
        x = r.choice(list(fps))
        fps.add(int(x) ^ (1 << int(r.integers(62))))
    fps = sorted(fps) + [int(x) for x in r.integers(1 << 62, size=100)]
    links = S.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, most).collect()
    assert parts(fps, links) == parts(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4])


def parts(nodes, links):
    part = {f: f for f in nodes}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in links:
        part[root(a)] = root(b)
    groups = {}
    for f in nodes:
        groups.setdefault(root(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_dedup_keeps_one_of_each_component(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, key int, part string")
    got = S.simhash_dedup(df)
    assert got.columns == df.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted({c for _, _, c in brute(rows)}, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).count() == 0
    assert S.simhash_dedup(df).count() == 0
