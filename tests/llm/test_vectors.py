from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillon.llm import vectors as V

LEAST = 0.98


def brute(rows):
    n, links = len(rows), {i: set() for i in range(len(rows))}
    usable = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= LEAST:
                    links[i].add(j)
                    links[j].add(i)
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *[part[j] for j in links[i]]]) for i in range(n)]
        if new == part:
            break
        part = new
    out = []
    for i in range(n):
        low = min((rows[j][0] for j in range(n) if part[j] == part[i] and rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


def made(seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        centre = r.normal(size=16)
        for _ in range(int(r.integers(1, 12))):
            v = centre + r.normal(size=16) * float(r.choice([0, 0.05, 0.12])) * np.linalg.norm(centre) / 4
            rows.append([len(rows), (v * float(r.choice([1, 3]))).astype(np.float32).astype(float).tolist(), int(g % 3)])
    big = r.normal(size=16)
    for _ in range(90):
        rows.append([len(rows), (big + r.normal(size=16) * 0.06).astype(np.float32).astype(float).tolist(), 7])
    a = rows[0][1]
    rows += [[900, None, 1], [901, [], 1], [902, [0.0] * 16, 1], [903, [float("nan"), *a[1:]], 0], [904, [None, *a[1:]], 0], [905, [float("inf"), *a[1:]], 0], [906, a, None], [907, a, 0], [908, a, 0], [5, rows[5][1], rows[5][2]], [909, [1.0, 2.0], 0], [910, [1.0, 2.01], 0]]
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("window", [512, 16])
def test_against_brute_force(spark, window):
    rows = made()
    df = spark.createDataFrame([(*x, 1, "v") for x in rows], "vec_id long, embedding array<float>, label int, id int, v string").repartition(3)
    got = sorted(map(tuple, V.near_dedup(df, window=window).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    assert got == want


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, V.near_dedup(df).collect()), key=str) == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True)], key=str)
    assert V.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_label, window", [(False, V.WINDOW), (True, V.WINDOW), (False, 32)])
def test_recall_on_the_whole_table(spark, one_label, window):
    """Links counted against brute force over all vectors of sf0.1, each with a partner just over 0.98, since it has no links of its own."""
    known = duckdb.sql("select embedding, label from '/root/testdata/sf0.1/embeddings.parquet'").df()
    r, x = np.random.default_rng(6), np.stack(known.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = r.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    x = np.concatenate([x, 0.9802 * x + np.sqrt(1 - 0.9802**2) * turn])
    label = np.zeros(len(x), int) if one_label else np.tile(known.label.to_numpy(), 2).astype(int)
    want = np.zeros(len(x), int)
    for v in np.unique(label):
        i = np.flatnonzero(label == v)
        want[i] = (x[i] @ x[i].T >= LEAST).sum(1) - 1
    assert want.min() >= 1
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int").repartition(4)
    got = V.near_dedup(df, window=window).select("vec_id", "n_links").toPandas().set_index("vec_id").n_links
    found = got.loc[np.arange(len(x))].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()


def test_passes_follow_the_size():
    for n in (1, 512, 513, 10_000, 10**6, 10**9, 10**12):
        shared, times = V.passes(n, LEAST, 512, 1e-4)
        together = (1 - np.arccos(LEAST) / np.pi) ** shared
        assert (1 - together) ** times <= 1e-4 and (n <= 512) == (shared == 0) and times <= 120


@pytest.mark.parametrize("window", [4096, 512, 64])
def test_links_in_a_dense_label(spark, window):
    """Partners at cosine 0.981 among vectors of pairwise cosine near 0.95, which are no links: every link counts."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, off = unit(r.normal(size=64)), r.normal(size=(1000, 64))
    off = unit(off - (off @ centre)[:, None] * centre)
    base = np.sqrt(0.95) * centre + np.sqrt(0.05) * off
    turn = r.normal(size=base.shape)
    turn = unit(turn - (turn * base).sum(1)[:, None] * base)
    x = np.concatenate([base, 0.981 * base + np.sqrt(1 - 0.981**2) * turn])
    x = x[r.permutation(len(x))]
    near = unit(x) @ unit(x).T >= LEAST
    part = np.arange(len(x))
    while (new := np.where(near, part[None, :], len(x)).min(1)).tolist() != part.tolist():
        part = new
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(map(tuple, V.near_dedup(df, window=window).collect()))
    assert got == [(i, int(near[i].sum()) - 1, int(part[i]), bool(part[i] == i)) for i in range(len(x))]
