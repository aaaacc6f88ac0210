from __future__ import annotations

import random
import re

import pytest

from quillon.llm import similar as S


def sets(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def made(seed=4):
    r = random.Random(seed)
    text = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(n)]
    rows, base = [], [text(r.randrange(60, 300)) for _ in range(60)]
    for b in base:
        rows.append(b)
        for _ in range(r.randrange(3)):
            c = list(b)
            for _ in range(r.choice([0, 1, max(1, len(b) // 90), len(b) // 12])):
                c[r.randrange(len(c))] = "changed" + str(r.randrange(99))
            rows.append(c)
    hot = text(200)
    for i in range(80):
        c = list(hot)
        c[r.randrange(200)] = f"hot{i}"
        rows.append(c)
    r.shuffle(rows)
    out = [(i, " ".join(c)) for i, c in enumerate(rows)]
    return out + [(900, None), (901, ""), (902, " \n"), (3, out[3][1]), (None, out[4][1]), (None, "only here")]


def brute(rows):
    g = [sets(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            u = len(g[i] | g[j])
            if (len(g[i] & g[j]) >= 0.8 * u) if u else True:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    last = (1 << 63) - 1
    return {min((rows[j][0] if rows[j][0] is not None else last) for j in range(len(rows)) if part[j] == p) for p in set(part)}


@pytest.mark.parametrize("most", [1024, 16])
def test_groups_against_brute_force(spark, most):
    rows = made()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, key int, th int").repartition(3)
    out = S.similar_dedup(df, most=most)
    assert out.columns == df.columns
    last = (1 << 63) - 1
    got = [r.doc_id if r.doc_id is not None else last for r in out.collect()]
    want = brute(rows)
    assert len(got) == len(set(got))
    assert set(got) == want


def test_empty(spark):
    assert S.similar_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def kept(spark, rows, **more):
    return sorted(r.doc_id for r in S.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **more).collect())


def test_short_and_border_pairs(spark):
    """Pairs of 8 and 9 words (4 of 5 shingles shared) and of just 0.8 and over: each is found."""
    r, rows = random.Random(1), []
    for i in range(300):
        n = 8 if i < 150 else r.randrange(20, 90)
        ws = [f"w{i}x{j}" for j in range(n)]
        more = 1 if n == 8 else int((n - 4) / 0.8 + 1e-9) - (n - 4)
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws + [f"more{j}" for j in range(more)]))]
    assert kept(spark, rows) == list(range(0, 600, 2))


@pytest.mark.parametrize("n, changes, most", [(300, (3,), 512), (300, (3,), 64), (60, (2, 3), 512), (40, (2,), 8)])
def test_large_groups_of_borderline_copies(spark, n, changes, most):
    """Copies whose links lie between any two of them, not around a hub."""
    r, rows = random.Random(n), []
    base = [f"b{j}" for j in range(200)]
    for i in range(n):
        c = list(base)
        for _ in range(r.choice(changes)):
            c[r.randrange(200)] = f"new{i}x{r.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    want = brute(rows)
    assert 0 < len(want) < n
    assert kept(spark, rows, most=most) == sorted(want)


def test_common_passages_and_seams(monkeypatch):
    """Lists of all lengths, cut into packed strings anywhere: short lists give all pairs, long ones all members and what joins them."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(f"{i}w{j}" for j in range(4)) for i in range(40)]
    for group in (2, 3, S.LIST, S.LIST + 1, 90):  # of one shared passage each
        texts += [" ".join([f"{group}g{j}" for j in range(30)] + [f"{group}x{i}"]) for i in range(group)]
    r.shuffle(texts)

    class Common:
        value = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    lists = {}
    for h in S.shingle_sets(pa.array(texts), 5):
        for k in S.prefix(h, 0.8, *Common.value).tolist():
            lists.setdefault(k, set()).add(S.set_node(h))
    first = {}  # list of each pair's first common shingle
    for _, m in sorted(lists.items()):
        for a in m:
            for b in m:
                first.setdefault((a, b), m)
    want = {(a, b) for (a, b), m in first.items() if a < b and len(m) <= S.LIST}
    long = [m for m in lists.values() if len(m) > S.LIST]
    assert want and long
    for packed, step in ((1 << 20, 1000), (300, 1000), (40, 7), (1, 50)):
        monkeypatch.setattr(S, "PACKED", packed)
        rows = []
        for lo in range(0, len(texts), step):
            one = pa.RecordBatch.from_arrays([pa.array(texts[lo : lo + step])], ["t"])
            rows += [tuple(x.values()) for b in S._postings(5, 0.8, Common, 6)([one]) for x in b.to_pylist()]
        rows.sort(key=lambda x: x[0])
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 9]), (pa.int32(), pa.int8(), pa.binary()))], ["bucket", "kind", "data"]) for a in range(0, len(rows), 9)]
        got = [x for b in S._pairs(0.8)(batches) for x in b.to_pylist()]
        pairs = {(min(g["a"], g["b"]), max(g["a"], g["b"])) for g in got if g["key"] is None}
        assert want <= pairs
        members = {}
        for g in got:
            if g["key"] is not None:
                members.setdefault(g["key"], set()).add(g["a"])
        assert sorted(map(sorted, members.values())) == sorted(map(sorted, long))
        for m in long:
            part = {x: x for x in m}
            for _ in m:
                for a, b in pairs:
                    if a in part and b in part:
                        part[a] = part[b] = min(part[a], part[b])
            assert len(set(part.values())) == 1


def test_count_filter_never_drops_a_similar_pair():
    import numpy as np

    r = np.random.default_rng(2)
    for n in (1, 4, 9, 60, 700, 40_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (1.0, 0.95, 0.9, 0.8, 0.5):
            for more in (0, n // 10, n):
                b = np.unique(np.append(a[: int(len(a) * share)], r.integers(0, 1 << 63, more).astype(np.uint64)))
                if len(b):
                    apart = len(np.setxor1d(a, b))
                    bits = S.differing(S.parities(a), S.parities(b))
                    assert bits <= apart and bits % 2 == apart % 2
    assert S.differing(S.parities(a), S.parities(np.unique(r.integers(0, 1 << 63, 40_000).astype(np.uint64)))) > 20_000


def test_shingles_of_odd_texts():
    """Null, empty and white texts have none; case is folded; words of any length count whole; order and place matter."""
    import pyarrow as pa

    long = "y" * 5000
    texts = [None, "", " \n", "A b", "a B", "b a", "a", "a a", "a b c d e", "a b c d e f", long, long + "z", "z" + long, "\u00c9 b", "\u00e9 b", "a\x0bb"]
    got = [tuple(h.tolist()) for h in S.shingle_sets(pa.array(texts), 5)]
    assert got[0] == got[1] == got[2] == ()
    assert got[3] == got[4] == got[15]
    rest = got[4:15]
    assert len(set(rest)) == len(rest) and [len(g) for g in rest] == [1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1]


def test_simhash_index_finds_links(spark, monkeypatch):
    """Without the prefixes' pairs, what the byte-position index finds is still verified and linked."""

    def none(similarity):
        return lambda batches: iter(())

    monkeypatch.setattr(S, "_pairs", none)
    r, rows = random.Random(5), []
    for i in range(30):
        b = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [(2 * i, " ".join(b)), (2 * i + 1, " ".join([*b, "more"]))]
    near = 0
    for (_, x), (_, y) in zip(rows[::2], rows[1::2]):
        x, y = (S.simhash(next(S.shingle_sets(S.pa.array([t]), 5))) for t in (x, y))
        near += ((x ^ y) & (2**64 - 1)).bit_count() <= 4
    assert near > 10
    assert len(kept(spark, rows)) == 60 - near


def test_long_lists_send_few_sets(spark, monkeypatch):
    """Of texts that share a passage and nothing else no sets are gathered, and their links are found."""
    monkeypatch.setattr(S, "COMMON_FROM", 1 << 40)
    asked = []
    monkeypatch.setattr(S, "sets_of", lambda nodes, *a, f=S.sets_of: asked.append(nodes.count()) or f(nodes, *a))
    passage = [f"p{j}" for j in range(30)]
    rows = [(i, passage + [f"t{i}w{j}" for j in range(30)]) for i in range(80)]
    rows = [(i, " ".join(ws)) for i, ws in rows + [(100 + i, [*rows[i][1][:-1], "other"]) for i in range(0, 80, 20)]]
    assert kept(spark, rows) == sorted(brute(rows)) == list(range(80))
    assert sum(asked) <= 32


def test_near_within_and_seams():
    """Every similar pair of sets of all sizes passes, wherever batches are cut; so many pairs that they outnumber the texts leave the texts."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    groups = []
    for n in (1, 2, 7, 30, 31, 33, 64, 120, 128, 130, 900):
        base = r.integers(0, 1 << 63, n).astype(np.uint64)
        groups += [np.unique(np.append(base[: n - d], r.integers(0, 1 << 63, e).astype(np.uint64))) for d, e in ((0, 0), (0, n // 4), (n // 9, n // 9), (n // 5, 0), (n // 2, n // 2)) if n > d]
    n, bits = np.array([len(g) for g in groups]), [S.parities(g) for g in groups]
    a, b = S.near_within(n, bits, ~np.eye(len(n), dtype=bool), 0.8)
    got = {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    want = {(i, j) for j in range(len(n)) for i in range(j) if min(n[i], n[j]) >= 0.8 * max(n[i], n[j]) - 1e-9 and S.differing(bits[i], bits[j]) <= (n[i] + n[j]) / 9 + 1e-6}
    near = S.linked(groups, 0.8)
    assert got == want and {(i, j) for i, j in want if near[i, j]} == {(i, j) for j in range(len(n)) for i in range(j) if near[i, j]} != set()

    keys = np.arange(len(n)) % 3
    by = np.argsort(keys, kind="stable")
    t = {"key": keys, "size": keys * 0, "i": keys * 0, "j": keys * 0, "node": np.arange(len(n)) * 10, "component": np.arange(len(n)), "n": n, "part": keys * 0, "larger": n < 0}
    t = pa.table({c: x[by] for c, x in t.items()} | {"bits": [bits[k] for k in by]})

    def out(rows):
        return sorted(tuple(x.values()) for y in S._near_in_blocks(0.8)(iter(t.to_batches(rows))) for x in y.to_pylist())

    pairs = {(10 * i, 10 * j, None) for i, j in want if i % 3 == j % 3}
    assert 0 < len(pairs) and set(out(None)) == pairs and out(1) == out(4) == out(None)
    crowd = pa.table({c: t.column(c).take([0] * 8) for c in t.column_names}).set_column(4, "node", pa.array(range(8))).set_column(5, "component", pa.array(range(8)))
    assert [x for y in S._near_in_blocks(0.8)(iter(crowd.to_batches(3))) for x in y.to_pylist()] == [{"a": k, "b": None, "key": 0} for k in range(8)]


@pytest.mark.parametrize("rows", [1 << 20, 0])
def test_texts_stay_where_they_are(spark, monkeypatch, rows):
    """The last join shuffles no texts unless too many rows go; rows that repeat stay once."""
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    texts = [(i, f"text {i % 7} has some more words") for i in range(40)]
    df = S.similar_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
    assert ("Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()) == (not rows)
    assert sorted(r.doc_id for r in df.collect()) == list(range(7))
    df = S.similar_dedup(spark.createDataFrame([*texts, texts[0], texts[8], (None, None), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id) for r in df.collect()) == [*((False, i) for i in range(7)), (True, None)]
