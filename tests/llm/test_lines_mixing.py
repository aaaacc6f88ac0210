from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import lines as L
from quillon.llm import mixing as M
from quillon.llm.common import cut, ranked


def line_rows(seed=1):
    r = random.Random(seed)
    common = [f"boilerplate {i}" for i in range(8)]
    rows = []
    for i in range(150):
        ls = [r.choice(common[: 1 + i % 8]) if r.random() < 0.5 else f"line {r.randrange(400)}" for _ in range(r.randrange(6))]
        rows.append((i, "\n".join(ls), f"site{r.randrange(6)}" if i % 11 else None))
    return rows + [(400, None, "a"), (401, "", "b"), (402, " \n ", None), (None, "boilerplate 0\nmine", "z"), (3, rows[3][1], rows[3][2]), (500, "x\n" * 3000, "q")]


def brute_lines(rows, least):
    key = lambda i, t: (i if i is not None else L.LAST, t or "")
    sites, lead = defaultdict(set), {}
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n")):
            sites[x] |= {s} - {None}
            lead[x] = min(lead.get(x, (key(i, t), p)), (key(i, t), p))
    out = []
    for i, t, s in rows:
        ls = (t or "").split("\n")
        kept = [x for p, x in enumerate(ls) if not (x.strip(" ") and len(sites[x]) >= least and lead[x] != (key(i, t), p))]
        out.append((i, None if t is None else "\n".join(kept), s, len(ls), len(ls) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [3, 5])
def test_lines_against_brute_force(spark, least):
    rows = line_rows()
    df = spark.createDataFrame([(*x, 1, "g") for x in rows], "doc_id long, text string, source string, k1 int, gone string").repartition(4)
    out = L.dedup_lines(df, least, counts=True)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted((tuple(x) for x in out.select("doc_id", "text", "source", "n_lines", "n_removed").collect()), key=str)
    want = brute_lines(rows, least)
    assert [x for x in got if x[0] != 3] == [x for x in want if x[0] != 3]
    assert any(x[4] for x in want)


def test_far_above_the_threshold_and_empty(spark):
    df = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("everywhere\nown "), F.col("id")).alias("text"), F.col("id").cast("string").alias("source"))
    out = L.dedup_lines(df, 10)
    assert out.where("text like 'everywhere%'").count() == 1
    assert L.dedup_lines(df.limit(0), 10).count() == 0


def test_period_meets_every_window():
    for shares in ([1], [1, 1, 1], [5, 3, 2], [1, 7, 13, 2], [50, 1, 1]):
        total = sum(shares)
        slots = M.play(shares, [10**9] * len(shares), total)
        assert sorted(x for s in slots for x in s) == list(range(total))
        for q, s in zip(shares, slots):
            for j, t in enumerate(s):
                assert j * total // q <= t < -(-(j + 1) * total // q)


def brute_mix(counts, shares, block):
    """Slot by slot."""
    left = {s: -(-n // block) for s, n in counts.items()}
    j, began, t, out = Counter(), 0, 0, {}
    used = Counter()
    while any(left.values()):
        total = sum(shares[s] for s in left if left[s])
        ready = [(-(-(j[s] + 1) * total // shares[s]), k, s) for k, s in enumerate(left) if left[s] and j[s] * total // shares[s] <= t - began]
        _, _, s = min(ready)
        out[s, used[s]] = t
        used[s] += 1
        left[s] -= 1
        j[s] += 1
        t += 1
        if not left[s]:
            began, j = t, Counter()
    return out


def test_weights_are_exact_at_any_number_of_sources():
    names = [f"s{i}" for i in range(10_000)]
    assert M.whole_shares({n: 1 + i % 4 for i, n in enumerate(names)}, names) == [1 + i % 4 for i in range(10_000)]
    assert M.whole_shares({"a": 0.00001, "b": 1, None: 0.5}, ["a", "b", None]) == [1, 100_000, 50_000]
    for bad in ({}, {"a": 0}, {"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            M.whole_shares(bad, ["a"])


def test_plans_against_slot_by_slot():
    r = random.Random(9)
    for _ in range(60):
        n = r.randrange(1, 9)
        blocks, shares = [r.randrange(1, 60) for _ in range(n)], [r.randrange(1, r.choice([3, 30])) for _ in range(n)]
        want = brute_mix({f"{i:02d}": b for i, b in enumerate(blocks)}, {f"{i:02d}": q for i, q in enumerate(shares)}, 1)
        phases, got = M.plan(blocks, shares, 10**6), {}
        for p, (start, used, now, slots) in enumerate(phases):
            after = phases[p + 1][1] if p + 1 < len(phases) else blocks
            for i, q in enumerate(now):
                for b in range(used[i], after[i] if q else used[i]):
                    got[f"{i:02d}", b] = start + (b - used[i]) // q * sum(now) + slots[i][(b - used[i]) % q]
        assert got == want
    with pytest.raises(ValueError):
        M.plan([10**9, 10**9], [999_983, 1_000_003], 10**6)


def test_thousands_of_sources_keep_their_weights(spark):
    """Each source is used up in a phase of its own; until the first is, every source has its share but for less than one block."""
    n = 2_000
    df = spark.range(5 * n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.format_string("s%05d", F.col("id") % n).alias("source"))
    got = M.schedule(df, {f"s{i:05d}": 1 + i % 4 for i in range(n)}, block_docs=1).select("source", "slot").toPandas()
    assert sorted(got.slot) == list(range(5 * n))
    total = 5 * n // 2
    for t in (n // 2, n, 2 * n, total):
        done = got[got.slot < t].groupby("source").size()
        assert all(abs(done.get(f"s{i:05d}", 0) - t * (1 + i % 4) / total) < 1 for i in range(n))


def test_ranks_at_two_levels(spark):
    """Offsets of thousands of buckets, summed at two levels, give gapless ranks in the order of the hash; null groups too."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("key")).repartition(5)
    got = ranked(cut(df), ["g"], ["key", "id"], "rank", per_bucket=4).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("key")["rank"].tolist() == list(range(len(part)))


def mix_rows():
    r = random.Random(2)
    return [(i if i % 17 else None, r.choice(["", "a", "bb", None]) if i % 5 else f"t{i}", r.choice("aaabbc") if i % 29 else None) for i in range(400)]


def test_mixing_against_brute_force(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, source string, rank int, slot int").repartition(4)
    weights = {None: 1, "a": 2, "b": 5, "c": 3}
    got = M.schedule(df, weights, block_docs=3).collect()
    assert len(got) == len(rows)
    counts = Counter(x[2] for x in rows)
    order = sorted(counts, key=lambda s: (s is not None, s or ""))
    slots = brute_mix({s: counts[s] for s in order}, weights, 3)
    ids = defaultdict(list)
    for i, t, s in rows:
        ids[s].append((hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest(), i))
    want = []
    for s, v in ids.items():
        for rank, (_, i) in enumerate(sorted(v, key=lambda x: x[0])):
            want.append((s, rank // 3, rank % 3, slots[s, rank // 3], i))
    assert sorted(((g.source, g.block, g.place, g.slot, g.doc_id) for g in got), key=str) == sorted(want, key=str)
    assert all(g.release <= g.slot < g.deadline for g in got)
    first = min(g.slot for g in got if g.source is None and g.block == max(x.block for x in got if x.source is None))
    for t in range(first):
        done = Counter(s for (s, _), at in slots.items() if at <= t)
        assert all(abs(done[s] - (t + 1) * w / 11) < 1 for s, w in weights.items())


def test_mix_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(*x, 1, 2) for x in mix_rows()], "doc_id long, text string, source string, rank int, slot int")
    out = M.mix(df, block_docs=2)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, df.collect()))
    assert M.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.schedule(df, {"a": 1})


def test_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for got, sql in ((L.dedup_lines(docs, 2, counts=True).select("doc_id", "text", "n_lines", "n_removed"), L.line_dedup_sql(2)), (M.schedule(docs, block_docs=2), M.schedule_sql("1", 2))):
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def exchanges(plan, column):
    """How many shuffles of a physical plan carry `column`."""
    own = plan.nodeName() == "Exchange" and any(plan.output().apply(i).name() == column for i in range(plan.output().size()))
    return own + sum(exchanges(plan.children().apply(i), column) for i in range(plan.children().size()))


def test_mix_shuffles_whole_rows_once(spark, tmp_path):
    spark.createDataFrame(mix_rows(), "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
        assert exchanges(M.mix(df, M.stepped_weights(df))._jdf.queryExecution().executedPlan(), "text") == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("bounds", [1 << 16, 30, 0])
def test_files_of_mix_hold_the_schedule(spark, tmp_path, monkeypatch, bounds):
    """In one shuffle, with few cells, and in two shuffles; rows that tie in all but `more` are all there."""
    monkeypatch.setattr(M, "BOUNDS", bounds)
    rows = [(i % 900, None if i % 7 == 0 else f"s{i % 3}", "same" if i % 5 == 0 else f"t{i % 900}", i) for i in range(2_000)]
    rows += [(-1, "s1", "copy", i) for i in range(2_000, 2_700)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, part int").repartition(5).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    M.mix(df, M.stepped_weights(df)).write.parquet(f"{tmp_path}/mixed")
    got = [r for f in sorted(tmp_path.glob("mixed/part-*")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert sorted(r.part for r in got) == [r[3] for r in rows] and got[0].__fields__ == df.columns
    want = M.schedule(df, M.stepped_weights(df)).orderBy("slot", "place").collect()
    assert [(r.doc_id, r.source) for r in got] == [(r.doc_id, r.source) for r in want]
