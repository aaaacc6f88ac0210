"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a shuffled but fixed order, form blocks of `block_docs`. With
share w = q / Q of the slots (integers), block j of a source gets a release time
floor(j / w) and a deadline ceil((j + 1) / w). In each slot the released block with the earliest
deadline goes next (ties by the source's name). Every block runs in its window, so at
any time a source is less than one block from its share.

The schedule repeats after Q slots, so it is played for one such period, or until a source is used up, on the
driver, over weights and counts alone. Documents find their slot by joins with that
table. When a source is used up the others share on by their weights: a
new phase, at most one for each source. No document is dropped or repeated.

Weights are taken exactly, as the fractions that their decimals are: nothing is rounded, whatever their number. What that
may cost is bounded: the driver sees one row for each source, `max_sources` at most, and plays `max_plan` slots
at most, in which a source that has none in a phase has no row; weights and sources that need more raise an error and are never changed. The table of slots is broadcast up to
BROADCAST_ROWS rows and shuffled beyond. DataFrame functions only.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, numbered, ranked, spare

LAST = (1 << 63) - 1
#: Tables of a plan are broadcast up to so many rows, of 32 bytes each.
BROADCAST_ROWS = 1 << 18
#: Whole rows are dealt straight to their place in the order where sources x partitions are no more; beyond that they are shuffled twice.
BOUNDS = 1 << 16


def play(shares: list[int], left: list[int], most: int) -> list[list[int]]:
    """The slots of each source's blocks by earliest deadline first, for one period of sum(shares) slots or until a source has no block left."""
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    ready: list[tuple[int, int]] = []  # (deadline, source) of released blocks
    later = [(0, i) for i, q in enumerate(shares) if q]  # (release, source) of each source's next block
    heapq.heapify(later)
    for t in range(total):
        if t >= most:
            raise ValueError("the schedule needs more slots than max_plan: take coarser weights, fewer sources or larger blocks")
        while later and later[0][0] <= t:
            _, i = heapq.heappop(later)
            j = len(slots[i])
            heapq.heappush(ready, (-(-(j + 1) * total // shares[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        j = len(slots[i])
        if j == left[i]:
            break
        if j < shares[i]:
            heapq.heappush(later, (max(j * total // shares[i], t + 1), i))
    return slots


def plan(blocks: list[int], shares: list[int], max_plan: int) -> list[tuple[int, list[int], list[int], list[list[int]]]]:
    """Phases (first slot, blocks used before by source, shares of those that have blocks left, slots of a period or of all that is played)."""
    used, start, rows, out = [0] * len(blocks), 0, 0, []
    while any(u < b for u, b in zip(used, blocks)):
        now = [q if u < b else 0 for q, u, b in zip(shares, used, blocks)]
        total, left = sum(now), [b - u for u, b in zip(used, blocks)]
        slots = play(now, left, max_plan - rows)
        rows += sum(map(len, slots)) + sum(map(bool, slots))
        ends = [((n - 1) // q) * total + s[(n - 1) % q] for q, n, s in zip(now, left, slots) if q and (n - 1) % q < len(s)]
        out.append((start, list(used), now, slots))
        over = min(ends) + 1
        used = [u + (over // total) * q + bisect.bisect_left(s, over % total) for u, q, s in zip(used, now, slots)]
        start += over
    return out


def whole_shares(weights: dict[str | None, float], names: list[str | None]) -> list[int]:
    """The least integers in the proportion of the weights, exactly: 0.1 is a tenth."""
    if any(n not in weights or not 0 < weights[n] < float("inf") for n in names):
        raise ValueError("every source needs a positive target weight")
    exact = [w if isinstance(w, Fraction) else Fraction(str(w)) for w in (weights[n] for n in names)]
    scale = math.lcm(*[w.denominator for w in exact])
    shares = [int(w * scale) for w in exact]
    least = math.gcd(*shares) or 1
    return [q // least for q in shares]


def stepped_weights(docs: DataFrame, source_col: str = "source", max_sources: int = 10_000) -> dict[str | None, float]:
    """Example weights: 1, 2, 3 and 4 in turn over the sources by name."""
    names = [r[0] for r in docs.select(F.col(source_col).cast("string")).distinct().limit(max_sources + 1).collect()]
    return {s: 1 + i % 4 for i, s in enumerate(sorted(names, key=lambda s: (s is not None, s or "")))}


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary"))


def _played(rows: DataFrame, source_col: str, weights: dict[str | None, float] | None, block_docs: int, max_sources: int, max_plan: int) -> tuple[DataFrame, DataFrame, dict[str, str], int, int, bool]:
    """The plan's spans and slots, the names of their columns and of those that `_placed` adds (free in `rows`), how many sources and slots there are, and whether both tables are broadcast."""
    names_of = dict(zip((want := ("name", "block", "release", "deadline", "slot", "place", "rank", "p", "s", "lo", "hi", "q", "total", "start", "j", "t")), spare(rows, *want)))
    n = names_of
    sizes = rows.groupBy(F.col(source_col).cast("string").alias(n["name"])).agg(F.count(F.lit(1)).alias("size")).limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    sizes = sorted(sizes, key=lambda r: (r[0] is not None, r[0] or ""))
    names = [r[0] for r in sizes]
    shares = whole_shares(weights or dict.fromkeys(names, 1), names)
    blocks = [-(-r["size"] // block_docs) for r in sizes]
    phases = plan(blocks, shares, max_plan)
    spans, slots = [], []
    for p, (start, used, now, table) in enumerate(phases):
        after, total = phases[p + 1][1] if p + 1 < len(phases) else None, sum(now)
        for i, q in enumerate(now):
            if table[i]:  # it has blocks in this phase
                spans.append((i, names[i], p, start, used[i], after[i] if after else LAST, q, total))
                slots += [(p, i, j, t) for j, t in enumerate(table[i])]
    spark = rows.sparkSession
    span = spark.createDataFrame(spans, "s int, name string, p int, start long, lo long, hi long, q long, total long")
    slot = spark.createDataFrame(slots, "p int, s int, j long, t long")
    span = span.select(*[F.col(c).alias(n[c] if c != "name" else n["name"] + "_of") for c in span.columns])
    slot = slot.select(*[F.col(c).alias(n[c]) for c in slot.columns])
    if len(spans) <= BROADCAST_ROWS:
        span = F.broadcast(span)
    if len(slots) <= BROADCAST_ROWS:
        slot = F.broadcast(slot)
    return span, slot, n, len(names), sum(blocks), max(len(spans), len(slots)) <= BROADCAST_ROWS


def _placed(rows: DataFrame, span: DataFrame, slot: DataFrame, n: dict[str, str], block_docs: int) -> DataFrame:
    """`rows` (with name and rank) with block, release, deadline, slot and place."""
    c = {k: F.col(v) for k, v in n.items()}
    rows = rows.withColumns({n["block"]: F.floor(c["rank"] / block_docs).cast("long"), n["place"]: (c["rank"] % block_docs).cast("long")})
    rows = rows.join(span, c["name"].eqNullSafe(F.col(n["name"] + "_of")) & (c["block"] >= c["lo"]) & (c["block"] < c["hi"]))
    rows = rows.withColumn(n["j"], (c["block"] - c["lo"]) % c["q"]).join(slot, [n["p"], n["s"], n["j"]])
    whole = {k: f"`{v}`" for k, v in n.items()}
    return rows.withColumns(
        {
            n["release"]: F.expr("{start} + (({block} - {lo}) * {total}) div {q}".format(**whole)),
            n["deadline"]: F.expr("{start} + (({block} - {lo} + 1) * {total} + {q} - 1) div {q}".format(**whole)),
            n["slot"]: F.expr("{start} + (({block} - {lo}) div {q}) * {total} + {t}".format(**whole)),
        }
    )


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 10_000, max_plan: int = 1_000_000) -> DataFrame:
    """(id_col, source_col, block, release, deadline, slot, place), one row for each row of `docs`.

    Slots count blocks, place the documents in a block. Without weights sources share alike; a null
    source is a source; one without a positive weight is an error. Rows go in the order of md5(id | text), nulls as empty;
    rows that repeat both are alike. Texts of any length are hashed whole. No rows give no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(id_col, text_col).alias("key")))
    span, slot, n, *_ = _played(rows, "source", weights, block_docs, max_sources, max_plan)
    rows = ranked(rows.withColumn(n["name"], F.col("source").cast("string")), [n["name"]], ["key"], n["rank"])
    rows = _placed(rows, span, slot, n, block_docs)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *[F.col(n[c]).alias(c) for c in ("block", "release", "deadline", "slot", "place")])


def _cell(key: Column, cells: int) -> Column:
    """The one of so many equal stretches of md5 hex strings that `key` lies in."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * cells / (1 << 32)).cast("int")


def _cells(starts: list[Row], cells: int) -> list[tuple[str | None, int, int, list[tuple[str, int, int]]]]:
    """For each source and cell the part that the cell begins in, and where in the cell others begin. starts: (source, part, least key, its at)."""
    out = []
    for name in {r[0] for r in starts}:
        own = sorted((p, k, a) for s, p, k, a in starts if s == name)
        base, i = own[0][0], 0
        for c in range(cells):
            more = []
            while i < len(own) and (int(own[i][1][:8], 16) * cells) >> 32 == c:
                p, k, a = own[i]
                more.append((k, a, p))
                i += 1
            out.append((name, c, base, more))
            base = more[-1][2] if more else base
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 10_000, max_plan: int = 1_000_000) -> DataFrame:
    """`docs`, all rows and columns, sorted into the mixture's order: written, its files hold the training order.

    Keys alone are scheduled first. They tell where in each source's order a partition of the result begins, so whole rows are
    shuffled once, straight to their partition, and find their slot there. `docs` is stored first if it isn't a table just read.
    """
    key, at, part, part_of, cell, cell_of, base, more, first = spare(docs, "key", "at", "part", "part_of", "cell", "cell_of", "base", "more", "first")
    docs = numbered(docs, at).withColumn(key, _key(id_col, text_col))
    slim = cut(docs.select(F.col(source_col).cast("string").alias("source"), key, at))
    span, slot, n, sources, total, small = _played(docs, source_col, weights, block_docs, max_sources, max_plan)
    keys = ranked(slim.withColumnRenamed("source", n["name"]), [n["name"]], [key, at], n["rank"])
    keys = _placed(keys, span, slot, n, block_docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in docs.columns if c not in (key, at)]
    if not small or sources * parts > BOUNDS:
        return docs.drop(key).join(keys.select(at, n["slot"], n["place"]), at).orderBy(n["slot"], n["place"]).select(*names)
    keys = keys.withColumn(part, F.floor(F.col(n["slot"]) * parts / max(1, total)).cast("int"))
    starts = cut(keys.groupBy(n["name"], part).agg(F.min(F.struct(key, at)).alias(first), F.min(n["rank"]).alias(n["rank"])))
    cells = min(4 * parts, max(1, BOUNDS // max(1, sources)))
    found = _cells(starts.select(n["name"], part, f"{first}.*").collect(), cells)
    spark, name_of = docs.sparkSession, n["name"] + "_of"
    look = spark.createDataFrame(found, "name string, cell int, base int, more array<struct<key string, at long, part int>>").toDF(name_of, cell, base, more)
    own = F.struct(F.col(key).alias("key"), F.col(at).alias("at"))
    rows = docs.withColumn(n["name"], F.col(source_col).cast("string")).withColumn(cell_of, _cell(F.col(key), cells))
    rows = rows.join(F.broadcast(look), F.col(n["name"]).eqNullSafe(F.col(name_of)) & (F.col(cell_of) == F.col(cell)))
    rows = rows.withColumn(part, F.aggregate(more, F.col(base), lambda p, x: F.when(F.struct(x["key"], x["at"]) <= own, x["part"]).otherwise(p)))
    rows = rows.select(*names, key, at, n["name"], part).repartitionById(parts, F.col(part))
    inside = Window.partitionBy(n["name"], part).orderBy(key, at)
    rows = rows.withColumn(n["block"], F.row_number().over(inside) - 1)  # as yet the place among those of its source here
    starts = F.broadcast(starts.select(F.col(n["name"]).alias(name_of), F.col(part).alias(part_of), n["rank"]))
    rows = rows.join(starts, F.col(n["name"]).eqNullSafe(F.col(name_of)) & (F.col(part) == F.col(part_of))).drop(name_of)
    rows = rows.withColumn(n["rank"], F.col(n["rank"]) + F.col(n["block"]))
    return _placed(rows, span, slot, n, block_docs).sortWithinPartitions(n["slot"], n["place"]).select(*names)


def schedule_sql(weight: str, block_docs: int = 4) -> str:
    """DuckDB: the same schedule, played slot by slot. weight: SQL for a source's integer weight, from `source` and its 1-based `i`."""
    return f"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat(doc_id, '|', text)), doc_id) - 1 AS rank FROM documents),
sizes AS (SELECT source, (count(*) + {block_docs - 1}) // {block_docs} AS n, row_number() OVER (ORDER BY source) AS i FROM ranked GROUP BY source),
start AS (SELECT list(n ORDER BY i) AS n, list({weight} ORDER BY i) AS w, list(source ORDER BY i) AS names FROM sizes),
play AS (
  SELECT -1::BIGINT AS t, 0::BIGINT AS began, n AS left_, list_transform(n, lambda x: 0::BIGINT) AS j, w, names, n AS n0, 0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline FROM start
  UNION ALL
  SELECT t, CASE WHEN left_[pick] = 1 THEN t + 1 ELSE began END,
    list_transform(left_, lambda x, k: CASE WHEN k = pick THEN x - 1 ELSE x END),
    list_transform(j, lambda x, k: CASE WHEN left_[pick] = 1 THEN 0 WHEN k = pick THEN x + 1 ELSE x END),
    w, names, n0, pick, n0[pick] - left_[pick], began + (j[pick] * total) // w[pick], began + ((j[pick] + 1) * total + w[pick] - 1) // w[pick]
  FROM (SELECT *, list_position(ends, list_min(ends)) AS pick FROM (
    SELECT *, list_transform(left_, lambda x, k: CASE WHEN x > 0 AND (j[k] * total) // w[k] <= t - began THEN ((j[k] + 1) * total + w[k] - 1) // w[k] ELSE 9223372036854775807 END) AS ends
    FROM (SELECT t + 1 AS t, began, left_, j, w, names, n0, list_sum(list_transform(left_, lambda x, k: CASE WHEN x > 0 THEN w[k] ELSE 0 END))::BIGINT AS total FROM play WHERE list_sum(left_) > 0))))
SELECT r.doc_id, r.source, p.block::BIGINT AS block, p.release::BIGINT AS release, p.deadline::BIGINT AS deadline, p.t AS slot, (r.rank % {block_docs})::BIGINT AS place
FROM ranked r JOIN play p ON p.t >= 0 AND p.names[p.pick] = r.source AND p.block = r.rank // {block_docs}"""
