"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by the signs of their projections on random directions, fresh ones
for each pass. Vectors that agree in the first L signs are a stretch of this order; up to WINDOW neighbours in a stretch are compared
in double precision, and pairs at or above the cosine are united across passes. A crowded stretch of more than WINDOW vectors is not cut
short: all of it is compared, in blocks, each pair of blocks a task.

Two vectors at angle a differ in a sign with probability a / pi, whatever lies around them, so a pair at the
least cosine is in one stretch in a pass with probability (1 - a / pi)^L. L follows a label's size, so that stretches have about half a window, and
the number of passes follows L, so that such a pair is missed in all of them with probability MISS at most; closer pairs, and components, which need no
single link, far less. A label of up to WINDOW vectors is one stretch, and exact.

Links are then counted within each component, exactly: a task has two blocks of a component at most, which are ordered by their angle to a
pivot, and the triangle inequality leaves out blocks that can't hold a link. From a task leave numbers of links and links
as a forest, never all pairs. Equal vectors of a label are one vector with a multiplicity throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, cut, ranked
from quillon.llm.similar import forest

WINDOW, MISS, SIGNS, SEED = 512, 1e-4, 64, 20
#: The table of crowded stretches is broadcast up to so many rows, of 40 bytes each.
BROADCAST_ROWS = 1 << 18


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of one length, scaled to length 1, in double precision."""
    x = np.asarray(col.flatten(), np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def passes(n: int, least: float, window: int, miss: float) -> tuple[int, int]:
    """(L, passes) for n vectors."""
    shared = min(32, max(0, int(np.ceil(np.log2(2 * n / window))))) if n > window else 0
    together = (1 - np.arccos(least) / np.pi) ** shared
    return shared, 1 if together == 1 else max(1, int(np.ceil(np.log(miss) / np.log(1 - together))))


def _directions(number: int, dim: int) -> np.ndarray:
    """SIGNS random directions of a pass."""
    return np.random.default_rng([SEED, number, dim]).normal(size=(dim, SIGNS)).astype(np.float32)


def _keyed(least: float, window: int, miss: float, with_vectors: bool):
    """Each row (id, label, dim, n, v) once for each of its label's passes, with the first signs and all of them."""

    def run(batches):
        for batch in batches:
            dims, sizes = (np.asarray(batch.column(c)) for c in ("dim", "n"))
            for dim, n in sorted(set(zip(dims.tolist(), sizes.tolist()))):
                part = batch.filter(pa.array((dims == dim) & (sizes == n)))
                x = _matrix(part.column("v")).astype(np.float32)
                shared, times = passes(n, least, window, miss)
                for number in range(times):
                    bits = x @ _directions(number, dim) >= 0
                    key = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)  # the first sign leads
                    stretch = (key >> np.uint64(64 - shared)).astype(np.int64) if shared else np.zeros(len(x), np.int64)
                    order = (key ^ np.uint64(1 << 63)).view(np.int64)  # sorts as the signs do
                    columns = {"label": part.column("label"), "dim": part.column("dim"), "number": pa.array(np.full(len(x), number, np.int32)), "stretch": pa.array(stretch)}
                    if with_vectors:
                        columns |= {"key": pa.array(order), "id": part.column("id"), "v": part.column("v")}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


STRETCH = ["label", "dim", "number", "stretch"]
PLACE = "label long, dim int, number int, stretch long"


def _edges(x: np.ndarray, ids: np.ndarray, least: float, first=None, second=None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of some rows with each other, or of two parts of them."""
    if first is None:
        near = x @ x.T >= least
    else:
        near = np.zeros((len(x), len(x)), bool)
        near[np.ix_(first, second)] = x[first] @ x[second].T >= least
        near |= near.T
    e = np.array(forest(near), np.int64).reshape(-1, 2)
    return ids[e[:, 0]], ids[e[:, 1]]


def _windows(least: float):
    """Streams stretches in order: the forest of each."""

    def run(batches):
        now, held = None, []

        def done():
            table = pa.Table.from_batches(held)
            if len(table) > 1:
                ids = np.asarray(table.column("id").combine_chunks())
                a, b = _edges(_matrix(table.column("v").combine_chunks()), ids, least)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in STRETCH], 1)
            new = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if tuple(place[lo]) != now:
                    if held:
                        yield from done()
                    now, held = tuple(place[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return run


def _blocks(least: float):
    def run(key, table):
        i, j = key[-2].as_py(), key[-1].as_py()
        part = np.asarray(table.column("part").combine_chunks())
        x, ids = _matrix(table.column("v").combine_chunks()), np.asarray(table.column("id").combine_chunks())
        a, b = _edges(x, ids, least, *((None, None) if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j))))
        return pa.table({"a": a, "b": b})

    return run


def find_links(distinct: DataFrame, least: float, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(a, b): links with the components of all links that the passes find among the rows (id, label, dim, v)."""
    sizes = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(distinct.select("id", "label", "dim", "v").join(sizes, ["label", "dim"]).select("id", "label", "dim", "n", "v"))
    slim = rows.mapInArrow(_keyed(least, window, miss, False), PLACE)
    crowded = cut(slim.groupBy(*STRETCH).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > window))
    keyed = rows.mapInArrow(_keyed(least, window, miss, True), f"{PLACE}, key long, id long, v array<double>")
    few = crowded.count()
    some = few > 0
    if few <= BROADCAST_ROWS:  # so that no crowded stretch is dealt out whole
        crowded = F.broadcast(crowded)
    calm = keyed.join(crowded, STRETCH, "left_anti") if some else keyed
    links = calm.repartition(*STRETCH).sortWithinPartitions(*STRETCH, "key").mapInArrow(_windows(least), "a long, b long")
    if some:
        parted = keyed.join(crowded, STRETCH).withColumn("of", F.ceil(F.col("size") / window).cast("int"))
        parted = parted.withColumn("part", F.pmod(F.xxhash64("id"), F.col("of").cast("long")).cast("int"))
        parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        sides = parted.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).select(*STRETCH, "i", "j", "part", "id", "v")
        links = links.union(sides.groupBy(*STRETCH, "i", "j").applyInArrow(_blocks(least), "a long, b long"))
    return links


def _count_in_component(least: float):
    """Links of each row of block i to the rows of block j, weighted by multiplicity, both ways if i < j."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        own = np.asarray(table.column("block").combine_chunks())
        x, ids, many = _matrix(table.column("v").combine_chunks()), *(np.asarray(table.column(c).combine_chunks()) for c in ("id", "many"))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = (x[a] @ x[b].T) >= least
        out = [(ids[a], near @ many[b])]
        if i != j:
            out.append((ids[b], near.T @ many[a]))
        return pa.table({"id": np.concatenate([o[0] for o in out]), "n": np.concatenate([o[1] for o in out])})

    return run


def count_links(members: DataFrame, least: float, block: int = WINDOW) -> DataFrame:
    """(id, n): exact links within each component, itself included, to be summed. members: id, component, v, many.

    Rank goes by the angle to the component's first vector; angles of linked vectors differ by arccos(least)
    at most, so a block meets only the blocks whose ranges of angles come that close.
    """
    size = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = members.join(size, "component")
    small = members.where(F.col("size") <= block).withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    large = cut(members.where(F.col("size") > block))
    kind = "id long, n long"
    counted = small.groupBy("component", "i", "j").applyInArrow(_count_in_component(least), kind)
    if large.isEmpty():
        return counted
    pivot = large.where("id = component").select("component", F.col("v").alias("pivot"))
    dot = F.aggregate(F.zip_with("v", "pivot", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (norm(F.col("v")) * norm(F.col("pivot")))))
    by_angle = cut(large.join(pivot, "component").withColumn("angle", F.acos(cosine)).drop("pivot"))
    # 32 bits of the angle's place among the component's angles, in hex, sort like it; the rest of the order is the id
    range_ = cut(by_angle.groupBy("component").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))
    share = (F.col("angle") - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-12))
    by_angle = cut(by_angle.join(range_, "component").withColumn("turn", F.lpad(F.hex((share * F.lit((1 << 32) - 1)).cast("long")), 8, "0")).drop("low", "high"))
    rows = cut(ranked(by_angle, ["component"], ["turn", "id"], "rank").withColumn("block", F.floor(F.col("rank") / block).cast("int")))
    spans = cut(rows.groupBy("component", "block").agg(F.min("angle").alias("low"), F.max("angle").alias("high")))
    reach = float(np.arccos(least)) + 1e-6
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.low") - F.col("a.high") <= reach))
    pairs = cut(pairs.select(F.col("a.component").alias("component"), F.col("a.block").alias("i"), F.col("b.block").alias("j")))
    sides = pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sent = rows.select("component", "block", "id", "v", "many").join(sides, ["component", "block"])
    return counted.union(sent.groupBy("component", "i", "j").applyInArrow(_count_in_component(least), kind))


def near_dedup(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of `vectors`.

    Rows link if their labels are equal and not null, their vectors equally long, and the cosine is at
    least `least`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    A null id is kept, never named by others, and kept is true for it. Rows that repeat an id are vectors of
    their own and link with each other; a component's id is its smallest.
    """
    v = F.col(vec_col).cast("array<double>")
    # negative zero equals zero
    v = F.transform(v, lambda x: x + F.lit(0.0))
    fine = F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # scaled by the largest component, so that no square overflows or vanishes
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scaled = F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x / most))
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("v")))
    good = rows.where("v is not null")
    # one row for each distinct vector of a label: `id` stands for it in what follows
    distinct = cut(good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("many"), F.min("id").alias("least")).withColumns({"dim": F.size("v"), "id": F.monotonically_increasing_id()}))
    parts = cut(connected_components(find_links(distinct, least, window, miss)).withColumnRenamed("node", "id"))
    linked = distinct.join(parts, "id")
    links = count_links(linked.select("id", "component", "v", "many"), least, window).groupBy("id").agg(F.sum("n").alias("n"))
    lowest = cut(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    named = parts.join(lowest, "component").select("id", "component_id")
    alone = distinct.join(named, "id", "left").join(links, "id", "left")
    known = alone.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", "many") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    part = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.col("id").eqNullSafe(part).alias("kept"))
