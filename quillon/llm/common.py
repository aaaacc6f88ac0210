"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bytes of `[\x20\x09-\x0D]`, as a lookup table.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the one in `spark.checkpoint.dir`.

    Only where that is unset is one chosen here: below the warehouse on a cluster, below /tmp
    in local mode.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.startswith("local") and "cluster" not in sc.master:
            folder = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same for wide rows, as a Parquet table."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of `df`, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, per_bucket: int = 1024) -> DataFrame:
    """Adds `rank`, 0-based within `group` in the order of the md5 hex string order[0], then the rest.

    No task sees a whole group: rows fall into buckets by the leading 32 bits of
    the md5, which keep its order; a window ranks inside (group, bucket), and an
    offset from the bucket counts is added. The number of buckets follows the
    number of rows, so that a bucket stays near `per_bucket` rows. Offsets are summed at two levels, so that no
    task sees all buckets of a group either, but `per_bucket` buckets or their sums. Rows that tie in
    all of `order` are the same to the result. `df` should be cut or cheap to read.
    """
    n = max(1, -(-df.count() // per_bucket))
    bucket, offset, size, over = spare(df, "bucket", "offset", "size", "over")
    lead = F.conv(F.substring(F.col(order[0]), 1, 8), 16, 10).cast("long")
    df = df.withColumn(bucket, (lead * F.lit(n) / F.lit(1 << 32)).cast("long"))
    sizes = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias(size)).withColumn(over, F.floor(F.col(bucket) / per_bucket).cast("long"))

    def summed(rows: DataFrame, within: list[str], by: str, to: str) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(to, F.coalesce(F.sum(size).over(before), F.lit(0)))

    def joined_with(left: DataFrame, right: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
        """left with right's `value`, for keys that may be null, added to `to`."""
        names = [f"{k}__r" for k in keys]
        right = right.select(*[F.col(k).alias(m) for k, m in zip(keys, names)], F.col(value).alias(f"{value}__r"))
        cond = F.lit(True)
        for k, m in zip(keys, names):
            cond = cond & left[k].eqNullSafe(right[m])
        return left.join(right, cond).withColumn(to, (F.col(to) + F.col(f"{value}__r")).cast("long")).drop(*names, f"{value}__r")

    inner = summed(sizes, [*group, over], bucket, offset)
    if n > per_bucket:
        outer = summed(sizes.groupBy(*group, over).agg(F.sum(size).alias(size)), group, over, offset)
        inner = joined_with(inner, outer, [*group, over], offset, offset)
    inside = Window.partitionBy(*group, bucket).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    df = df.withColumn(rank, (F.row_number().over(inside) - 1).cast("long"))
    return joined_with(df, inner, [*group, bucket], offset, rank).drop(bucket)


def numbered(docs: DataFrame, at: str) -> DataFrame:
    """Adds `at`: the place of each row in the order of `docs`, from 0.

    That of files and of rows in them if `docs` is a table just read, which Spark may read in any order; any other frame is stored first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or not docs.inputFiles():
        docs = stored(docs)
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    part = F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"^part-(\d+)", 1)
    rows = docs.select("*", path.alias("file__"), row.alias("row__"))
    sizes = docs.select(path.alias("f__"), row.alias("row__"), F.coalesce(F.nullif(part, F.lit("")).cast("long"), F.lit(-1)).alias("part__"))
    sizes = sizes.groupBy("f__", "part__").agg((F.max("row__") + 1).alias("size__"))
    before = Window.orderBy("part__", "f__").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    first = sizes.select("f__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("first__"))
    return rows.join(F.broadcast(first), F.col("file__") == F.col("f__")).select(*docs.columns, (F.col("first__") + F.col("row__")).cast("long").alias(at))


#: Nodes of more edges than `HUB` are told their minimum by a broadcast of up to `HUBS` rows; HUB grows with the edges so that no more can exist.
HUB, HUBS = 512, 1 << 18


def _with_least(edges: DataFrame, ends: int, with_self: bool) -> DataFrame:
    """The edges (u, v) with m, the least neighbour of u, or u itself if that is less. ends: how many rows there are at most.

    A hub's edges stay where they are and get m by a broadcast; only those of other nodes are shuffled to their node.
    """
    m = F.least(F.col("u"), F.min("v")) if with_self else F.min("v")
    low = cut(edges.groupBy("u").agg(m.alias("m"), F.count(F.lit(1)).alias("n")))
    most = max(HUB, ends // HUBS)
    hubs = low.where(F.col("n") > most).select("u", "m")
    if hubs.isEmpty():
        return edges.join(low.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs), "u", "left_anti").join(low.where(F.col("n") <= most).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


#: So many edges (16 bytes each) are united in one go on the driver; more take steps until no more are left.
LOCAL = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), sorted, and the least node that each reaches."""
    node, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(node))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return node, node[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # of roots alone, each of which goes below a lesser one
        while not np.array_equal(root, up := root[root]):
            root = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (long a, long b): the smallest node that links reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge
    changes, in O(log^2 n) rounds. Each step is a grouped minimum, which combines a hub's edges on the map
    side, and `_with_least`, which gathers no hub. Each round is cut. Up to `LOCAL` edges need no rounds: they are united on the driver, with the same result.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0] > LOCAL:
        ends = 2 * mark[0]  # a large star has no more edges than `e`
        big = cut(_with_least(e.union(e.select("v", "u")), ends, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(big, ends, False)
        e = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct())
        was, mark = mark, e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    if mark[0] <= LOCAL:
        found = e.toArrow()
        node, component = least_reachable(*(found.column(c).to_numpy().astype(np.int64) for c in ("u", "v")))
        return cut(e.sparkSession.createDataFrame(pa.table({"node": node, "component": component})))
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(batches, column: str, most: int = 1 << 20):
    """The record batches, sliced so that `column` has about `most` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the index of each text's first word (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= inside[1:-1][edges]
    last[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each with one space behind it, in one buffer; and their starts there (n + 1)."""
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 32, np.uint8)
    out[spread(at[:-1], size)] = data[spread(starts, size)]
    return out, at


def spread(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, end to end."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    some = size > 0
    starts, size = starts[some], size[some]
    if not total:
        return out
    at = np.cumsum(size)[:-1]
    out[0] = starts[0]
    out[at] = starts[1:] - (starts[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def crc_mod5(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5
