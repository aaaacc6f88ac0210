"""Exact substring dedup by super-k-mer partitioning.

A window is `k` consecutive words. Its minimiser is the least hash among its runs of
`m` words. Consecutive windows that share a minimiser's occurrence form a super-k-mer:
they travel as one packed string of words, so a text is sent about (k + run) / run times
and not k times. A super-k-mer's bucket comes from its minimiser; equal windows have equal
minimisers and so meet in one bucket. There windows are sorted by hash, document and start;
equal hashes are verified byte by byte, and every window but the first of its kind marks
its words for removal. The marks, ranges of word positions, go back to their documents.

A map task sends what it has for a bucket as one compressed block, its rows ordered by a finer
share of the minimiser. The number of buckets follows the size of the texts, so that
a bucket stays near `bucket` bytes; it is read block by block and compared share by share.

A passage in a third of all documents fills its bucket without bound, so a bucket
that outgrows `slab` bytes is first collapsed: equal strings leave their earliest
occurrence, and the others are marked at once. What still outgrows it is split and not
capped: its windows leave the task one by one and are compared by Spark's own grouped
minimum, keyed by the window itself, which combines equal windows on the map side.

Rows are ordered by (doc_id, hash of the text); null ids come last. Rows that repeat both are one
document and get one result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, joined, pieces, spread, text_bytes, words

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LAST = (1 << 63) - 1


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n + 1, p, np.uint64)
    out[0] = 1
    return np.cumprod(out)


P, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
BYTE_POWERS = _powers(0xD6E8FEB86659FD93, 4095)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * K2
    return h ^ (h >> np.uint64(29))


def word_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in `joined` form: its bytes by powers of an odd number, modulo 2^64."""
    out = np.zeros(len(at) - 1, np.uint64)
    lo = 0
    while lo < len(out):  # about a megabyte at a time
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20))) - 1)
        part, head = buf[at[lo] : at[hi]], (at[lo:hi] - at[lo]).astype(np.int32)
        place = np.arange(len(part), dtype=np.int32)
        place -= np.repeat(head, np.diff(at[lo : hi + 1]))
        place &= 4095
        weigh = BYTE_POWERS[place]
        weigh *= part + np.uint64(1)
        out[lo:hi] = np.add.reduceat(weigh, head)
        lo = hi
    return mix(out)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of `n` words: from prefix sums, so that it costs the same for any n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(P, len(h)), _powers(INVERSE, len(h))
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
    return mix((c[n:] - c[:-n]) * down[: len(h) - n + 1])


def _super_kmers(data: np.ndarray, off: np.ndarray, k: int, m: int):
    """Per super-k-mer: text, first window, number of windows, minimiser; and the words in `joined` form."""
    starts, ends, first = words(data, off)
    buf, at = joined(data, starts, ends)
    h = word_hashes(buf, at)
    runs = run_hashes(h, m)
    span = k - m + 1  # runs in a window
    n = len(h) - k + 1
    if n <= 0:
        return None
    # sliding minimum of (hash, position), the leftmost on ties, by doubling
    low, arg = runs.copy(), np.arange(len(runs))
    width = 1
    while width < span:
        step = min(width, span - width)
        other, other_at = low[step:], arg[step:]
        size = len(other)
        better = other < low[:size]
        low, arg = np.where(better, other, low[:size]), np.where(better, other_at, arg[:size])
        width += step
    low, arg = low[:n], arg[:n]
    count = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    window = spread(first[:-1], count)
    if not len(window):
        return None
    a, t = arg[window], text
    new = np.ones(len(window), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    head = np.flatnonzero(new)
    return t[head], window[head] - first[t[head]], np.diff(np.append(head, len(window))), low[window[head]], window[head], buf, at


FIELDS = (("share", np.uint8), ("k1", np.int64), ("k2", np.int64), ("start", np.int32), ("n", np.int32), ("size", np.int32))


def gathered(text: np.ndarray, starts: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The ranges of `text` end to end, about `most` bytes at a time: their positions take eight times the room."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    lo = at = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, at + most, "right")))
        out[at : ends[hi - 1]] = text[spread(starts[lo:hi], size[lo:hi].astype(np.int64))]
        lo, at = hi, int(ends[hi - 1])
    return out


class Rows:
    """Super-k-mers as columns; `text` holds their packed strings end to end."""

    def __init__(self, text: np.ndarray, **columns: np.ndarray):
        self.text = text
        self.__dict__.update({name: columns[name].astype(kind, copy=False) for name, kind in FIELDS})

    def __len__(self) -> int:
        return len(self.n)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def take(self, pick: np.ndarray) -> Rows:
        return Rows(gathered(self.text, self.starts()[pick], self.size[pick]), **{f: getattr(self, f)[pick] for f, _ in FIELDS})

    def cut(self, lo: int, hi: int) -> Rows:
        at = int(self.size[:lo].sum(dtype=np.int64))
        return Rows(self.text[at : at + int(self.size[lo:hi].sum(dtype=np.int64))], **{f: getattr(self, f)[lo:hi] for f, _ in FIELDS})

    def strings(self) -> pa.Array:
        off = np.append(0, np.cumsum(self.size, dtype=np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(self.text))])

    def packed(self, press: zstandard.ZstdCompressor) -> bytes:
        """Columns byte-plane by byte-plane after differences of ids, so that they compress."""
        out = [np.int64(len(self)).tobytes()]
        for f, kind in FIELDS:
            x = getattr(self, f)
            x = np.diff(x, prepend=x[:1] * 0) if f == "k1" else x
            out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
        return press.compress(b"".join([*out, self.text.tobytes()]))

    @staticmethod
    def unpacked(blob: bytes, press: zstandard.ZstdDecompressor) -> Rows:
        raw = np.frombuffer(press.decompress(blob), np.uint8)
        n, at, cols = int(raw[:8].view(np.int64)[0]), 8, {}
        for f, kind in FIELDS:
            width = np.dtype(kind).itemsize
            x = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind)
            cols[f] = np.cumsum(x, dtype=np.int64) if f == "k1" else x
            at += n * width
        return Rows(raw[at:], **cols)

    @staticmethod
    def together(parts: list[Rows]) -> Rows:
        return Rows(np.concatenate([p.text for p in parts]), **{f: np.concatenate([getattr(p, f) for p in parts]) for f, _ in FIELDS})


def super_kmers(k: int, m: int, buckets: int, flush: int = 16 << 20):
    """From (k1, k2, t) to (bucket, block)."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        held, held_at, size = [], [], 0

        def blocks():
            rows, bucket = Rows.together(held), np.concatenate(held_at)
            order = np.argsort(bucket * 256 + rows.share, kind="stable")
            rows, bucket = rows.take(order), bucket[order]
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for j in range(0, len(edge) - 1, 256):
                some = edge[j : j + 257]
                blobs = [rows.cut(a, b).packed(press) for a, b in zip(some[:-1].tolist(), some[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[some[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "block"])

        for b in pieces(batches, "t"):
            data, off = text_bytes(b.column("t"))
            if (got := _super_kmers(data, off, k, m)) is None:
                continue
            text, start, n, mini, begin, buf, at = got
            lo, length = at[begin], at[begin + n + k - 1] - at[begin] - 1
            k1, k2 = (np.asarray(b.column(c))[text] for c in ("k1", "k2"))
            held.append(Rows(gathered(buf, lo, length), share=(mini >> np.uint64(16)) & np.uint64(255), k1=k1, k2=k2, start=start, n=n, size=length))
            held_at.append(((mini >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64))
            size += len(held[-1].text)
            if size >= flush:
                yield from blocks()
                held, held_at, size = [], [], 0
        if held:
            yield from blocks()

    return run


def _windows(rows: Rows, k: int):
    """Every window of the packed strings: key columns, start, hash, and the words in `joined` form."""
    off = np.append(0, np.cumsum(rows.size, dtype=np.int64))
    starts, ends, first = words(rows.text, off)
    buf, at = joined(rows.text, starts, ends)
    n = rows.n.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    begin = spread(first[:-1], n)
    h = run_hashes(word_hashes(buf, at), k)[begin]
    return rows.k1[row], rows.k2[row], spread(rows.start.astype(np.int64), n), h, begin, buf, at


def _repeats(rows: Rows, k: int):
    """(k1, k2, start, stop) of every window that is not the first of its kind."""
    k1, k2, start, h, begin, buf, at = _windows(rows, k)
    order = np.argsort(h)
    s = h[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    order = order[np.lexsort((start[order], k2[order], k1[order], h[order]))]
    if not len(order):
        return k1[:0], k2[:0], start[:0], start[:0]
    s, lo, size = h[order], at[begin[order]], at[begin[order] + k] - at[begin[order]]
    same = s[1:] == s[:-1]
    equal = same & (size[1:] == size[:-1])
    i = np.flatnonzero(equal)
    for j in range(0, len(i), 1 << 13):
        p = i[j : j + (1 << 13)]
        differ = buf[spread(lo[p], size[p])] != buf[spread(lo[p + 1], size[p])]
        bad = np.add.reduceat(differ, np.cumsum(size[p]) - size[p], dtype=np.int64) > 0
        equal[p[bad]] = False
    if not np.array_equal(equal, same):  # hashes collide: compare the words themselves
        text = [buf[a : a + b].tobytes() for a, b in zip(lo, size)]
        by = sorted(range(len(order)), key=lambda x: (text[x], k1[order[x]], k2[order[x]], start[order[x]]))
        order, text = order[by], [text[x] for x in by]
        equal = np.array([a == b for a, b in zip(text, text[1:])], bool)
    return _later(order, equal, k1, k2, start, np.full(len(start), k))


def _later(order, equal, k1, k2, start, size):
    """Of rows in order, runs of which are equal: those that aren't the run's first row, nor that row once more."""
    head = np.ones(len(order), bool)
    head[1:] = ~equal
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    late = order[(k1[order] != k1[lead]) | (k2[order] != k2[lead]) | (start[order] != start[lead])]
    return k1[late], k2[late], start[late], start[late] + size[late]


def _collapsed(rows: Rows, k: int):
    """One row for each string, its earliest; and the ranges of the others, which repeat it from end to end."""
    code = np.asarray(rows.strings().dictionary_encode().indices)
    order = np.lexsort((rows.start, rows.k2, rows.k1, code))
    equal = code[order][1:] == code[order][:-1]
    gone = _later(order, equal, rows.k1, rows.k2, rows.start, rows.n + k - 1)
    return rows.take(np.sort(order[np.append(True, ~equal)])), gone


RANGES = "k1 long, k2 long, start int, stop int, window binary"


def _ranges(k1, k2, start, stop) -> pa.RecordBatch:
    """Marked words as ranges: those of a document that touch in one."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start, stop = k1[order], k2[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    doc = np.ones(len(start), bool)
    doc[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    # the furthest end so far within a document, by an offset that grows with the document
    base = np.cumsum(doc) << 32
    far = np.maximum.accumulate(stop + base) - base
    new = doc.copy()
    new[1:] |= start[1:] > far[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1 if len(head) else head
    cols = [pa.array(k1[head]), pa.array(k2[head]), pa.array(start[head].astype(np.int32)), pa.array(far[last].astype(np.int32))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(head), pa.binary())], ["k1", "k2", "start", "stop", "window"])


def compare(k: int, slab: int):
    """Reads blocks in the order of their buckets. Yields ranges of words to remove, and the windows of what outgrows a slab."""

    def loose(rows: Rows):
        for lo in range(0, len(rows), 1024):
            k1, k2, start, _, begin, buf, at = _windows(rows.cut(lo, lo + 1024), k)
            size = at[begin + k] - at[begin] - 1
            off = np.append(0, np.cumsum(size)).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(buf[spread(at[begin], size)])])
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32)), pa.array((start + k).astype(np.int32)), text], ["k1", "k2", "start", "stop", "window"])

    def whole(parts: list[Rows]):
        """A bucket, share by share."""
        rows = Rows.together(parts)
        rows = rows.take(np.argsort(rows.share, kind="stable"))
        edge = np.append(np.flatnonzero(np.diff(rows.share.astype(int), prepend=-1)), len(rows))
        ends = np.append(0, np.cumsum(rows.size, dtype=np.int64))[edge]
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + slab // 8, "right")) - 1)
            part = rows.cut(edge[i], edge[j])
            if len(part.text) > slab // 2:
                part, gone = _collapsed(part, k)
                yield _ranges(*gone)
            if len(part.text) > slab // 2:
                yield from loose(part)
            else:
                yield _ranges(*_repeats(part, k))
            i = j

    def run(batches):
        press = zstandard.ZstdDecompressor()
        parts, size, least, now, hot = [], 0, 0, None, False

        def close():
            if hot and parts:
                rows, gone = _collapsed(Rows.together(parts), k)
                yield _ranges(*gone)
                yield from loose(rows)
            elif parts:
                yield from whole(parts)

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if bucket != now:
                    yield from close()
                    parts, size, least, now, hot = [], 0, 0, bucket, False
                parts.append(Rows.unpacked(blob.as_buffer().to_pybytes(), press))
                size += len(parts[-1].text)
                if size - least < 2 * slab:
                    continue
                rows, gone = _collapsed(Rows.together(parts), k)
                yield _ranges(*gone)
                if hot or len(rows.text) > 2 * slab:
                    hot = True
                    yield from loose(rows)
                    parts, size, least = [], 0, 0
                else:
                    parts, size = [rows], len(rows.text)
                    least = size
        yield from close()

    return run


def repeated_ranges(docs: DataFrame, k: int = 20, m: int = 3, bucket: int = 8 << 20, slab: int = 16 << 20) -> DataFrame:
    """(k1, k2, start, stop): words of documents that repeat an earlier window. docs: (k1, k2, t)."""
    if not 0 < m < k:
        raise ValueError("a minimiser is shorter than a window")
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(64, 3 * size // bucket)
    blocks = docs.mapInArrow(super_kmers(k, m, buckets), "bucket int, block binary")
    got = cut(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare(k, slab), RANGES))
    easy = got.where("window is null").drop("window")
    loose = got.where("window is not null")
    if loose.isEmpty():
        return easy
    owner = loose.groupBy("window").agg(F.min(F.struct("k1", "k2", "start")).alias("lead"))
    hard = loose.join(owner, "window").where("struct(k1, k2, start) != lead").drop("window", "lead")
    return easy.union(hard.select(*easy.columns))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    k1 = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    again = cut(docs.select(k1.alias("k1")).groupBy("k1").count().where("count > 1").select("k1", F.lit(True).alias("again")))
    rows = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), text.alias("t"))
    if again.isEmpty():
        return rows.withColumn("k2", F.lit(0).cast("long"))
    # the hash is sent along only where it tells rows apart
    return rows.join(again, "k1", "left").select("id", "k1", "t", F.when(F.col("again"), F.xxhash64("t")).otherwise(0).cast("long").alias("k2"))


def _kept(batch: pa.RecordBatch):
    """Per text: the kept words joined by one space, the number of words and of removed words."""
    data, off = text_bytes(batch.column("t"))
    starts, ends, first = words(data, off)
    n = len(starts)
    ranges = batch.column("ranges")
    flat = ranges.flatten()
    size = np.diff(np.asarray(ranges.offsets)) if len(ranges) else np.zeros(0, np.int64)
    if ranges.null_count:
        size = np.where(np.asarray(ranges.is_null()), 0, size)
    base = np.repeat(first[:-1], size)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, base + np.asarray(flat.field(0)), 1)
    np.add.at(mark, base + np.asarray(flat.field(1)), -1)
    keep = np.cumsum(mark)[:n] == 0
    buf, at = joined(data, starts[keep], ends[keep])
    left = np.concatenate(([0], np.cumsum(keep)))[first]
    raw = buf.tobytes()
    texts = [raw[at[a] : max(at[a], at[b] - 1)] for a, b in zip(left[:-1], left[1:])]
    return texts, np.diff(first), np.diff(first) - np.diff(left)


def _with_ranges(docs: DataFrame, k: int, m: int, bucket: int, slab: int) -> DataFrame:
    found = repeated_ranges(docs.select("k1", "k2", "t"), k, m, bucket, slab)
    by_doc = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    return docs.join(by_doc, ["k1", "k2"], "left").select("id", "t", "ranges")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 3, bucket: int = 8 << 20, slab: int = 16 << 20) -> DataFrame:
    """(id_col, text): every row with the words of repeated windows removed, the others joined by one space.

    A null or empty text, and one of fewer than `k` words, loses nothing (null gives an empty text).
    """
    docs = _keyed(docs, id_col, text_col)

    def run(batches):
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(_kept(b)[0], pa.binary()).cast(pa.string())], ["id", "text"])

    out = _with_ranges(docs, k, m, bucket, slab)
    return out.mapInArrow(run, docs.select("id").schema.add("text", "string")).toDF(id_col, text_col)


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 3, bucket: int = 8 << 20, slab: int = 16 << 20) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of what `substring_dedup` returns."""
    docs = _keyed(docs, id_col, text_col)

    def run(batches):
        for b in pieces(batches, "t"):
            texts, n, gone = _kept(b)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(gone), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.select("id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return _with_ranges(docs, k, m, bucket, slab).mapInArrow(run, kind).withColumnRenamed("id", id_col)
