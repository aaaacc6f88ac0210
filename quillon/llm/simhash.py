"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in d <= 4 bits differ in at most d
bytes, so they hold the same byte at 8 - d >= 4 positions: the guaranteed minimum
of the count filter. Posting lists of single bytes would be 1/256 of the corpus
each, so the index posts triples of positional bytes instead. The twenty triples
of `TRIPLES` are a Turan system: any four positions hold one of them, so every
pair that the count filter would keep meets in a posting list. Inside a list the
shared positional bytes of each pair are tallied, pairs with fewer than the
guaranteed minimum are dropped and only the others are verified by their bit
difference. A list yields one edge for each member at most, from the first of its
component, and never all pairs, which leaves the components as they are.

A list longer than `most` (a hot group of near copies) is split and not capped: two
fingerprints that agree on the listed bits and differ in at most 4 of the others
agree on one of five blocks of these, so its members are posted again under the
five longer keys, until the lists are short. Every step fixes at least a fifth of
the free bits, so it ends.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, cut, joined, pieces, spare, text_bytes, words

SEED = 42
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _triples() -> list[tuple[int, ...]]:
    """Positions in groups of 3, 3 and 2; a triple lies in one group, or has two in one and one in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        n = [sum(group[p] == g for p in t) for g in range(3)]
        if 3 in n or any(n[g] == 2 and n[(g + 1) % 3] == 1 for g in range(3)):
            out.append(t)
    return out


TRIPLES = _triples()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints_of(col: pa.Array, n_words: int) -> np.ndarray:
    """One unsigned 64-bit SimHash for each text of a string column. No words: zero."""
    data, off = text_bytes(col)
    starts, ends, at = words(data, off)
    buf, pos = joined(FOLD[data], starts, ends)
    raw, out = buf.tobytes(), np.zeros(len(col), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(col)):
        a, b = int(at[i]), int(at[i + 1])
        if a == b:
            continue
        k = min(n_words, b - a)
        lo, hi = pos[a : b - k + 1].tolist(), (pos[a + k : b + 1] - 1).tolist()
        h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(lo, hi)), np.uint64, len(lo))
        ones = np.zeros(64, np.int64)
        for j in range(0, len(h), 1 << 16):
            part = h[j : j + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """(id, th, fp) of every row; th is a hash of the text, fp the fingerprint's bits as a long."""

    def run(batches):
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(fingerprints_of(b.column("t"), n_words).view(np.int64))], ["id", "th", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t")).mapInArrow(run, "id long, th long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally: at how many of the eight positions two fingerprints hold the same byte, from their XOR."""
    tally = np.zeros(x.shape, np.uint8)
    for p in range(8):
        tally += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    return tally


def _verified(x: np.ndarray, least: int, bits: int) -> np.ndarray:
    """Which XORs belong to links: bits are counted only where the tally reaches the guaranteed minimum."""
    near = np.zeros(x.shape, bool)
    some = np.nonzero(shared_bytes(x) >= least)
    near[some] = np.bitwise_count(x[some]) <= bits
    return near


def _forest(fp: np.ndarray, least: int, bits: int, rows: int = 128) -> list[tuple[int, int]]:
    """For each component of the verified links of one posting list, edges from its first member to the others.

    XORs are held for so many `rows` of the list at a time, and one byte for each of its pairs.
    """
    near = np.empty((len(fp), len(fp)), bool)
    for at in range(0, len(fp), rows):
        near[at : at + rows] = _verified(fp[at : at + rows, None] ^ fp[None, :], least, bits)
    left, out = np.ones(len(fp), bool), []
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & left)
            left[front] = False
            out += [(root, int(j)) for j in front]
    return out


def _links(bits: int, least: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            lists = batch.column("fps")
            flat = np.asarray(lists.flatten()).view(np.uint64)
            off = np.asarray(lists.offsets)
            off = off - off[0]
            size = np.diff(off)
            two = off[:-1][size == 2]
            near = _verified(flat[two] ^ flat[two + 1], least, bits)
            a.append(flat[two][near])
            b.append(flat[two + 1][near])
            for i in np.flatnonzero(size > 2):
                fp = flat[off[i] : off[i + 1]]
                if len(e := np.array(_forest(fp, least, bits))):
                    a.append(fp[e[:, 0]])
                    b.append(fp[e[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])

    return run


def _finer(batches):
    """Each (mask, fp) again under five masks that fix a fifth of the free bits more."""
    memo: dict[int, list[int]] = {}
    for batch in batches:
        mask, fp = (np.asarray(batch.column(c)) for c in ("mask", "fp"))
        new = np.empty((len(mask), 5), np.int64)
        for m in np.unique(mask).tolist():
            if m not in memo:
                free = [i for i in range(64) if not (m >> i) & 1]
                memo[m] = [_signed((m & (2**64 - 1)) | sum(1 << int(i) for i in part)) for part in np.array_split(free, 5)]
            new[mask == m] = memo[m]
        yield pa.RecordBatch.from_arrays([pa.array(new.ravel()), pa.array(np.repeat(fp, 5))], ["mask", "fp"])


def near_links(distinct: DataFrame, bits: int = 4, most: int = 2048) -> DataFrame:
    """(a, b): edges with the same components as the links of the distinct fingerprints `fp` under <= `bits` differing bits."""
    if not 0 <= bits <= 4:
        raise ValueError("triples of positional bytes find every pair only up to 4 differing bits")
    if most < 64:
        raise ValueError("a list with fewer than 5 free bits, so at most 32 members, can't be split")
    masks = [_signed(sum(255 << (8 * p) for p in t)) for t in TRIPLES]
    level = distinct.select(F.explode(F.array(*map(F.lit, masks))).alias("mask"), "fp")
    found = None
    while True:
        posts = level.select("mask", "fp", F.expr("fp & mask").alias("key"))
        sizes = cut(posts.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        lists = posts.join(sizes.where(F.col("n") <= most).drop("n"), ["mask", "key"]).groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        links = lists.select("fps").mapInArrow(_links(bits, 8 - bits), "a long, b long")
        found = links if found is None else found.union(links)
        if sizes.where(F.col("n") > most).isEmpty():
            return found
        hot = posts.join(sizes.where(F.col("n") > most).drop("n"), ["mask", "key"])
        level = cut(hot.select("mask", "fp").mapInArrow(_finer, "mask long, fp long").distinct())


def _assigned(docs: DataFrame, id_col: str, text_col: str, n_words: int, bits: int, most: int) -> DataFrame:
    """(id, th, fp, part, component_id): th is a hash of the text, part the least fingerprint of the component."""
    prints = cut(fingerprints(docs, id_col, text_col, n_words))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    parts = connected_components(near_links(distinct.select("fp"), bits, most)).withColumnRenamed("node", "fp")
    known = distinct.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    # cut, so that the join below has nothing but this table's row for a part to meet, and AQE can split a large component
    lowest = cut(known.groupBy("part").agg(F.min("least").alias("component_id")))
    return prints.join(cut(known.drop("least")).join(lowest, "part"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, bits: int = 4, most: int = 2048) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of `docs`.

    Nulls and empty texts have fingerprint zero and link like any other. A null id
    is kept; it has the smallest id of its component, null if there is none. Repeated
    rows give repeated rows. Other columns of `docs` are ignored, whatever their name.
    """
    found = _assigned(docs, id_col, text_col, n_words, bits, most)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, bits: int = 4, most: int = 2048) -> DataFrame:
    """The rows of `docs`, of each component only that with the smallest id, all columns as they were.

    Null ids come last; between rows of one id the least text hash stays, and of rows
    that repeat both, one.
    """
    last = (1 << 63) - 1
    key, th = spare(docs, "key", "th")
    found = _assigned(docs, id_col, text_col, n_words, bits, most)
    lead = found.groupBy("part").agg(F.min(F.struct(F.coalesce("id", F.lit(last)).alias("k"), "th")).alias("lead")).select(F.col("lead.k").alias(key), F.col("lead.th").alias(th))
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(last)), th: F.xxhash64(F.col(text_col).cast("string"))})
    return rows.join(lead, [key, th]).dropDuplicates([key, th]).select(*docs.columns)
