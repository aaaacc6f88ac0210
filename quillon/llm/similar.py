"""Near-dedup at a stated Jaccard similarity, exactly: SimHash's byte-position index, prefix filtering for the rest, parity fingerprints with a count filter, verification.

Texts whose SimHash fingerprints differ in 4 bits or fewer meet in the index of `simhash`, which tallies shared positional bytes.
No SimHash finds all pairs of a given similarity, so the exact way for the rest follows; both are verified alike.

A text is the set of its distinct word shingles, kept in one global order. Two sets of n and m shingles whose
Jaccard similarity is t or more share one among the first n - ceil(t n) + 1 of the one and the first
m - ceil(t m) + 1 of the other (Chaudhuri et al., 2006), so these prefixes are the posting lists and no pair is missed. Sizes
and places in the sets rule most pairs of a list out (Xiao et al., "PPJoin", 2008).

What is left meets the count filter. A set's fingerprint holds in bit i whether the number of its hashes that end in i is odd.
Each shingle that only one of two sets has changes one bit at most, so similar sets differ in no more than
(n + m) (1 - t) / (1 + t) bits (Sandes et al., "Bitmap filter", 2020): a bound that SimHash's majorities don't have. A fingerprint
has two to four bits a shingle and folds to shorter ones, so sets of any size compare. Survivors are verified by their sets.

Any order is right; rare shingles first keeps lists short. Shingles that batches hold repeatedly are counted, and
the most frequent of them go behind all others, which go by their hash.

Postings travel packed, as one string for each bucket of keys from each million of a task's. A list of up to `LIST` texts
yields all its pairs. In a longer one each text is paired with the list's first text, which unites what lies around one
original; where a task alone has so many, it pairs them itself and sends on the first only, so a list that all documents stand in
is never gathered. Long lists that are still of more than one component after that are split by sizes, and all pairs of different
components and near enough sizes meet the count filter there, in blocks of parts of `most` texts. What passes is verified pair by pair;
only where it is more pairs than texts are those texts' sets compared whole, by blocks again, which leave a forest of their links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, cut, pieces, spare, stored, text_bytes, words
from quillon.llm.simhash import FOLD, SEED, near_links

LIST = 32
#: How many shingles are ordered by how frequent they are, at most, and from what count on.
COMMON, COMMON_FROM = 1 << 16, 16
#: Shingles that are counted together before those seen once are left out; postings that are packed together, and that a bucket holds on average.
COUNTED, PACKED, BUCKET = 1 << 20, 1 << 20, 1 << 19
#: A posting's key has its bucket, of up to MOST_BUCKETS bits, and KEY_BITS more; a fingerprint has up to MOST_BITS.
KEY_BITS, MOST_BUCKETS, MOST_BITS = 40, 22, 1 << 16
#: Sets of nodes of up to so many rows (24 bytes each) are broadcast to where the texts are; beyond that both sides are shuffled.
BROADCAST_ROWS = 1 << 20
SLACK = 1e-9  # of comparisons that only rule pairs out
LONG_WORD = 256
LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
#: Odd multipliers by a word's place in its shingle.
PLACE = np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) | 1 for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word's bytes, eight at a time for all words together."""
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", raw.data, 0, (1,))  # the eight bytes from any byte on
    size = ends - starts
    h = mixed(size.astype(np.uint64))
    left = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        h[left] = mixed(h[left] ^ (eight[starts[left] + at] & LOW[np.minimum(size[left] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), SEED)
    return h


def shingle_sets(col: pa.Array, n_words: int):
    """For each text the sorted distinct hashes of its lower-cased shingles; a shorter text is one shingle, no words are none."""
    data, off = text_bytes(col)
    starts, ends, at = words(data, off)
    w = word_hashes(FOLD[data], starts, ends)
    n = max(0, len(w) - n_words + 1)
    whole = np.full(n, n_words, np.uint64)
    for k in range(n_words if n else 0):
        whole += w[k : k + n] * PLACE[k]
    whole = mixed(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n_words:
            yield np.unique(whole[a : b - n_words + 1])
        elif a < b:
            yield mixed((w[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_node(h: np.ndarray) -> int:
    """A set's node: 64 bits of its hashes."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def simhash(h: np.ndarray) -> int:
    """A set's SimHash, as a signed number: a bit is 1 where it is in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - SLACK)) + 1 if n else 0


def parities(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of hashes ends in i."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two fingerprints differ, the longer one folded to the shorter one's length."""
    if len(a) != len(b):
        a, b = sorted((a, b), key=len)
        b = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, len(a)), 0).tobytes()
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def _first_pass(n_words: int, similarity: float):
    """For each text (k, th, node, n, p, bits, fp), bits and fp where a stretch of texts has the node first; and (shingle, many) of those that texts of a stretch share."""
    names = ["k", "th", "node", "n", "p", "bits", "fp", "shingle", "many"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch(columns, n):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

    def counts(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return batch({"shingle": h[n > 1].view(np.int64), "many": n[n > 1]}, int((n > 1).sum()))

    def run(batches):
        held, total, seen = [], 0, set()
        for b in pieces(batches, "t"):
            nodes, sizes, bits, fps = [], [], [], []
            for h in shingle_sets(b.column("t"), n_words):
                nodes.append(set_node(h))
                sizes.append(len(h))
                bits.append(None)
                fps.append(None)
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    bits[-1], fps[-1] = parities(h), simhash(h)
                    held.append(h)
                    total += len(h)
            yield batch({"k": b.column("k"), "th": b.column("th"), "node": nodes, "n": sizes, "p": [prefix_length(n, similarity) for n in sizes], "bits": bits, "fp": fps}, len(nodes))
            if total >= COUNTED:
                yield counts(held)
                held, total, seen = [], 0, set()
        if held:
            yield counts(held)

    return run


FIRST_PASS = "k long, th long, node long, n int, p int, bits binary, fp long, shingle long, many long"


def common_shingles(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the rank of each among them, the rarest first. At most COMMON."""
    found = first.where("shingle is not null").groupBy("shingle").agg(F.sum("many").alias("n"))
    rows = found.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    h, n = np.asarray(rows.column("shingle").combine_chunks()).view(np.uint64), np.asarray(rows.column("n").combine_chunks())
    by_count = np.lexsort((h, n))
    rank = np.empty(len(h), np.int64)
    rank[by_count] = np.arange(len(h))
    by_hash = np.argsort(h)
    return h[by_hash], rank[by_hash]


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the global order, so many that a similar set shares one of its own first."""
    p = prefix_length(len(h), similarity)
    if not len(common):
        return h[:p]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    known = common[at] == h
    rare = h[~known]
    if len(rare) >= p:
        return rare[:p]
    return np.append(rare, h[known][np.argsort(rank[at[known]])[: p - len(rare)]])



def _may_link(n1, at1, n2, at2, similarity: float):
    """False where sizes or places rule a pair out, if the list is that of its first common shingle. Saturated sizes and places never do."""
    shared = np.minimum(n1 - at1, n2 - at2)
    ok = (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - SLACK) & (shared >= similarity / (1 + similarity) * (n1 + n2) - SLACK)
    return ok | (n1 >= N_MAX) | (n2 >= N_MAX)


#: Sizes and places are sent as 16 bits; places have 15, and the bit above says that the posting stands for a long list.
N_MAX, AT_MAX, STANDS = (1 << 16) - 1, (1 << 15) - 1, 1 << 15
POSTING = np.dtype([("low", "<u4"), ("high", "u1"), ("node", "<i8"), ("n", "<u2"), ("at", "<u2")])


def lists_of(x: dict, similarity: float):
    """Postings sorted by key and node, each once, to pairs (a, b), members of long lists (key, node), and the postings that stand for a list to others.

    Short lists stay as they are, of long ones the first posting stays.
    """
    begins = np.append(np.flatnonzero(np.append(True, np.diff(x["key"]) != 0)), len(x["key"]))
    size = np.diff(begins)
    long = (size > LIST) | np.logical_or.reduceat(x["stands"], begins[:-1])
    of_long = np.repeat(long, size)
    lead = np.repeat(begins[:-1], size)
    i = np.arange(len(lead))

    def pair(left, right):
        ok = _may_link(x["n"][left], x["at"][left], x["n"][right], x["at"][right], similarity) & (x["node"][left] != x["node"][right])
        return x["node"][left[ok]], x["node"][right[ok]]

    star = pair(lead[of_long], i[of_long])
    stops = lead + np.repeat(size, size)

    def short_pairs():
        some, out = i[~of_long & (np.repeat(size, size) > 1)], []
        for step in range(1, LIST):
            some = some[some + step < stops[some]]
            if not len(some):
                break
            out.append(pair(some, some + step))
        return out

    keep = ~of_long | (i == lead)
    stands = of_long & (i == lead)
    return star, short_pairs, (x["key"][of_long], x["node"][of_long]), keep, stands


def _postings(n_words: int, similarity: float, common, bits: int):
    """(bucket, kind, data): postings packed by bucket (kind 0), and of lists that are long in this task pairs (1) and members (2)."""

    def pack(held, turn):
        """Empties `held`, so that a task has its postings in memory once, not twice."""
        size = np.array([len(keys) for keys, _, _ in held])
        key = np.concatenate([keys for keys, _, _ in held])
        of = np.array([(node, min(n, N_MAX)) for _, node, n in held], np.int64)
        held.clear()
        at = np.minimum(np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size), AT_MAX).astype(np.int32)
        # a hash's low bits are the bucket and its high bits the key there, which is enough: what meets by chance is ruled out later
        key = ((key << np.uint64(64 - bits)) >> np.uint64(24 - bits)) | (key >> np.uint64(24))
        x = {"key": key.view(np.int64), "node": np.repeat(of[:, 0], size), "n": np.repeat(of[:, 1].astype(np.int32), size), "at": at, "stands": np.zeros(len(key), bool)}
        del key, at
        order = np.lexsort((x["node"], x["key"]))
        for c in x:
            x[c] = x[c][order]
        del order
        star, _, members, keep, stands = lists_of(x, similarity)
        out = np.empty(int(keep.sum()), POSTING)
        key = x["key"][keep]
        out["low"], out["high"], out["node"], out["n"] = key & 0xFFFFFFFF, (key >> 32) & 0xFF, x["node"][keep], x["n"][keep]
        out["at"] = x["at"][keep] | np.where(stands[keep], STANDS, 0)
        bucket = key >> KEY_BITS
        begins = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(bucket))
        rows = [(int(bucket[a]), 0, out[a:b].tobytes()) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        for kind, (a, b) in ((1, star), (2, members)):
            for lo in range(0, len(a), 1 << 14):  # anywhere: they need no list any more
                rows.append(((turn + len(rows)) * 7919 % (1 << bits), kind, np.stack([a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]]).astype("<i8").tobytes()))
        for lo in range(0, len(rows), 64):
            part = list(zip(*rows[lo : lo + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int8()), pa.array(part[2], pa.binary())], ["bucket", "kind", "data"])

    def run(batches):
        (known, rank), seen = common.value, set()
        held, total, turn = [], 0, 0
        for b in pieces(batches, "t"):
            for h in shingle_sets(b.column("t"), n_words):
                if not len(h) or (node := set_node(h)) in seen:
                    continue
                seen.add(node)
                keys = prefix(h, similarity, known, rank)
                held.append((keys.copy(), node, len(h)))  # a copy, which doesn't keep the whole set
                total += len(keys)
                if total >= PACKED:
                    yield from pack(held, turn)
                    total, turn, seen = 0, turn + total, set()
        if held:
            yield from pack(held, turn)

    return run


def unpacked(bucket: int, strings: list[bytes]) -> dict:
    """The postings of a bucket, sorted by key and node, each once."""
    rows = np.frombuffer(b"".join(strings), POSTING)
    key = (np.int64(bucket) << KEY_BITS) | (rows["high"].astype(np.int64) << 32) | rows["low"]
    stands = rows["at"] >= STANDS
    order = np.lexsort((~stands, rows["node"], key))  # one that stands for a list goes before its equal
    x = {"key": key[order], "node": rows["node"][order], "n": rows["n"][order].astype(np.int64), "at": (rows["at"] & AT_MAX)[order].astype(np.int64), "stands": stands[order]}
    new = np.append(True, (np.diff(x["key"]) != 0) | (np.diff(x["node"]) != 0))
    return {c: v[new] for c, v in x.items()}


def _pairs(similarity: float):
    """From packed postings, sorted by bucket, to pairs (a, b, key null) and, of lists over LIST, their members (a, b null, key)."""

    def batch(pairs, keys, nodes):
        ab = np.unique(np.concatenate([np.stack([np.minimum(a, b), np.maximum(a, b)], 1) for a, b in pairs] or [np.zeros((0, 2), np.int64)]), axis=0)
        a = pa.array(np.append(ab[:, 0], nodes))
        b = pa.concat_arrays([pa.array(ab[:, 1]), pa.nulls(len(nodes), pa.int64())])
        key = pa.concat_arrays([pa.nulls(len(ab), pa.int64()), pa.array(keys)])
        return pa.RecordBatch.from_arrays([a, b, key], ["a", "b", "key"])

    none = np.zeros(0, np.int64)

    def whole(bucket, strings):
        star, short_pairs, members, _, _ = lists_of(unpacked(bucket, strings), similarity)
        return batch([star, *short_pairs()], *members)

    def run(batches):
        now, strings = None, []
        for b in batches:
            for bucket, kind, data in zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("data")):
                data = data.as_py()
                if kind:
                    x, y = np.frombuffer(data, "<i8").reshape(2, -1)
                    yield batch([(x, y)], none, none) if kind == 1 else batch([], x, y)
                    continue
                if bucket != now and strings:
                    yield whole(now, strings)
                    strings = []
                now = bucket
                strings.append(data)
        if strings:
            yield whole(now, strings)

    return run


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """(a, b) of nodes with the same components as fingerprints (node, fp) of at most 4 differing bits."""
    lead = cut(prints.groupBy("fp").agg(F.min("node").alias("lead")))
    near = near_links(lead.select("fp"))
    same = prints.join(lead, "fp").where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    apart = near.join(lead.toDF("a", "x"), "a").join(lead.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(apart)


def _near_enough(similarity: float):
    """The count filter: keeps (a, b) whose fingerprints differ in no more bits than similar sets can."""
    most = (1 - similarity) / (1 + similarity)

    def run(batches):
        for t in batches:
            n1, n2 = (np.asarray(t.column(c)).astype(float) for c in ("n", "m"))
            limit = (n1 + n2) * most + SLACK * (n1 + n2)
            keep = [differing(x, y) <= z for x, y, z in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), limit.tolist())]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(n_words: int):
    def run(batches):
        for b in pieces(batches, "t"):
            sets = [h.view(np.int64) for h in shingle_sets(b.column("t"), n_words)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of these sets are that similar, as a square of booleans."""
    size = np.array([len(s) for s in sets])
    _, of, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    keep = many[of] > 1
    _, of = np.unique(of[keep], return_inverse=True)
    by = np.argsort(of, kind="stable")
    row, of = row[keep][by], of[by]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2^24
    for lo in range(0, int(of[-1]) + 1 if len(of) else 0, 2048):
        i = slice(*np.searchsorted(of, [lo, lo + 2048]))
        x = np.zeros((len(sets), 2048), np.float32)
        x[row[i], of[i] - lo] = 1
        shared += x @ x.T
    shared = shared.astype(np.float64)
    return shared >= similarity * (size[:, None] + size[None, :] - shared)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(first member, member) for each component of a symmetric square of booleans."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & left)
                left[front] = False
                out += [(i, j) for j in front.tolist()]
    return out


def _block(similarity: float):
    def run(table):
        node = np.asarray(table.column("node").combine_chunks())
        s = table.column("s").combine_chunks()
        off, flat = np.asarray(s.offsets), np.asarray(s.values)
        edges = forest(linked([flat[a:b] for a, b in zip(off[:-1], off[1:])], similarity))
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": node[a], "b": node[b]})

    return run


def near_within(n: np.ndarray, bits: list[bytes], apart: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of these sets that are `apart` (a square of booleans) and pass sizes and the count filter, by their sizes and fingerprints."""
    by = np.argsort(n, kind="stable")
    n, width, left, right = n[by], np.array([len(bits[i]) for i in by]), [], []
    most = (1 - similarity) / (1 + similarity) + SLACK
    stop = np.searchsorted(similarity * n - SLACK, n, "right")  # from there on sizes are too large
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        lo, hi = own[0], max(own[-1] + 1, stop[own[-1]])
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[by[i]], "<u8").reshape(-1, w // 8), 0) for i in range(lo, hi)])
        for i in own:
            to = np.arange(i + 1, stop[i])
            to = to[apart[by[i], by[to]]]
            differ = np.bitwise_count(folded[to - lo] ^ folded[i - lo]).sum(1, dtype=np.int64)
            to = to[differ <= (n[i] + n[to]) * most]
            left.append(np.full(len(to), by[i]))
            right.append(by[to])
    return np.concatenate(left), np.concatenate(right)


def _near_in_blocks(similarity: float):
    """From blocks (key, size, i, j) of texts to pairs (a, b, key null) that pass the count filter, or, if these are more than the block has texts, their texts (a, b null, key)."""

    def block(t):
        node, component, n = (np.asarray(t.column(c).combine_chunks()) for c in ("node", "component", "n"))
        part, larger = np.asarray(t.column("part").combine_chunks()), t.column("larger").combine_chunks().to_numpy(zero_copy_only=False)
        apart = (component[:, None] != component) & ~(larger[:, None] & larger)
        if t.column("i")[0] != t.column("j")[0]:
            apart &= part[:, None] != part
        if not apart.any():
            return []
        a, b = near_within(n, t.column("bits").to_pylist(), apart, similarity)
        if len(a) <= len(node):
            return [(np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), None)]
        some = np.unique(node[np.append(a, b)])
        return [(some, None, t.column("key")[0].as_py())]

    def out(t):
        if not t.num_rows:
            return
        by = [np.asarray(t.column(c).combine_chunks()) for c in ("key", "size", "i", "j")]
        begins = np.flatnonzero(np.append(True, np.any([np.diff(x) != 0 for x in by], 0)))
        for lo, hi in zip(begins, np.append(begins[1:], t.num_rows)):
            for a, b, key in block(t.slice(lo, hi - lo)):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array([key] * len(a), pa.int64())], ["a", "b", "key"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            same = np.all([np.asarray(t.column(c).combine_chunks()) == t.column(c)[-1].as_py() for c in ("key", "size", "i", "j")], 0)
            last = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # the last block may go on in the next batch
            yield from out(t.slice(0, last))
            held = t.slice(last).combine_chunks()
        if held is not None:
            yield from out(held)

    return run


def near_in_lists(posts: DataFrame, prints: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b, key null): pairs of different components in one of the lists `posts` (key, node, component) that pass the count filter; (a, b null, key): texts of which a list has too many.

    Sizes are split so that near enough ones are in one class or the next; lists that have the same texts there count once.
    """
    step = float(np.log((1 + 1e-6) / max(similarity, 1e-10)))
    rows = posts.join(prints.select("node", "n"), "node").withColumn("size", F.floor(F.log("n") / step).cast("long"))
    own = F.struct("size", F.lit(False).alias("larger"))
    below = F.struct((F.col("size") - 1).alias("size"), F.lit(True).alias("larger"))
    rows = rows.select("key", "node", "component", F.explode(F.array(own, below)).alias("x")).select("key", "node", "component", "x.size", "x.larger")
    same = [F.expr(f"bit_xor(xxhash64({k}, node, larger))").alias(f"x{k}") for k in range(2)]
    sums = [F.count(F.lit(1)).alias("many"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("larger").alias("none"), *same]
    groups = cut(rows.groupBy("key", "size").agg(*sums).where("lo < hi and not none").dropDuplicates(["size", "many", "x0", "x1"]).select("key", "size", "many"))
    of = F.ceil(F.col("many") / most).cast("int")
    rows = rows.join(groups, ["key", "size"]).withColumn("of", of).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    rows = rows.join(prints.select("node", "n", "bits"), "node").select("key", "size", "i", "j", "node", "component", "n", "part", "larger", "bits")
    return rows.repartition("key", "size", "i", "j").sortWithinPartitions("key", "size", "i", "j").mapInArrow(_near_in_blocks(similarity), "a long, b long, key long")


def list_links(posts: DataFrame, sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b): a forest of the links of each block of the lists `posts` (key, node, n)."""
    of = F.ceil(F.col("n") / most).cast("int")
    rows = posts.select("key", "node", of.alias("of")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("of").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    rows = rows.select("key", "node", "part", other.alias("other")).select("key", "node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return rows.join(sets, "node").groupBy("key", "i", "j").applyInArrow(_block(similarity), "a long, b long")


def sets_of(nodes: DataFrame, known: DataFrame, texts: DataFrame, n_words: int) -> DataFrame:
    """(node, s) of the distinct `nodes`, from the text of each node's first row."""
    asked = cut(known.join(nodes, "node").select("k", "th", "node"))
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    found = texts.join(asked, ["k", "th"]).select("node", "t").mapInArrow(_sets(n_words), "node long, s array<long>")
    return stored(found).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def similar_dedup(docs: DataFrame, similarity: float = 0.8, n_words: int = 5, id_col: str = "doc_id", text_col: str = "text", most: int = 512) -> DataFrame:
    """The rows of `docs`, of each component of links only that with the smallest id, all columns as they were.

    Texts link if their sets of lower-cased `n_words` shingles have a Jaccard similarity of at least `similarity`;
    null and empty texts and those of white space only have no words and are one group. Null ids come last; between rows of one id
    the least text hash stays, and of rows that repeat both, one. Texts of any length are taken whole. No rows give no rows.
    """
    if not 1 <= n_words <= len(PLACE):
        raise ValueError(f"shingles have 1 to {len(PLACE)} words")
    last = (1 << 63) - 1
    text = F.col(text_col).cast("string")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    first = stored(slim.mapInArrow(_first_pass(n_words, similarity), FIRST_PASS))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(first))
    total = first.agg(F.sum(F.col("p").cast("long"))).first()[0] or 0
    bits = min(MOST_BUCKETS, max(6, (total // BUCKET).bit_length()))
    known = cut(first.where("node is not null").groupBy("node").agg(F.min(F.struct("k", "th")).alias("lead"), F.first("n").alias("n")).select("node", "lead.k", "lead.th", "n"))
    prints = cut(first.where("bits is not null").select("node", "n", "bits", "fp").dropDuplicates(["node"]))

    posts = slim.select("t").mapInArrow(_postings(n_words, similarity, common, bits), "bucket int, kind byte, data binary")
    found = stored(posts.repartition(1 << min(bits, 15), "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs(similarity), "a long, b long, key long"))
    pairs = found.where("b is not null").select("a", "b").union(simhash_pairs(prints.select("node", "fp"))).distinct()
    prints = prints.drop("fp")
    both = pairs.join(prints.toDF("a", "n", "x"), "a").join(prints.toDF("b", "m", "y"), "b")
    near = cut(both.mapInArrow(_near_enough(similarity), "a long, b long"))
    lists = found.where("key is not null").select("key", F.col("a").alias("node"))

    sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), known, slim, n_words)
    links = cut(verified(near, sets, similarity))
    parts = connected_components(links)

    named = lists.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_lists = cut(named.join(apart.select("key"), "key").select("key", "node", "component").distinct())
    if not open_lists.isEmpty():
        more = cut(near_in_lists(open_lists, prints, similarity, most).distinct())
        pairs, crowds = more.where("b is not null").select("a", "b"), more.where("b is null").select("key", F.col("a").alias("node"))
        sets = sets_of(more.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), known, slim, n_words)
        links = links.union(cut(verified(pairs, sets, similarity)))
        if not crowds.isEmpty():
            sizes = crowds.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            links = links.union(cut(list_links(crowds.join(sizes, "key"), sets, similarity, most)))
        parts = connected_components(links)

    where = known.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    key, th = spare(docs, "key", "th")
    lead = where.groupBy("part").agg(F.min(F.struct("k", "th")).alias("lead")).select("lead.k", "lead.th")
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(last)), th: F.xxhash64(text)})
    return kept_rows(rows, first.where("node is not null").select("k", "th"), cut(lead), key, th).select(*docs.columns)


def kept_rows(rows: DataFrame, all_rows: DataFrame, lead: DataFrame, key: str, th: str) -> DataFrame:
    """Of `rows` those of `lead` (k, th), each once. all_rows: (k, th) of every row.

    Up to BROADCAST_ROWS that go, or that repeat, are broadcast and the rows stay where they are; beyond that they are shuffled.
    """
    counts = all_rows.groupBy("k", "th").agg(F.count(F.lit(1)).alias("n")).join(lead.withColumn("leads", F.lit(True)), ["k", "th"], "left")
    odd = cut(counts.where("leads is null or n > 1").select(F.col("k").alias(key), F.col("th").alias(th), (F.col("leads").isNotNull()).alias("again")))
    lead = lead.select(F.col("k").alias(key), F.col("th").alias(th))
    if odd.count() > BROADCAST_ROWS:
        return rows.join(lead, [key, th]).dropDuplicates([key, th])
    again = odd.where("again").select(key, th)
    once = rows.join(F.broadcast(odd.select(key, th)), [key, th], "left_anti")
    return once if again.isEmpty() else once.unionByName(rows.join(F.broadcast(again), [key, th]).dropDuplicates([key, th]))
