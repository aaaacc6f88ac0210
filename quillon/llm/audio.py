"""Chroma audio fingerprints of a media column.

A recording's spectrum is folded into twelve pitch classes a frame. Sixteen box filters over
this image, evaluated on its integral image, are quantised to two Gray-coded bits each: one packed
32-bit integer a frame. Recordings that share an integer, however few, are aligned: equal integers vote in a
histogram of offsets, and the bit errors over the overlap at the best offset decide. Parts of the recordings meet in
pairs, so no match is missed; an index of integers finds the pairs of two parts that have a vote.

Pairs that something joins already aren't compared, and a block of parts yields a forest of its links, never all pairs.
Equal fingerprints are one recording with several ids.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import connected_components, cut, spread

FRAME, HOP, WIDTH = 512, 128, 8
#: Steps of the log ratios; 0, where a filter sees no energy, lies between two of them.
LEVELS = (-0.7, 0.05, 0.7)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, classes, frames): the six box patterns at heights and widths that double and shift by a rule."""
    out = []
    for n in range(16):
        kind = n % 6
        height = (12, 4, 8, 6, 12, 3)[(n // 6 + kind) % 6] if kind in (1, 3, 5) else (4, 6, 12)[n // 6]
        width = WIDTH if kind in (2, 3, 4) else WIDTH >> (n // 6)
        out.append((kind, n * 5 % (13 - height), height, max(2, width)))
    return out


FILTERS = _filters()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 shares of energy by pitch class, 0 where a frame is silent."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    spectrum = np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (hertz >= 80) & (hertz <= min(3600, 0.45 * rate))
    fold = np.zeros((len(hertz), 12))
    fold[np.flatnonzero(heard), np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    energy = (power @ fold.astype(np.float32)).astype(float)
    total = energy.sum(1, keepdims=True)
    loud = total > 1e-6 * max(total.max(), 1e-12)
    return np.where(loud, energy / np.maximum(total, 1e-30), 0)


def codes_of(samples: np.ndarray, rate: int) -> np.ndarray:
    """One packed integer for each frame that has WIDTH frames from it on; frames of silence at both ends are left out."""
    image = chroma(samples, rate)
    loud = np.flatnonzero(image.any(1))
    if not len(loud):
        return np.zeros(0, np.uint32)
    image = image[loud[0] : loud[-1] + 1]
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def box(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return total[t + t1, y1] - total[t + t0, y1] - total[t + t1, y0] + total[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole, half_h, half_w, third_h, third_w = box(0, w, y, y + h), h // 2, w // 2, h // 3, w // 3
        if kind == 0:
            a, b = whole, w * h / 12 * np.ones(n)
        elif kind == 1:
            a = box(0, w, y, y + half_h)
            b = whole - a
        elif kind == 2:
            a = box(0, half_w, y, y + h)
            b = whole - a
        elif kind == 3:
            a = box(0, half_w, y, y + half_h) + box(half_w, w, y + half_h, y + h)
            b = whole - a
        elif kind == 4:
            a = 2 * box(0, w, y + third_h, y + 2 * third_h)
            b = whole - a / 2
        else:
            a = 2 * box(third_w, w - third_w, y, y + h)
            b = whole - a / 2
        level = np.digitize(np.log((0.1 + a) / (0.1 + b)), LEVELS)
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def from_wav(blob: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (channels averaged) and rate of PCM WAV bytes; what can't be read is silence."""
    try:
        with wave.open(io.BytesIO(blob or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 8000
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1, 256, 65536]).astype(np.int32)
        x = (x - (x >= 1 << 23) * (1 << 24)).astype(float)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float)
    return x.reshape(-1, channels).mean(1), rate


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Callable = from_wav) -> DataFrame:
    """(id, codes) of every row. decode: from a cell to (samples, rate)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                codes = [codes_of(*decode(x)).view(np.int32) for x in part.column("m").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(codes, pa.list_(pa.int32()))], ["id", "codes"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("m")).mapInArrow(run, "id long, codes array<int>")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset, overlap, bit error): b's position 0 stands at a's `offset`, where most equal integers vote. Overlap 0: no vote."""
    order = np.argsort(b, kind="stable")
    s = b[order]
    lo, hi = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    n = hi - lo
    if not n.any():
        return 0, 0, 1.0
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    votes = np.bincount(i - j + len(b))
    best = np.flatnonzero(votes == votes.max()) - len(b)
    offset = int(best[np.argmin(np.abs(best))])
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    overlap = min(len(x), len(y))
    wrong = int(np.bitwise_count(x[:overlap] ^ y[:overlap]).sum())
    return offset, overlap, wrong / (32 * overlap)


def run_keys(codes: np.ndarray) -> np.ndarray:
    """What two recordings must share one of, or no offset gets a vote: the integers, each once."""
    return np.unique(codes).astype(np.int64)


def _meetings(first: list[np.ndarray], second: list[np.ndarray] | None, root: np.ndarray, most: int):
    """(i, j, offset) of pairs that share an integer, i in `first` and j in `second` (without it: j > i in `first`): as `align` has it, all pairs of some i at a time.

    Pairs of one `root` (of `first`, then of `second`) by then are left out. Each integer's places are sorted by root, so that those of the own
    one aren't even counted, and sorted anew as roots change. An i with over `most` votes goes through `align`, one j after the other.
    """
    other = first if second is None else second
    theirs = root[len(first) :] if second is not None else root  # a view
    size, own_size = (np.array([len(c) for c in x]) for x in (other, first))
    code, own = np.concatenate(other).astype(np.uint64) << np.uint64(32), np.concatenate(first).astype(np.uint64) << np.uint64(32)
    of, whose = np.repeat(np.arange(len(other)), size), np.repeat(np.arange(len(first)), own_size)
    at, place = (spread(np.zeros(len(n), np.int64), n) for n in (size, own_size))
    begins = np.append(0, np.cumsum(own_size))
    was, i, counted = None, 0, 0
    while i < len(first):
        if was is None or 4 * counted >= len(code) and not np.array_equal(was, root):
            was, counted = root.copy(), 0
            if second is None:  # nothing before i is asked for again
                left = of > i
                code, of, at = code[left], of[left], at[left]
            key = code | was[len(was) - len(other) :][of].astype(np.uint64)
            order = np.argsort(key)
            key, code, of, at = key[order], code[order], of[order], at[order]
        some = max(i + 1, int(np.searchsorted(begins, begins[i] + min(most, 1 << 14), "right")) - 1)
        r = slice(begins[i], begins[some])
        own_key = own[r] | was[whose[r]].astype(np.uint64)
        lo, hi = np.searchsorted(key, own[r]), np.searchsorted(key, own[r] | np.uint64(0xFFFFFFFF), "right")
        same, past = np.searchsorted(key, own_key), np.searchsorted(key, own_key, "right")
        total = np.append(0, np.cumsum(np.bincount(whose[r] - i, same - lo + hi - past, some - i).astype(np.int64)))
        to = i + max(1, int(np.searchsorted(total, most, "right")) - 1)
        n = begins[to] - begins[i]
        starts, votes = np.stack([lo[:n], past[:n]], 1).ravel(), np.stack([same[:n] - lo[:n], hi[:n] - past[:n]], 1).ravel()
        counted += int(total[to - i]) + n
        if total[to - i] > most:
            met = np.unique(of[spread(starts, votes)])
            for some in range(0, len(met), 64):
                j = met[some : some + 64]
                j = j[(theirs[j] != root[i]) & ((j > i) | (second is not None))]
                yield np.full(len(j), i), j, np.array([align(first[i], other[y])[0] for y in j.tolist()], np.int64)
        else:
            hit, r = spread(starts, votes), slice(begins[i], begins[to])
            x, y, d = np.repeat(np.repeat(whose[r], 2), votes), of[hit], np.repeat(np.repeat(place[r], 2), votes) - at[hit]
            apart = (theirs[y] != root[x]) & ((y > x) | (second is not None))
            x, y, d = x[apart], y[apart], d[apart]
            if len(x):
                # votes by pair and offset; of a pair's, the most, then the least offset, then a negative one
                low, wide = int(d.min()), int(d.max() - d.min()) + 1
                found, n = np.unique(((x - i) * len(other) + y) * wide + (d - low), return_counts=True)
                pair, d = found // wide, found % wide + low
                best = np.lexsort((d, np.abs(d), -n, pair))
                best = best[np.append(True, np.diff(pair[best]) != 0)]
                yield i + pair[best] // len(other), pair[best] % len(other), d[best]
        i = to


def _bit_errors(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Differing bits of stretches of `overlap` integers."""
    wrong = np.bitwise_count(a[spread(a_at, overlap)] ^ b[spread(b_at, overlap)])
    return np.add.reduceat(wrong, np.cumsum(overlap) - overlap, dtype=np.int64)


def forest(first: list[np.ndarray], second: list[np.ndarray] | None, most_error: float, least_overlap: float, most: int = 1 << 18, root: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """(i, j, offset, error): a forest of the matches of recordings in `first` with those in `second`, or without `second` with each other.

    Every pair that shares an integer is aligned, so long as nothing joins the two already: an earlier match, or equal numbers from 0 on in `root`.
    Members of `second` count on from those of `first`.
    """
    if not len(first) or second is not None and not len(second):
        return []
    other, shift = (first, 0) if second is None else (second, len(first))
    a, b = np.concatenate(first), np.concatenate(other)
    n, m = np.array([len(c) for c in first]), np.array([len(c) for c in other])
    a0, b0 = np.cumsum(n) - n, np.cumsum(m) - m
    root = np.arange(len(first) + (len(second) if second is not None else 0)) if root is None else root.copy()
    out = []
    for i, j, d in _meetings(first, second, root, most):
        x, y = np.maximum(d, 0), np.maximum(-d, 0)
        overlap = np.minimum(n[i] - x, m[j] - y)
        some = np.flatnonzero((overlap >= least_overlap * np.minimum(n[i], m[j])) & (root[i] != root[j + shift]))
        stops = np.cumsum(overlap[some])
        while len(some):
            k = max(1, int(np.searchsorted(stops, stops[0] - overlap[some[0]] + 4 * most, "right")))
            part, some, stops = some[:k], some[k:], stops[k:]
            error = _bit_errors(a, a0[i[part]] + x[part], b, b0[j[part]] + y[part], overlap[part]) / (32 * overlap[part])
            for p, e in zip(part[error <= most_error].tolist(), error[error <= most_error].tolist()):
                u, v = root[i[p]], root[j[p] + shift]
                if u != v:
                    out.append((int(i[p]), int(j[p]) + shift, int(d[p]), e))
                    root[root == max(u, v)] = min(u, v)
    return out


KIND = "a long, b long, offset long, error double"


def _codes(col: pa.Array) -> list[np.ndarray]:
    return [np.asarray(c.values).view(np.uint32) for c in col]


def _block(most_error: float, least_overlap: float):
    """Two parts of the recordings, or one with itself. a is the one before by (least, sha); what has one `root` is joined already."""

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("least", "ascending"), ("sha", "ascending")])
        part, ids = np.asarray(table.column("part").combine_chunks()), np.asarray(table.column("id").combine_chunks())
        codes = _codes(table.column("codes").combine_chunks())
        if i == j:
            links = forest(codes, None, most_error, least_overlap)
        else:
            own, other = np.flatnonzero(part == i), np.flatnonzero(part == j)
            place = np.append(own, other)
            _, root = np.unique(np.asarray(table.column("root").combine_chunks())[place], return_inverse=True)
            links = []
            for x, y, offset, error in forest([codes[k] for k in own], [codes[k] for k in other], most_error, least_overlap, root=root):
                x, y = int(place[x]), int(place[y])
                if x > y:  # a tie of offsets is broken from the earlier one's side
                    x, y = y, x
                    offset, _, error = align(codes[x], codes[y])
                links.append((x, y, offset, error))
        a, b, off, err = list(zip(*links)) or ((), (), (), ())
        return pa.table({"a": pa.array(ids[list(a)], pa.int64()), "b": pa.array(ids[list(b)], pa.int64()), "offset": pa.array(off, pa.int64()), "error": pa.array(err, pa.float64())})

    return run


def link_recordings(distinct: DataFrame, most_error: float, least_overlap: float, most: int = 1 << 14) -> DataFrame:
    """(a, b, offset, error): matches that join whatever matches among the recordings (id, least, sha, codes).

    They are cut into parts of about `most` by hash. First each part is a task, then each pair of parts, which leaves out pairs that the parts have
    joined. All other pairs that share an integer are compared, which grows with the square of the recordings where few of them match.
    """
    total = distinct.count()
    parts = max(1, -(-total // most), min(8, -(-total // 512)))
    parted = distinct.withColumn("part", F.pmod(F.xxhash64("sha"), F.lit(parts)).cast("int"))
    columns = ["id", "least", "sha", "codes", "part", "root", "i", "j"]
    alone = parted.select("*", F.col("id").alias("root"), F.col("part").alias("i"), F.col("part").alias("j")).select(columns)
    within = alone.repartition(parts, "i", "j").groupBy("i", "j").applyInArrow(_block(most_error, least_overlap), KIND)
    if parts == 1:
        return within
    within = cut(within)
    known = connected_components(within.select("a", "b")).select(F.col("node").alias("id"), "component")
    rooted = parted.join(known, "id", "left").withColumn("root", F.coalesce("component", "id"))
    other = rooted.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("part != other")
    sides = other.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).select(columns)
    blocks = sides.repartition(parts * (parts - 1) // 2, "i", "j").groupBy("i", "j")
    return within.union(blocks.applyInArrow(_block(most_error, least_overlap), KIND))


def align_recordings(media: DataFrame, id_col: str = "rec_id", media_col: str = "media", decode: Callable = from_wav, most_error: float = 0.2, least_overlap: float = 0.5, most: int = 1 << 14) -> DataFrame:
    """(id_col, n_codes, codes_sha256, group_id, aligned_to, offset, bit_error), one row for each row of `media`.

    group_id is the smallest id that links reach, the own id without links; aligned_to is, of the recordings before it that
    it was compared with and matched, the one with the fewest bit errors (then the smallest id), at `offset` frames; null for those that
    matched none. Silent, null and unreadable media have no codes and link with nothing. Rows of equal fingerprints share a group; repeated and
    null ids are kept. Recordings of any length are taken whole.
    No rows give no rows.
    """
    prints = cut(fingerprints(media, id_col, media_col, decode).withColumn("n", F.size("codes")).withColumn("sha", F.sha2(F.array_join(F.transform("codes", lambda c: F.hex(c)), ",").cast("binary"), 256)))
    heard = prints.where("n > 0")
    first = F.first("codes", ignorenulls=True).alias("codes")
    distinct = cut(heard.groupBy("sha").agg(first, F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    links = cut(link_recordings(distinct.select("id", "least", "sha", "codes"), most_error, least_overlap, most))
    parts = connected_components(links.select("a", "b"))
    joined = distinct.select("id", "sha", "least").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("group_id"))
    named = links.join(distinct.select(F.col("id").alias("a"), F.col("least").alias("aligned_to")), "a")
    best = named.groupBy("b").agg(F.min(F.struct("error", "aligned_to", "offset")).alias("best"))
    known = joined.join(lowest, "component").join(best.withColumnRenamed("b", "id"), "id", "left").select("sha", "group_id", "best")
    out = prints.join(known, "sha", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_codes"),
        F.col("sha").alias("codes_sha256"),
        F.coalesce("group_id", "id").alias("group_id"),
        F.col("best.aligned_to").alias("aligned_to"),
        F.col("best.offset").alias("offset"),
        F.col("best.error").alias("bit_error"),
    )


def spoken(text: str | None, rate: int = 4000, note: int = 512) -> tuple[np.ndarray, int]:
    """A text as sound: each sentence is three dyads whose pitches come from its hash. The length in words puts silence in front.

    A stand-in for recordings where a table has none: equal sentences sound alike, wherever they stand.
    """
    sentences = [s for x in (text or "").split(".") if (s := " ".join(x.split()))]
    if not sentences:
        return np.zeros(0), rate
    tones = []
    for s in sentences:
        h = zlib.crc32(s.encode())
        for k in range(3):
            first, step = (h >> 10 * k) % 12, 1 + (h >> 10 * k + 4) % 11
            tones.append((first, (first + step) % 12))
    hertz = 220 * 2 ** (np.array(tones) / 12)
    turns = hertz[:, :, None] * (np.arange(note) / rate)
    sound = np.sin(((turns % 1) * (2 * np.pi)).astype(np.float32)).sum(1).ravel()
    return np.concatenate((np.zeros(len(sentences) % 5 * HOP, np.float32), sound)), rate
