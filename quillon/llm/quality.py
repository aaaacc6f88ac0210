"""Line-level quality with a linear-chain conditional random field.

Every line of a document is labelled good or bad. A line's evidence is a vector of
features of its own and of its two neighbours; a 2 x 2 transition matrix ties each
line to the next. Forward-backward gives the marginal probability that a line is
good, and a document's score is the mean of these, weighted by the lines' lengths.

Training: labels are for documents, so each line of a labelled document carries its
document's label (weak supervision). The CRF is fitted on the driver to a bounded,
documented sample of labelled rows: `max_docs` documents of each class, in an order
given by a hash, and of each `max_lines` lines in a row at most, from a place given by a hash. Scoring is one narrow map
over the whole texts: no shuffle, and the model that goes along is a few hundred
numbers.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import IS_SPACE, crc_mod5, pieces, spare, text_bytes, words

#: Classes of bytes whose share of a line is a feature.
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "mark": b"#$%&*@^~=+<>\\_`",
    "bar": b"|",
    "bang": b"!?",
    "stop": b".,;:",
    "bracket": b"()[]{}\"'/-",
    "other": range(128, 256),
}
NAMES = ("bias", *CLASSES, "word_length", "long_words", "repeats_previous", "repeats_second", "distinct", "lonely", "log_words", "ends_with_stop", "repeated_line")
N = len(NAMES)


CLASS_OF = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    CLASS_OF[list(_bytes)] = _i + 1
LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word's first and last eight bytes and its length."""
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    at = np.ndarray((len(data) + 1,), "<u8", raw.data, 0, (1,))  # the eight bytes from any byte on
    size = ends - starts
    mask = LOW[np.minimum(size, 8)]
    a, b = at[starts] & mask, at[np.maximum(ends - 8, starts)] & mask
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N) of every line that holds a word, the lines' lengths in bytes, and each text's first line (n + 1)."""
    data, off = text_bytes(col)
    new = data == 10
    begins = np.zeros(len(data), bool)
    begins[1:] = new[:-1]
    edges = off[:-1]
    begins[edges[edges < len(data)]] = True
    at = np.flatnonzero(begins)
    starts, ends, _ = words(data, off)
    n_words = np.diff(np.searchsorted(starts, np.append(at, len(data))))
    at, n_words = at[n_words > 0], n_words[n_words > 0]
    first = np.searchsorted(at, off)
    x = np.zeros((len(at), N))
    if not len(at):
        return x, np.zeros(0), first
    # a line goes on to the next kept line; what lies between is white space only
    w0 = np.searchsorted(starts, at)
    span = np.diff(np.append(at, len(data)))
    n = np.bincount(np.repeat(np.arange(len(at)) * 16, span) + CLASS_OF[data[at[0] :]], minlength=16 * len(at)).reshape(-1, 16)
    length = ends - starts
    size = np.add.reduceat(length, w0).astype(float)
    x[:, 0] = 1
    x[:, 1 : 1 + len(CLASSES)] = n[:, 1 : 1 + len(CLASSES)] / size[:, None]
    k = 1 + len(CLASSES)
    x[:, k] = np.minimum(size / n_words, 30) / 10
    x[:, k + 1] = np.add.reduceat(length > 20, w0, dtype=np.int64) / n_words
    h = _word_hashes(data, starts, ends)
    line = np.repeat(np.arange(len(at)), n_words)
    for j, back in ((k + 2, 1), (k + 3, 2)):
        same = np.zeros(len(h), np.int64)
        same[back:] = (h[back:] == h[:-back]) & (line[back:] == line[:-back])
        x[:, j] = np.add.reduceat(same, w0) / n_words
    key = np.sort((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    x[:, k + 4] = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(at)) / n_words * np.minimum(n_words, 40) / 40
    x[:, k + 5] = n_words == 1
    x[:, k + 6] = np.log1p(n_words) / 5
    last = data[ends[w0 + n_words - 1] - 1]
    x[:, k + 7] = (last == 46) | (last == 33) | (last == 63)
    whole = np.add.reduceat(h * (np.arange(len(h)).astype(np.uint64) - np.repeat(w0, n_words).astype(np.uint64) + np.uint64(3)) ** np.uint64(3), w0)
    doc = np.repeat(np.arange(len(col)), np.diff(first))
    order = np.lexsort((whole, doc))
    again = np.zeros(len(at), bool)
    same = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again[order[1:]] |= same
    again[order[:-1]] |= same
    x[:, k + 8] = again
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it, zero beyond the text's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads, some = first[:-1], np.diff(first) > 0
    before[heads[some]] = 0
    after[first[1:][some] - 1] = 0
    return np.hstack((x, before, after))


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected transitions (2 x 2), and the sum of log partition functions.

    score: log-potential of good against bad for each line. All chains go forward one
    line at a time, longest first, so a step is one array operation over the chains
    that are long enough.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, head = size[order], first[:-1][order]
    most = int(size[0]) if len(size) else 0
    left = np.array([int(np.searchsorted(-size, -t, "left")) for t in range(most + 1)])  # chains with over t lines
    e = np.stack((np.zeros_like(score), score), 1)
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    for t in range(most):
        at = head[: left[t]] + t
        if t:
            a = fwd[at - 1][:, :, None] + trans
            fwd[at] = np.logaddexp(a[:, 0], a[:, 1]) + e[at]
        else:
            fwd[at] = e[at]
    for t in range(most - 2, -1, -1):
        at = head[: left[t + 1]] + t
        b = trans + (bwd[at + 1] + e[at + 1])[:, None, :]
        bwd[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    both = fwd + bwd
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(len(score), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    t = np.flatnonzero(inner)
    pair = np.exp(fwd[t - 1][:, :, None] + trans + (bwd[t] + e[t])[:, None, :] - z[t][:, None, None])
    ends = first[1:][np.diff(first) > 0] - 1
    return good, pair.sum(0), float(np.logaddexp(fwd[ends, 0], fwd[ends, 1]).sum())


@dataclass
class LineCRF:
    weights: np.ndarray  # over with_neighbours' features: evidence for good
    trans: np.ndarray  # 2 x 2
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, col: pa.Array) -> np.ndarray:
        """One score from 0 to 1 for each text; 0 for a text without words."""
        x, size, first = line_features(col)
        out = np.zeros(len(col))
        if len(x):
            z = with_neighbours((x - self.mean) / self.scale, first) @ self.weights
            good, _, _ = marginals(z, self.trans, first)
            total = np.concatenate(([0], np.cumsum(size * good)))
            weight = np.concatenate(([0], np.cumsum(size)))
            some = np.diff(first) > 0
            out[some] = ((total[first[1:]] - total[first[:-1]]) / np.maximum(weight[first[1:]] - weight[first[:-1]], 1))[some]
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 2.0) -> LineCRF:
    """Penalised maximum likelihood by Adam. label: 0 or 1 for each text; documents weigh alike by class."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    f = with_neighbours((x - mean) / scale, first)
    y = np.repeat(label, np.diff(first)).astype(float)
    chained = np.ones(len(y), bool)
    chained[first[:-1][np.diff(first) > 0]] = False
    t = np.flatnonzero(chained)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[t - 1].astype(int), y[t].astype(int)), 1)
    theta = np.zeros(f.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, steps + 1):
        good, pairs, _ = marginals(f @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.append(f.T @ (y - good), (seen - pairs).ravel()) - decay * theta
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return LineCRF(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", where: Column | None = None, max_docs: int = 1500, max_lines: int = 200) -> LineCRF:
    """Fits a CRF to the labelled rows that satisfy `where` (a column of `labels`).

    The sample: the `max_docs` labelled ids of each class with the least hash. Null ids
    and labels other than 0 and 1 are left out; an id that is labelled twice counts once, by
    its lowest label, and one that several rows have by the text of the least hash. Of a longer document
    `max_lines` lines in a row are taken; those without words teach nothing. So at most 2 * max_docs * max_lines * N numbers come to the driver.
    Without both classes the model scores by its prior.
    """
    y = F.col(label_col).cast("int")
    rows = labels if where is None else labels.where(where)
    rows = rows.where(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(y).alias("y"))
    part = [rows.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(max_docs) for v in (0, 1)]
    sample = F.broadcast(part[0].union(part[1]))  # at most 2 * max_docs rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(sample, "id")
    texts = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("one"))
    texts = texts.select(F.col("id").cast("string").alias("id"), "y", F.col("one.t").alias("t"))

    def run(batches):
        for b in pieces(batches, "t"):
            x, _, first = line_features(b.column("t"))
            taken = []
            for i, key in enumerate(b.column("id").to_pylist()):
                lo, n = int(first[i]), int(first[i + 1] - first[i])
                lo += zlib.crc32(key.encode()) % max(1, n - max_lines + 1)
                taken.append(x[lo : lo + min(n, max_lines)].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(taken, pa.binary())], ["id", "y", "x"])

    got = texts.mapInArrow(run, "id string, y int, x binary").where("length(x) > 0").collect()
    got.sort(key=lambda r: r.id)
    if len({r.y for r in got}) < 2:
        prior = float(np.mean([r.y for r in got])) if got else 0.5
        weights = np.zeros(3 * N)
        weights[0] = np.log((prior + 0.01) / (1.01 - prior))
        return LineCRF(weights, np.zeros((2, 2)), np.zeros(N), np.ones(N))
    parts = [np.frombuffer(r.x, "<f4").astype(float).reshape(-1, N) for r in got]
    return fit(np.vstack(parts), np.cumsum([0, *map(len, parts)]), np.array([r.y for r in got]))


def score(docs: DataFrame, model: LineCRF, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with `score_col`. Null and empty texts, and those of white space only, score 0; every row stays."""
    (text,) = spare(docs, "text_of_row")

    def run(batches):
        for b in pieces(batches, text):
            row = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array(model.scores(b.column(text)))], [*row.schema.names, score_col])

    wide = docs.withColumn(text, F.col(text_col).cast("string"))
    return wide.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **more) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Learns from labels whose crc32(doc_id) modulo 5 is not 0; the others are held out.
    A null id counts as not held out. Repeated rows score alike. Null and empty texts and those of white space only have no
    lines to judge and score 0, which is not learned. Texts of any length are scored whole.
    """
    model = train(docs, labels, where=crc_mod5(F.col("doc_id")) != 0, **more)
    slim = docs.select("doc_id", "text")
    text = spare(slim, "t")[0]

    def run(batches):
        for b in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column(text)))], ["doc_id", "score"])

    scored = slim.select("doc_id", F.col("text").cast("string").alias(text)).mapInArrow(run, slim.select("doc_id").schema.add("score", "double"))
    held = F.coalesce(crc_mod5(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
