"""Packing documents into sequences by shortest-pack-first over the length histogram.

Documents become token ids and are cut into pieces of `size` ids and a rest. Only the
histogram of piece lengths (at most `size` numbers) goes to the driver. There lengths
are placed from the longest: each goes to the shortest pack that exists, if it fits, else to
a new one, for all packs of one pattern at once, which keeps a count for each pattern
(after Krell et al., "Efficient Sequence Packing without Cross-contamination", 2021). Patterns become
ranges of ranks for each length, a table that is bounded by `size` and not by the
corpus. Pieces get a rank among those of their length and join their range.

`pack_ordered` keeps an order of documents: spans of consecutive documents are packed in the same way, each in
its task, and sequences are numbered span by span, so that a prefix of the sequences is a prefix of the documents but for one span.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from quillon.llm.common import cut, numbered, pieces, ranked, spare

#: How byte-level BPE vocabularies of this family split a text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters from which on a text goes to `tokenizers` itself.
LONG_TEXT = 1 << 22
#: Texts on which an encoder proves that it agrees with `tokenizers` before it is used.
PROBES = ("", " a  b\n\n c's", "\u00e9t\u00e9\u00a0\n\u3000x \t", "12 345,, <!>", "\u65e5\u672c \x1c\x85.", "x" * 300)


@lru_cache(2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text, those of the byte-level BPE file `path` of `tokenizers` without added special tokens.

    A string of the vocabulary's special tokens in a text stands for that token. The vocabulary
    is read into `tiktoken`, which merges the same ranks several times faster; it is held
    against `tokenizers` on `PROBES` and on the special tokens. Its splitter gives up on runs of
    about a million characters: such texts go to `tokenizers` itself, as do texts of over LONG_TEXT characters.
    """
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    letters = sorted(pre_tokenizers.ByteLevel.alphabet(), key=ord)
    # a byte that prints stands for itself, the others for U+0100 and on, in order
    shown = [b for b in range(256) if chr(b) in letters]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("from file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            try:
                return fast.encode_to_numpy(text, allowed_special=names, disallowed_special=())
            except ValueError:  # the splitter's stack
                pass
        return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

    for probe in (*PROBES, *[f"a {s}{s} b" for s in special]):
        if ids(probe).tolist() != plain.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary with merges in the order of ids")
    return ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and `end`, cut at multiples of `size`."""

    def run(batches):
        ids_of, last = encoder(path), np.uint32(end)
        for b in pieces(batches, "t"):
            doc, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column("t").to_pylist()):
                raw = np.append(ids_of(text or ""), last).astype("<u4").tobytes()
                n = len(raw) // 4
                for at in range(0, n, size):
                    doc.append(i)
                    start.append(at)
                    length.append(min(size, n - at))
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = rows.select(F.col("id").alias("doc_id")).schema
    for c in ("start", "length", "ids_crc32", "doc_tokens"):
        kind = kind.add(c, "long")
    return rows.mapInArrow(run, kind)


Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Patterns and how many packs follow each. histogram: pieces by length."""
    packs: dict[int, list[tuple[Pattern, int]]] = {}  # by what is filled
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size or left < 0:
            raise ValueError("lengths lie between 1 and the sequence's size")
        while left:
            low = min(packs, default=size + 1)
            if low + length <= size:
                pattern, count = packs[low].pop()
                if not packs[low]:
                    del packs[low]
                # packs of one pattern fill together, each as far as the next shortest pack or the end
                limit = min(min(packs, default=size), size)
                fit = max(1, min((limit - low + length - 1) // length, (size - low) // length))
                used = min(count, left // fit)
                if used:
                    packs.setdefault(low + fit * length, []).append((_with(pattern, length, fit), used))
                    left -= used * fit
                if used < count:
                    some = min(left, fit)
                    if some:
                        packs.setdefault(low + some * length, []).append((_with(pattern, length, some), 1))
                        left -= some
                    if rest := count - used - bool(some):
                        packs.setdefault(low, []).append((pattern, rest))
            else:
                fit = size // length
                if new := left // fit:
                    packs.setdefault(fit * length, []).append((((length, fit),), new))
                if left % fit:
                    packs.setdefault(left % fit * length, []).append((((length, left % fit),), 1))
                left = 0
    return [x for fill in sorted(packs) for x in packs[fill]]


def _with(pattern: Pattern, length: int, n: int) -> Pattern:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + n))
    return (*pattern, (length, n))


def pack(parts: DataFrame, size: int = 1024) -> DataFrame:
    """`parts` (doc_id, start, length, ...) with sequence_id and offset: pieces of a sequence lie side by side from 0."""
    parts = cut(parts)
    histogram = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `size` rows
    ranges, used, first = [], dict.fromkeys(histogram, 0), 0
    for pattern, count in shortest_pack_first(histogram, size):
        at = 0
        for length, n in pattern:
            lo = used[length]
            used[length] += n * count
            ranges.append((length, lo, used[length], n, first, at))
            at += length * n
        first += count
    spark = parts.sparkSession
    key, rank, of, lo, hi, n, first, at = spare(parts, "key", "rank", "of", "lo", "hi", "n", "first", "at")
    # some patterns for each length, however many pieces there are
    table = F.broadcast(spark.createDataFrame(ranges, T.StructType([T.StructField(c, T.LongType()) for c in (of, lo, hi, n, first, at)])))
    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "start", "ids_crc32").cast("binary"))
    rows = ranked(parts.withColumn(key, hashed), ["length"], [key, "doc_id", "start", "ids_crc32"], rank)
    rows = rows.join(table, (F.col("length") == F.col(of)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    place = F.col(rank) - F.col(lo)
    sequence = F.col(first) + ((place - place % F.col(n)) / F.col(n)).cast("long")
    return rows.select(*parts.columns, sequence.alias("sequence_id"), (F.col(at) + place % F.col(n) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own; a null
    id is kept. No rows give no pieces. Texts of any length are encoded whole. Sequences are padded to `size` by whoever reads them, except at a power of two.
    """
    return pack(cut_pieces(docs, path or tokenizer_path(), size, id_col, text_col), size)


def _pack_span(size: int):
    """Adds sequence (from 0, by the first document in it) and offset to the pieces of a span."""

    def run(table: pa.Table) -> pa.Table:
        length, at, start = (np.asarray(table.column(c).combine_chunks()) for c in ("length", "at", "start"))
        order = np.lexsort((start, at, length))
        lengths, begins, many = np.unique(length[order], return_index=True, return_counts=True)
        left = dict(zip(lengths.tolist(), begins.tolist()))
        sequence, offset, first = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), 0
        for pattern, count in shortest_pack_first(dict(zip(lengths.tolist(), many.tolist())), size):
            filled = 0
            for n_ids, n in pattern:
                own = order[left[n_ids] : left[n_ids] + n * count]
                left[n_ids] += n * count
                k = np.arange(n * count)
                sequence[own], offset[own] = first + k // n, filled + k % n * n_ids
                filled += n_ids * n
            first += count
        lead = np.full(first, np.iinfo(np.int64).max)
        np.minimum.at(lead, sequence, at)
        place = np.empty(first, np.int64)
        place[np.argsort(lead, kind="stable")] = np.arange(first)
        return table.append_column("sequence", pa.array(place[sequence])).append_column("offset", pa.array(offset))

    return run


def pack_ordered(parts: DataFrame, size: int = 1024, span_docs: int = 1024) -> DataFrame:
    """`parts` (at, start, length, ...) with sequence_id and offset, without `at`: documents `at` in spans, one after the other."""
    rows = parts.withColumn("span", F.floor(F.col("at") / span_docs).cast("long"))
    kind = T.StructType([*rows.schema.fields])
    for c in ("sequence", "offset"):
        kind = kind.add(c, "long")
    packed = cut(rows.groupBy("span").applyInArrow(_pack_span(size), kind))
    sizes = packed.groupBy("span").agg((F.max("sequence") + 1).alias("size"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row for each span
    first = sizes.select("span", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    names = [c for c in parts.columns if c != "at"]
    return packed.join(first, "span").select(*names, (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")


def pack_documents_ordered(docs: DataFrame, path: str | None = None, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", span_docs: int = 1024) -> DataFrame:
    """As `pack_documents`, with sequences in the order of the rows of `docs`."""
    rows = numbered(docs, "at__")
    rows = rows.select(F.struct(F.col(id_col).alias("id"), F.col("at__").alias("at")).alias("id"), F.col(text_col).alias("text"))
    parts = cut_pieces(rows, path or tokenizer_path(), size, "id", "text")
    return pack_ordered(parts.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.at").alias("at"), *parts.columns[1:]), size, span_docs)
