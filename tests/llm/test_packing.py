from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing as P

ODD = ["a  b", " lead", "trail \n\n", "", "it's we'll", "x  \n y", "　z q", "a\xa0\n y", "q   w", "tab\t\tx  \r\n y", "<|endoftext|> a<|endoftext|>b", "日本 語 ça été", "\x1c a\x1fb", "é  f", "\x0b\x0c v", "12 345  ,,, !!", "  ", "a  b", "’ — x"]


TOKENIZER = Tokenizer.from_file(P.tokenizer_path())


def check(texts):
    ids = P.encoder(P.tokenizer_path())
    assert [ids(t).tolist() for t in texts] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer():
    check([*ODD, "word " * 5000, "x" * 3000, "".join(map(chr, range(0x3000)))])
    check([chr(c) + " " + chr(c) + chr(c) + "\n" + chr(c) + "a" for c in [*range(0x2100), *range(0x2FF0, 0x3010), 0xFEFF, 0x180E]])


def test_ids_of_very_long_runs():
    check([" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x " + " " * 1_100_000 + "y", "word, " * 900_000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab' \n\t\r\x0b\x1c 　 é日1.,<|>’")), max_size=14), max_size=5))
def test_ids_of_random_texts(texts):
    check(texts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_place_every_piece_once(histogram):
    placed = defaultdict(int)
    for pattern, count in P.shortest_pack_first(histogram, 64):
        assert count > 0 and sum(a * n for a, n in pattern) <= 64
        for a, n in pattern:
            placed[a] += n * count
    assert dict(placed) == histogram


def one_by_one(histogram, size):
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            low = min(packs, default=size)
            if low + length <= size:
                packs.remove(low)
                packs.append(low + length)
            else:
                packs.append(length)
    return len(packs)


def test_about_as_many_packs_as_one_by_one():
    r = random.Random(4)
    for _ in range(20):
        h = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(30)}
        got = sum(c for _, c in P.shortest_pack_first(h, 64))
        assert got <= 1.05 * one_by_one(h, 64) + 1


def test_pieces_and_sequences(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "γάμμα", "x1"]) for _ in range(r.randrange(0, 300)))) for i in range(120)] + [(None, "none"), (900, None), (901, ""), (5, "again"), (5, "again"), (902, "w " * 9000)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, length int, rank int").repartition(4)
    got = P.pack_documents(df, size=64).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for g in got:
        docs[g.doc_id].append(g)
        seqs[g.sequence_id].append(g)
    for s in seqs.values():
        at = 0
        for g in sorted(s, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= 64
    tok = TOKENIZER
    for i, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((g for g in docs[i]), key=lambda g: g.start)
        if i == 5:
            continue
        assert [g.start for g in mine] == list(range(0, len(ids), 64)) and all(g.doc_tokens == len(ids) for g in mine)
        assert all(g.ids_crc32 == zlib.crc32(ids[g.start : g.start + g.length].tobytes()) for g in mine)
        assert sum(g.length for g in mine) == len(ids)
    assert sum(g.length == g.doc_tokens for g in docs[5]) + sum(g.start == 0 for g in docs[5]) >= 3
    assert sum(g.length for g in got) > 0.9 * 64 * len(seqs)


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
