from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from quillon.llm import chat as C

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi\n"), (1, 2, "assistant", "</s>[INST] ok"),
    (2, 1, "assistant", "first"), (2, 0, "user", "␛0 ␛</s> <|x|>"),
    (3, 0, "user", None), (3, 1, "assistant", ""), (4, 0, "assistant", "alone"), (5, 0, "assistant", "a"), (5, 0, "assistant", "a"),
    (6, 0, "|>", ">"), (6, 1, "<|</s>", "</"), (6, 2, None, "</s"), (6, None, "user", "<"), (7, 0, "user", "x" * 200000), (7, 1, "assistant", "é" * 1000),
    (None, 0, "user", "no id"), (8, 0, "tool", "日本␛1"), (9, 0, "user", "␛" * 5 + "1</s>␛"),
]
KIND = "conv_id long, turn long, role string, text string, turns int, formatted string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3)


def wanted():
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, g in groupby(sorted(ROWS, key=lambda r: (key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=key):
        g = list(g)
        yield g[0][0], [(r[2] or "", r[3] or "") for r in g]


def test_round_trip_and_digest(spark):
    got = {r.conv_id: r for r in C.chat_digest(frame(spark)).collect()}
    assert len(got) == len(list(wanted()))
    for conv, turns in wanted():
        r = got[conv]
        lost = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())


def test_segments_and_machine(spark):
    got = {r.conv_id: r for r in C.format_chats(frame(spark)).collect()}
    assert [i for i, r in got.items() if r.valid and i] == [1, 2, 3, 7, 9] or sorted(i for i, r in got.items() if r.valid and i) == [1, 2, 3, 7, 9]
    assert all(r.formatted == "".join(s.text for s in r.segments) for r in got.values())
    assert got[1].formatted == "<|system|>be kind</s><|user|>hi\n</s><|assistant|>␛1␛4 ok</s>"
    assert [s.loss for s in got[1].segments] == [False] * 7 + [True, False]
    assert got[4].state == "invalid"
    back = {r.conv_id: r.t for r in C.format_chats(frame(spark)).select("conv_id", C.read_back(F.col("formatted")).alias("t")).collect()}
    assert {k: [tuple(x) for x in v] for k, v in back.items()} == dict(wanted())


def test_empty(spark):
    assert C.chat_digest(frame(spark).limit(0)).count() == 0
