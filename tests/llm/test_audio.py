from __future__ import annotations

import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest

from quillon.llm import audio as A


def wav(x, rate=4000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.repeat((np.clip(x, -1, 1) * 20000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def text(r, n=12):
    return ". ".join(" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(5)) for _ in range(n)) + "."


def brute_chroma_box(image, t0, t1, y0, y1):
    return image[t0:t1, y0:y1].sum()


def test_integral_image_filters_against_plain_sums():
    x, rate = A.spoken(text(random.Random(1), 3))
    image = A.chroma(x, rate)
    image = image[image.any(1)]
    codes = A.codes_of(x, rate)
    for at in (0, 7, len(codes) - 1):
        code = 0
        for kind, y, h, w in A.FILTERS:
            box = lambda t0, t1, y0, y1: brute_chroma_box(image, at + t0, at + t1, y0, y1)
            whole = box(0, w, y, y + h)
            a, b = {
                0: lambda: (whole, w * h / 12),
                1: lambda: (box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)),
                2: lambda: (box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)),
                3: lambda: (box(0, w // 2, y, y + h // 2) + box(w // 2, w, y + h // 2, y + h), box(0, w // 2, y + h // 2, y + h) + box(w // 2, w, y, y + h // 2)),
                4: lambda: (2 * box(0, w, y + h // 3, y + 2 * (h // 3)), whole - box(0, w, y + h // 3, y + 2 * (h // 3))),
                5: lambda: (2 * box(w // 3, w - w // 3, y, y + h), whole - box(w // 3, w - w // 3, y, y + h)),
            }[kind]()
            level = sum(np.log((0.1 + a) / (0.1 + b)) >= t for t in A.LEVELS)
            code = code << 2 | (level ^ (level >> 1))
        assert code == codes[at]


def test_offset_and_bit_errors_against_all_offsets():
    r = np.random.default_rng(3)
    a = r.integers(1 << 32, size=80, dtype=np.uint32)
    b = np.concatenate((r.integers(1 << 32, size=9, dtype=np.uint32), a[20:]))
    b[15] ^= 7
    votes = {d: sum(a[i] == b[i - d] for i in range(80) if 0 <= i - d < len(b)) for d in range(-len(b), 81)}
    offset, overlap, error = A.align(a, b)
    assert offset == max(votes, key=votes.get) == 11
    x, y = a[11:], b[: len(a) - 11]
    assert overlap == len(x) and np.isclose(error, sum(int(p ^ q).bit_count() for p, q in zip(x, y)) / 32 / len(x))
    assert A.align(a, r.integers(1 << 32, size=5, dtype=np.uint32))[1] == 0


def test_noise_shift_loudness_and_rate_of_channels(spark):
    r, g = random.Random(2), np.random.default_rng(2)
    base = [text(r) for _ in range(8)]
    rows = [(i, wav(A.spoken(t)[0] * 0.4)) for i, t in enumerate(base)]
    s = A.spoken(base[0])[0] * 0.4
    rows += [(20, wav(s * 0.5)), (21, wav(np.concatenate((np.zeros(1280), s)))), (22, wav(s + g.normal(size=len(s)) * 0.002)), (23, wav(s[6144:])), (24, wav(s, channels=2))]
    rows += [(30, None), (31, b"no wav"), (32, wav(np.zeros(9000))), (33, wav(s[:100])), (None, rows[1][1]), (1, rows[1][1]), (34, rows[2][1][:3001])]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, 1) for i, m in rows], "rec_id long, media binary, id int").repartition(3)
    out = A.align_recordings(df).collect()
    assert len(out) == len(rows)
    group = {x.rec_id: x.group_id for x in out}
    assert {group[i] for i in (0, 20, 21, 22, 23, 24)} == {0} and group[None] == 1
    assert [group[i] for i in range(1, 8)] == list(range(1, 8))
    assert all(x.n_codes == 0 and x.aligned_to is None for x in out if x.rec_id in (30, 31, 32, 33))
    assert [(x.n_codes) for x in out if x.rec_id == 34][0] > 0
    cut_ = [x for x in out if x.rec_id == 23][0]
    assert cut_.aligned_to is None or cut_.bit_error < 0.2
    for x in out:
        codes = A.codes_of(*A.from_wav(dict(rows)[x.rec_id])).view(np.int32)
        hex_ = ",".join(f"{int(c) & 0xFFFFFFFF:X}" if c >= 0 else f"{int(c) & (2**64 - 1):X}" for c in codes)
        assert x.n_codes == len(codes) and (not len(codes) or x.codes_sha256 == hashlib.sha256(hex_.encode()).hexdigest())


def test_spoken_texts_against_brute_force(spark):
    r = random.Random(8)
    texts = [text(r, r.randrange(1, 9)) for _ in range(40)]
    for i in range(25):
        s = texts[r.randrange(40)].split(".")
        if len(s) > 5 and i % 2:
            s[r.randrange(len(s) - 1)] = " changed"
        texts.append(".".join(s))
    texts += [None, "", " . . "]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, media string").repartition(4)
    got = {x.rec_id: x.group_id for x in A.align_recordings(df, decode=A.spoken).collect()}
    codes = [A.codes_of(*A.spoken(t)) for t in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(codes):
        for j, b in enumerate(codes[:i]):
            if set(A.run_keys(a).tolist()) & set(A.run_keys(b).tolist()):
                _, overlap, error = A.align(b, a)
                if overlap >= 0.5 * min(len(a), len(b)) and error <= 0.2:
                    low, high = sorted((part[i], part[j]))
                    part = [low if p == high else p for p in part]
    assert got == dict(enumerate(part))


def groups(spark, recs, most):
    """The group of each recording of codes, by links, in lists of up to `most` and in longer ones."""
    rows = [(i, i, f"{zlib.crc32(bytes([i % 256, i >> 8])):08x}", c.view(np.int32).tolist()) for i, c in enumerate(recs)]
    df = spark.createDataFrame(rows, "id long, least long, sha string, codes array<int>").repartition(3)
    part = list(range(len(recs)))
    for x in A.link_recordings(df, 0.2, 0.5, most).collect():
        assert x.a < x.b and (x.offset, x.error) == A.align(recs[x.a], recs[x.b])[::2]
        low, high = sorted((part[x.a], part[x.b]))
        part = [low if p == high else p for p in part]
    return part


@pytest.mark.parametrize("most", [512, 8])
def test_groups_that_only_a_later_recording_joins(spark, most):
    """A and B share the passage k but don't match; C = k matches both. And chains in lists of many leaders, against all pairs."""
    g = np.random.default_rng(4)
    new = lambda n: g.integers(1 << 32, size=n, dtype=np.uint32)
    k = new(30)
    a, b, c = np.append(new(30), k), np.append(new(30), k), k
    assert A.align(a, b)[2] > 0.2 and A.align(a, c)[2] == A.align(b, c)[2] == 0
    assert groups(spark, [a, b, c], 2 if most == 8 else most) == [0, 0, 0]
    passage, recs = new(40), []
    for _ in range(12):
        one = np.concatenate([new(60), passage, new(60)])
        recs.append(one)
        for _ in range(int(g.integers(5))):  # each take is a little further from the first one
            one = one.copy()
            spoilt = g.permutation(np.r_[0:60, 100:160])[:40]
            one[spoilt] = new(40)
            recs.append(one)
    recs = [recs[i] for i in g.permutation(len(recs))]
    want = list(range(len(recs)))
    for j, y in enumerate(recs):
        for i, x in enumerate(recs[:j]):
            _, overlap, error = A.align(x, y)
            if overlap >= 0.5 * min(len(x), len(y)) and error <= 0.2:
                low, high = sorted((want[i], want[j]))
                want = [low if p == high else p for p in want]
    assert len(set(want)) == 12
    assert groups(spark, recs, most) == want


def test_empty(spark):
    assert A.align_recordings(spark.createDataFrame([], "rec_id long, media binary")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1407, 1408, 1500])
def test_short_sounds(n):
    frames = (n - A.FRAME) // A.HOP + 1 if n >= A.FRAME else 0
    assert len(A.codes_of(np.sin(np.arange(n)), 4000)) == max(0, frames - A.WIDTH + 1)


@pytest.mark.parametrize("most", [512, 8])
def test_links_without_a_common_run(spark, most):
    """Takes with a bit wrong in most integers, and short clips from the middle, share no long run; all pairs are held against `align`."""
    g = np.random.default_rng(6)
    recs = []
    for n in (3, 9, 40, 90, 90, 200):
        one = g.integers(1 << 32, size=n, dtype=np.uint32)
        recs.append(one)
        for _ in range(3):
            spoilt = one ^ (np.uint32(1) << g.integers(32, size=n).astype(np.uint32))
            kept = g.choice(n, max(1, n // 12), replace=False)
            spoilt[kept] = one[kept]
            recs.append(spoilt)
        recs += [one[n // 3 : n // 3 + 7], np.append(g.integers(1 << 32, size=n, dtype=np.uint32), one[: n // 2])]
    recs += [np.array([7, 7, 7, 8] * 30, np.uint32), np.array([8, 7, 7] * 20, np.uint32)]
    recs = [recs[i] for i in g.permutation(len(recs))]
    want = list(range(len(recs)))
    for j, y in enumerate(recs):
        for i, x in enumerate(recs[:j]):
            _, overlap, error = A.align(x, y)
            if overlap >= 0.5 * min(len(x), len(y)) and error <= 0.2:
                low, high = sorted((want[i], want[j]))
                want = [low if p == high else p for p in want]
    assert len(set(want)) < 12
    assert groups(spark, recs, most) == want
    for limit in (1, 300):  # votes that are counted at once
        links = A.forest(recs, None, 0.2, 0.5, limit)
        part = list(range(len(recs)))
        for a, b, offset, error in links:
            assert (offset, error) == A.align(recs[a], recs[b])[::2]
            low, high = sorted((part[a], part[b]))
            part = [low if p == high else p for p in part]
        assert part == want and len(links) == len(recs) - len(set(want))


def test_votes_of_joined_recordings_are_not_counted(monkeypatch):
    """All share an integer; what is joined, by a match or by `root`, costs no votes, and strangers are still held against everything."""
    g = np.random.default_rng(8)
    recs = [np.array([7, 5, 1 << 20 | x], np.uint32) for x in range(2000)]
    strange = [np.append(g.integers(1 << 32, size=9, dtype=np.uint32), np.uint32(7)) for _ in range(3)]
    counted, spread = [], A.spread
    monkeypatch.setattr(A, "spread", lambda starts, size: counted.append(int(size.sum())) or spread(starts, size))
    assert len(A.forest(recs[:1000] + strange + recs[1000:], None, 0.2, 0.5, 1 << 12)) == 1999
    assert sum(counted) < 400_000  # all pairs have 4,000,000
    counted.clear()
    root = np.append(np.zeros(2000, int), [1, 2, 3])
    assert A.forest(recs, [*strange, *recs], 0.2, 0.5, 1 << 12, np.append(root, np.zeros(2000, int))) == []
    assert sum(counted) < 50_000
    assert len(A.forest(strange, recs, 0.2, 0.5, 1 << 12, np.append([1, 2, 3], np.zeros(2000, int)))) == 0
    assert len(A.forest(recs[:1], recs[1:], 0.2, 0.5, 1 << 12, np.append(1, np.zeros(1999, int)))) == 1
