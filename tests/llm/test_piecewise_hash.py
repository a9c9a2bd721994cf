"""Fingerprints against a byte-by-byte version, likeness against a plain edit distance."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from claimweave.llm import piecewise_hash as P


def slow_hash(data, i):
    h = 0
    for j in range(i - P.WINDOW + 1, i + 1):
        h = (h * 0x01000193 + (data[j] if j >= 0 else 0)) % 2**32
    h ^= h >> 15
    h = h * 0x85EBCA6B % 2**32
    return h ^ h >> 13


def slow_print(data):
    hashes = [slow_hash(data, i) for i in range(len(data))]
    ends = lambda k: [i + 1 for i, h in enumerate(hashes) if h % 2**k == 2**k - 1]
    k = next(k for k in range(40) if len(ends(k)) < P.PIECES)

    def letters(cuts):
        cuts = sorted({0, *cuts, len(data)})
        return "".join(P.LETTERS[zlib.crc32(data[a:b]) % 64] for a, b in zip(cuts, cuts[1:], strict=False))

    return f"{2**k}:{letters(ends(k))}:{letters(ends(k + 1))}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    (p, *x), (q, *y) = a.split(":"), b.split(":")
    p, q = int(p), int(q)
    pairs = [(x[0], y[0]), (x[1], y[1])] if p == q else [(x[1], y[0])] if 2 * p == q else [(x[0], y[1])] if p == 2 * q else []

    def near(s, t):
        n = min(P.RUN, len(s), len(t))
        if not n or not {s[i : i + n] for i in range(len(s) - n + 1)} & {t[i : i + n] for i in range(len(t) - n + 1)}:
            return 0.0
        return 1 - distance(s, t) / max(len(s), len(t))

    return max([near(s, t) for s, t in pairs], default=0.0)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop é日😀", k=rng.randint(1, 9))) for _ in range(n))


def samples():
    rng = random.Random(2)
    texts = ["", "a", "ok", "aaaa" * 500, "\0" * 300, words(rng, 3), words(rng, 20), words(rng, 300), words(rng, 3000), ("the same line\n" * 400)]
    return [t.encode() for t in texts]


def test_byte_by_byte():
    assert [P.fingerprint(d) for d in samples()] == [slow_print(d) for d in samples()]


def test_slices(monkeypatch):
    whole = [P.fingerprint(d) for d in samples()]
    monkeypatch.setattr(P, "SLICE", 97)
    assert [P.fingerprint(d) for d in samples()] == whole
    assert all(len(p.split(":")[1]) <= P.PIECES for p in whole)


def test_least_block_behind_the_guess():
    """Texts whose ends are far fewer than their length suggests still take the least block size."""
    quiet = next(b for b in range(256) if slow_hash(bytes([b] * 7), 6) % 2 == 0)
    data = bytes([quiet]) * 3_000 + b"tail"
    assert P.fingerprint(data) == slow_print(data)


def expected(rows):
    tie = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]), r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = (t[: len(t) - cut] + after[:cut]).encode()
        own, other = slow_print(t.encode()), slow_print(edited)
        out.append((d, len(t), hashlib.sha256(edited).hexdigest(), own, other, slow_likeness(own, other), slow_likeness(own, slow_print(after.encode()))))
    return out


def pairs():
    rng = random.Random(8)
    base = words(rng, 400)
    rows = [(k * 3, words(rng, rng.choice([0, 1, 2, 5, 40, 200]))) for k in range(40)]
    rows += [(200, base), (201, base), (202, base + " more"), (203, words(rng, 3) + base), (None, "no id"), (None, None), (7, "seven"), (7, "7"), (7, "7"), (500, words(rng, 4000)), (501, None), (502, "   ")]
    return rows


@pytest.mark.parametrize("rows", [[], [(1, "alone and whole")], [(1, None)], [(2, "a" * 40), (1, "b" * 9)], pairs()])
def test_neighbours(spark, make, rows):
    got = P.compare_neighbours(make(rows).repartition(5))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    show = lambda r: (str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9))
    assert sorted(map(show, got.collect())) == sorted(map(show, expected(rows)))


def test_sample(spark, sample):
    """Edited texts are near, others hardly ever; equal texts have equal fingerprints."""
    got = P.compare_neighbours(sample).toPandas()
    assert len(got) == sample.count()
    long_ = got[got.n_chars > 400]
    assert (long_.near_edited >= 0.5).mean() > 0.95 and long_.near_edited.mean() > 0.7
    assert (long_.near_next == 0).mean() > 0.9
    each = P.fingerprints(sample).toPandas().set_index("doc_id").fingerprint
    assert (got.set_index("doc_id").fingerprint == each).all()


def test_long_text(spark, make):
    rng = random.Random(1)
    text = words(rng, 300_000)
    got = {r.doc_id: r for r in P.compare_neighbours(make([(1, text), (2, text[: len(text) // 2] + "x" + text[len(text) // 2 :])])).collect()}
    assert got[1].near_next > 0.9 and got[1].n_chars == len(text)
