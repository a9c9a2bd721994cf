"""The trie of rebuilt conversations against one built by hand."""

import hashlib
import random
import zlib

import pytest

from claimweave.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, n long, parent int"


def sha(ids):
    return hashlib.sha256(",".join("" if i is None else str(i) for i in ids).encode()).hexdigest()


def smallest(ids):
    return min((i for i in ids if i is not None), default=None)


def expected(rows):
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    chats = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else c - (abs(c) % 100) * (1 if c >= 0 else -1)
        chats[c] = (own.get(base, [])[:h] if c is not None else []) + turns[h:]
    members = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, who in members.items():
        ends = sorted((c for c in who if len(chats[c]) == len(k)), key=lambda c: (c is None, c or 0))
        out.append((smallest(who), len(k), smallest(members[k[:-1]]) if k else None, len(who), len(kids.get(k, [])), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


def trie(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = P.prefix_trie(P.rebuilt(P.turns_of(table)), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def many(seed, n):
    """Conversations over few groups, copies of each other and of parts, some with very many turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), n):
        for t in range(rng.choice([1, 1, 2, 3, 6, 7, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é😀", None, ""])))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(8)]
    rows += [(c, t, "user", f"long {t}") for c in (5001, 5002, 5103) for t in range(300)]
    return rows


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, 1, "user", "a"), (None, None, None, None)],
        [(7, 0, "user", "a")],
        [(k, 0, "u", "same") for k in range(1, 9)],  # without their group's first conversation some have no turns
        [(100, None, "u", "x"), (100, 1, "u", "x"), (100, 1, "u", "x"), (101, 5, "u", "x"), (101, 6, "u", "z" * 100_000), (None, 0, "u", "x")],
    ],
)
def test_small(spark, rows):
    assert trie(spark, rows) == expected(rows)


@pytest.mark.parametrize("cells", [P.CELLS, 512, 64])
def test_many(spark, cells):
    """With a sketch of few cells most prefixes collide: the result stays."""
    rows = many(5, 200)
    assert trie(spark, rows, cells=cells) == expected(rows)


def test_sketch_never_counts_too_low(spark):
    rows = spark.createDataFrame([(bytes([k % 200, k % 256]),) for k in range(2_000)], "node binary")
    bits = P.sketch(rows, P.PAGE)
    cells = rows.select("node", *[c.alias(f"c{k}") for k, c in enumerate(P._cells("node", P.PAGE))]).collect()
    seen = {}
    for r in cells:
        seen[bytes(r.node)] = seen.get(bytes(r.node), 0) + 1
    alone = {bytes(r.node) for r in cells if any(bits[r[k] >> 3] >> (r[k] & 7) & 1 == 0 for k in (1, 2))}
    assert alone <= {n for n, k in seen.items() if k == 1}
    assert len(alone) >= 0.9 * sum(k == 1 for k in seen.values())


def test_ends_in_pieces(spark):
    ids = [k * 37 - 90_000 for k in range(9_000)] + [None]
    rows = spark.createDataFrame([(b"n", i) for i in ids] + [(b"m", 5)], "node binary, conv_id long").repartition(5)
    assert {bytes(r.node): r.ends_sha256 for r in P._ends(rows).collect()} == {b"n": sha(ids), b"m": sha([5])}


def test_without_rebuilding(spark):
    table = spark.createDataFrame([(c, t, "user", f"{t}") for c in (3, 4) for t in range(2)] + [(5, 0, "user", "0")], "conv_id long, turn long, role string, text string")
    got = P.prefix_trie(P.steps_of(P.turns_of(table))).orderBy("depth").collect()
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got] == [(3, 3, 1, 1, 3, sha([])), (3, 3, 1, 1, 3, sha([5])), (3, 2, 0, 1, 1, sha([3, 4]))]
