"""The manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from claimweave.llm import merkle as M
from claimweave.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, idx int, tree int, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, the siblings of each node on its way, with whether they stand on the left)"""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            other = at[k] ^ 1
            path.append((at[k] % 2 == 1, level[other] if other < len(level) else ""))
            at[k] //= 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {n: sorted(trees[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    subs = {n: climb([leaf(r) for r in own[n]]) for n in names}
    if not names:
        return []
    root, above = climb([subs[n][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for k, r in enumerate(own[n]):
            path = subs[n][1][k] + above[i]
            shown = r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                shown = (*r[:3], r[3] + 1, r[4])
            x = leaf(shown)
            for left, other in path:
                x = h(other, x) if left else h(x, other)
            out.append((str(r[0]), leaf(r), subs[n][0], root, h(*(o for _, o in path)), x, x == root))
    return sorted(out)


def result(spark, rows, tmp_path, name="documents"):
    table = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 1, 2, "p") for r in rows], SCHEMA)
    table.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = Q.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "s", "en", 3, "abc")],
        [(1, "s", "en", 3, "abc"), (2, None, None, None, None), (None, "s", "en", 1, "x"), (None, "s", "en", 1, "a")],
        [(k, "é", lang, k, "x" * k) for k in range(7) for lang in ("ä", "z", "a", None, "\U0001f600", "￮")],
        [(4, "s", "en", 2**63 - 1, "y")] * 5 + [(4, "s", "en", 1, "y")] * 3 + [(9, "s", "fr", 0, ""), (9, "s", "fr", 0, None)],
    ],
)
def test_small(spark, tmp_path, rows):
    assert result(spark, rows, tmp_path) == expected(rows)


def test_tiers(spark, tmp_path):
    """More leaves than a block has, in several tiers; one language has most of them."""
    rows = [(k * 3, f"s{k % 5}", "en" if k % 10 else f"l{k % 7}", k, "word " * (k % 11)) for k in range(1_700)] + [(1, "s", "en", 9, "z" * 300_000)]
    assert result(spark, rows, tmp_path) == expected(rows)


def test_three_tiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BITS", 2)
    rows = [(k, "s", "en" if k % 3 else "de", k, "w") for k in range(100)]
    assert result(spark, rows, tmp_path) == expected(rows)


def test_fold(spark):
    path = F.array(F.struct(F.lit(True).alias("on_left"), F.lit("a").alias("digest")), F.struct(F.lit(False).alias("on_left"), F.lit("").alias("digest")))
    assert spark.range(1).select(M.fold(F.lit("x"), path)).first()[0] == h(h("a", "x"))


def test_one_exchange_for_all_levels(spark):
    nodes = spark.range(1_000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("idx"), F.lit(1_000).cast("long").alias("n"), F.col("id").cast("string").alias("h"))
    plan = M._climbed(nodes, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
