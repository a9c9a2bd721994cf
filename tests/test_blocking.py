"""First pairs of blocks against a loop over each block."""

import random

import pytest

from claimweave.operators.blocking import KEY, block_pairs

SCHEMA = "canonical_predicate_id string, canonical_subject_id string, fact_seq long, document_id string"


def expected(rows, cross_above, cap):
    groups = {}
    for p, s, seq, doc in rows:
        if p is not None:
            groups.setdefault((p, s), []).append((seq, doc))
    out = set()
    for (p, s), own in groups.items():
        own.sort()
        n = 0
        for i, (a, x) in enumerate(own):
            for b, y in own[i + 1 :]:
                if (len(own) <= cross_above or x != y) and (cap is None or n < cap):
                    n += 1
                    out.add((p, s, a, b))
    return out


def blocks_of_all_kinds(seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    kinds = [lambda n: ["d"] * n, lambda n: ["d"] * n + ["e"], lambda n: ["d"] * n + rng.choices("efg", k=n), lambda n: rng.choices("de", k=n), lambda n: [f"{rng.randint(0, n)}" for _ in range(n)], lambda n: ["e", "e"] + ["d"] * n + ["e", "f"] * 3, lambda n: [None] * n + ["d"]]
    for k, kind in enumerate(kinds):
        for n in (1, 2, 5, 12, 30, 60):
            for doc in kind(n):
                seq += rng.randint(1, 3)
                rows.append((f"p{k}", None if n == 30 else f"s{n}", seq, doc))
    rows += [(None, "s", seq + k, "d") for k in range(1, 4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cross_above,cap", [(4, 5), (0, 3), (40, 7), (4, 1), (3, None), (40, 1_200)])
def test_first_pairs(spark, cross_above, cap):
    rows = blocks_of_all_kinds(cap or 0)
    got = block_pairs(spark.createDataFrame(rows, SCHEMA).repartition(6), cross_above, cap)
    assert got.columns == [*KEY, "a_seq", "b_seq"]
    told = [tuple(r) for r in got.collect()]
    assert len(told) == len(set(told)) and set(told) == expected(rows, cross_above, cap)


def test_empty(spark):
    assert block_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
