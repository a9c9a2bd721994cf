"""Sums of parts against a search over all facts."""

import calendar
import datetime
import itertools
import random

from pyspark.sql import functions as F

from claimweave.operators.derivation import GRIDS, derivations

SCHEMA = "fact_seq long, id string, document_id string, canonical_predicate_id string, canonical_subject_id string, normalized_number double, normalized_unit string, basis array<string>, period struct<raw:string,kind:string,start:string,end:string>, total double"


def period(year, month, months):
    last = (year * 12 + month - 1) + months - 1
    end = datetime.date(last // 12, last % 12 + 1, calendar.monthrange(last // 12, last % 12 + 1)[1])
    return ("p", "range", f"{year}-{month:02}-01", str(end))


def expected(rows):
    out, real = {}, [r for r in rows if r[5] is not None and r[6] != "%" and r[8] and len(r[8][2]) == 10]
    index = lambda p: int(p[2][:4]) * 12 + int(p[2][5:7]) - 1
    length = lambda p: int(p[3][:4]) * 12 + int(p[3][5:7]) - index(p)
    scope = lambda r: "|".join(sorted(r[7]))
    for w in real:
        for m, wholes in GRIDS.items():
            if length(w[8]) not in wholes:
                continue
            found = []
            for doc, sc in itertools.product({r[2] for r in real}, {scope(r) for r in real}):
                if scope(w) not in (sc, "") and sc != "":
                    continue
                parts = []
                for k in range(length(w[8]) // m):
                    at = [r for r in real if (r[2], scope(r), r[3], r[4], r[6]) == (doc, sc, w[3], w[4], w[6]) and length(r[8]) == m and index(r[8]) == index(w[8]) + k * m]
                    parts.append(min(at, default=None))
                if None not in parts:
                    found.append(((doc != w[2], sc != scope(w), min(p[0] for p in parts)), doc, tuple(p[1] for p in parts), sum(p[5] for p in parts)))
            if found:
                _, doc, ids, total = min(found)
                out[w[1], m] = (doc, ids, abs(total - w[5]) <= 0.005 * max(abs(total), abs(w[5])))
    return out


def test_against_a_search(spark):
    rng = random.Random(3)
    rows = []
    for k in range(700):
        months = rng.choice([1, 3, 3, 3, 6, 6, 12, 12, 9])
        month = rng.choice([1, 4, 7, 10]) if months > 1 else rng.randint(1, 12)
        rows.append((k, f"f{k}", rng.choice("ab"), "p", rng.choice(["s", None]), 100.0 * months * rng.choice([1, 1, 1, 1.01]), rng.choice(["INR", "INR", None, "%"]), rng.choice([[], [], ["consolidated"]]), period(rng.choice([2020, 2021]), month, months), 0.0))
    rows += [(900, "n", "a", "p", "s", None, "INR", [], period(2020, 4, 12), 0.0), (901, "x", "a", "p", "s", 1.0, "INR", [], None, 0.0), (902, "y", "a", "p", "s", 1.0, "INR", [], ("p", "range", "2020-13-45", "2020-99-01"), 0.0), (903, "z", None, None, "s", 1.0, "INR", [], period(2020, 4, 12), 0.0)]
    got = derivations(spark.createDataFrame(rows, SCHEMA)).collect()
    told = {(r.fact_id, r.part_months): (r.parts_document, tuple(r.parts), r.holds) for r in got}
    want = expected([r for r in rows if r[0] < 902])
    assert len(got) == len(told) and told == want and {v[2] for v in want.values()} == {True, False}
    assert all((r.verdict == "DERIVES") == r.holds for r in got)


def test_empty(spark):
    assert derivations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_pairs_of_a_block(spark):
    """The plan has equi-joins only."""
    plan = derivations(spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
