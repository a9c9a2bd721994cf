"""Registered queries against their DuckDB SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from claimweave.plans import queries as core
from claimweave.plans import reads
from claimweave.sources import star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shown(rows):
    return sorted(tuple(repr(v) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module", autouse=True)
def shared_facts(spark):
    """One derivation of the facts for all queries of this module but star_facts; each query derives its own elsewhere."""
    facts = star.facts(spark, SF)
    with pytest.MonkeyPatch.context() as patch:
        for module in (core, reads):
            patch.setattr(module, "derived_facts", lambda spark, sf_dir: facts)
        yield


#: test_live runs the stored corpus.
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"live_relations"}))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert shown(df.select(*columns).collect()) == shown(want)


def test_quotes_are_where_they_are_said_to_be(spark):
    rows = core.QUERIES["ground_quotes"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.form, []).append((r.status, r.method))
    assert {m for _, m in by["exact"]} == {"exact"} and {s for s, _ in by["fabricated"]} == {"quote_not_found"}
    assert {m for _, m in by["whitespace"]} <= {"exact", "whitespace"}
    assert sum(m == "caseless" for _, m in by["caseless"]) > 0.7 * len(by["caseless"])  # a capital ß has two letters
    assert {m for _, m in by["folded"]} <= {"exact", "folded", "scattered"}


def test_every_document_is_grounded(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lines = {d: [x.strip(" ") for x in (t or "").split("\n") if len(x.strip(" ")) >= 12] for d, t in texts.items()}
    rows = core.QUERIES["ground_exact_all"](spark, SF).collect()
    assert {r.doc_id: texts[r.doc_id][r.char_start : r.char_end] for r in rows} == {d: x[-1] for d, x in lines.items() if x}
    rates = core.QUERIES["quarantine_rate_all"](spark, SF).collect()
    assert sum(r.kept for r in rates) == sum(r.rejected for r in rates) == len(rows)


def test_quotes_of_the_quarantine_are_located_once(spark):
    """Kept and rejected quotes come from one table of what was located, not each from the documents again."""
    assert not [f for f in core.QUERIES["quarantine_rate"](spark, SF).inputFiles() if "documents.parquet" in f]


def test_units_lie_in_their_pages(spark):
    pages = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for u in core.QUERIES["segment_units"](spark, SF).collect():
        body = pages[u.page_number][u.char_start : u.char_end]
        assert [x.strip() for x in u.text.split("\n")] == [x.strip() for x in body.split("\n") if x.strip()]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_training_data_operators():
    """The guard of the entry module lets everything else work."""
    code = "import sys; sys.modules['claimweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}).returncode == 0
