"""The pipeline's stages, each judged on its own input."""

import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
import pytest
from claimweave.llm import jaccard_join, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, sample):
    docs, columns = sample, sample.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.save(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == columns, name
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()} - bad
        if name == "exact_dedup":
            squeeze = lambda t: "".join((t or "").split())
            texts = [squeeze(r.text) for r in after.collect()]
            assert len(texts) == len(set(texts)) == len({squeeze(r.text) for r in docs.collect()})
        if name == "near_dedup":
            classes = {r.class_id for r in jaccard_join.jaccard_join(docs).collect()}
            assert {r.doc_id for r in after.collect()} == classes
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not [r.doc_id for r in after.collect() if any(t in r.text for t in items)]
        docs = after
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and rows.groupby("sequence_id").length.sum().max() <= 1024


def test_stages_of_odd_rows(spark, make):
    """Nulls, empty and very long texts, ties, repeated rows, columns of clashing names, and a table without rows."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    near = " ".join(f"w{k}" for k in range(200))
    pairs = [(1, None), (2, ""), (3, " \n"), (4, near), (5, near + " end"), (5, near + " end"), (6, "x" * 300_000), (7, f"see {item} there"), (8, "you idiot, moron, scum and worthless trash"), (9, "..."), (10, "!?"), (11, "a clean short text"), (None, "no id"), (None, None)]
    # Rows without an id go by their own text, and so do two texts of one id; of a class without ids one row stays.
    around = lambda x: " ".join(f"{x}{k}" for k in range(200))
    alone = around("v")
    pairs += [(None, "an idiot, a moron, scum and worthless trash"), (11, "you moron, idiot, worthless scum"), (None, f"{around('p')} {item}"), (11, f"{around('q')} {item}"), (None, near + " also"), (None, alone), (None, alone + " end")]
    docs = make(pairs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.save(stage(spark, docs, SF), f"odd-{name}")
        assert after.columns == docs.columns and stage(spark, make([]), SF).collect() == [], name
        docs, kept[name] = after, sorted((r.doc_id for r in after.collect()), key=lambda d: (d is None, d))
    assert kept["toxicity"] == [1, 2, 3, 4, 5, 5, 6, 7, 9, 10, 11, 11] + 6 * [None]
    assert kept["exact_dedup"] == [3, 4, 5, 6, 7, 9, 10, 11, 11] + 5 * [None]
    assert kept["near_dedup"] == [3, 4, 6, 7, 9, 10, 11, 11] + 3 * [None]
    assert kept["decontamination"] == [3, 4, 6, 9, 10, 11] + 2 * [None]
    assert [r.text for r in docs.collect() if r.doc_id == 11] == ["a clean short text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])
    assert corpus_pipeline.STAGES[-1][1](spark, make([]), SF).collect() == []


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup", "decontamination", "packing"])
def test_stages_hand_over_few_rows_at_once(spark, sample, stage):
    """Also when what a stage returns is read later; a lower setting stays."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    largest = lambda: max(r.n for r in spark.range(0, 20_000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect())
    before = spark.conf.get(rows)
    try:
        for most, want in ((10_000, corpus_pipeline.BATCH), (0, corpus_pipeline.BATCH), (7, 7)):
            spark.conf.set(rows, str(most))
            dict(corpus_pipeline.STAGES)[stage](spark, sample.limit(3), SF)
            assert largest() == want <= 1_000
    finally:
        spark.conf.set(rows, before)


def test_workers_need_no_pandas():
    """A worker imports what the stages' functions are in; pandas alone takes 20 MB of each."""
    code = "import sys, corpus_pipeline; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
