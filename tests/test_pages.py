"""Files of laid-out items, and functions called from SQL."""

import json
import random

import pytest

from claimweave.operators import segmentation as S
from claimweave.plans import evidence
from claimweave.plans import queries as core
from claimweave.sources import files
from claimweave.sql import register

SF = "/root/testdata/sf0.001"


def item(text, x, y):
    return {"str": text, "x": x, "y": y, "width": 6 * len(text), "height": 10}


def test_files_become_pages(spark, tmp_path):
    first = {"pages": [{"height": 800, "items": [item("Revenue", 10, 700), item("8,141", 100, 701), item("", 5, 5), item("Total", 10, 650)]}, {"height": 800, "items": [item("next", 0, 10)]}]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps(first))
    (tmp_path / "b.json").write_text(json.dumps({"pages": [{"height": 800, "items": []}]}))
    (tmp_path / "c.txt").write_text("not an item")
    items = files.laid_out(spark, str(tmp_path), rows=2)
    assert items.count() == 5
    pages = {(r.document_id.rsplit("/", 1)[1], r.page_number): r for r in S.layout_pages(items).collect()}
    assert {k: r.text for k, r in pages.items()} == {("a.json", 1): "Revenue        8,141\nTotal\n", ("a.json", 2): "next\n"}
    assert [(s.s, s.e) for s in pages["a.json", 1].spans] == [(0, 7), (15, 20), (21, 26)]


def test_another_decoder_and_a_refused_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tone\n2\ttwo\n")

    def decode(content):
        for line in content.decode().splitlines():
            page, word = line.split("\t")
            yield int(page), 100.0, word, 0.0, 0.0, 10.0, 10.0

    assert [r.text for r in S.layout_pages(files.laid_out(spark, str(tmp_path), "*.tsv", decode)).orderBy("page_number").collect()] == ["one\n", "two\n"]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception, match="JSONDecodeError"):
        files.laid_out(spark, str(tmp_path)).collect()


def test_units_called_from_sql(spark):
    own, by_sql = core.segment_units(spark, SF), evidence.segment_units_by_sql(spark, SF)
    assert own.count() > 0 and sorted(map(str, own.collect())) == sorted(map(str, by_sql.select(*own.columns).collect()))


def test_odd_arguments_of_page_units(spark):
    register(spark)
    assert spark.sql("SELECT * FROM page_units(CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>))").count() == 0
    text = "a line that is long enough to be kept"
    assert [r.text for r in spark.sql(f"SELECT * FROM page_units('head\\n{text}', array('head'))").collect()] == [text]
    with pytest.raises(Exception, match="text is a string"):
        spark.sql("SELECT * FROM page_units(1, array('x'))").collect()
    with pytest.raises(Exception, match="array of strings"):
        spark.sql("SELECT * FROM page_units('x', 'y')").collect()


def laid(items, tolerance=3.0, widest=12):
    """Text and spans of one page, item after item."""
    lines = []
    for i in sorted((i for i in items if i[0]), key=lambda i: (-i[2], i[1])):
        if lines and abs(lines[-1][0][2] - i[2]) <= tolerance:
            lines[-1].append(i)
        else:
            lines.append([i])
    text, spans = "", []
    for line in lines:
        right = None
        for word, x, y, width, height, top in sorted(line, key=lambda i: i[1]):
            if right is not None and width > 0:
                text += " " * min(max(int((x - right) / (width / len(word)) + 0.5), 0), widest)
            h = abs(height) or 10.0
            spans.append((len(text), len(text) + len(word), x, top - y - h, width, h))
            text, right = text + word, x + width
        text += "\n"
    return text, spans


def test_layout_against_one_item_after_the_other(spark, monkeypatch):
    """Close heights, gaps, items over each other, widths of 0, pages without letters; more pages than are laid out at a time."""
    monkeypatch.setattr(S, "PAGES", 7)
    draw = random.Random(2)
    rows = {}
    for page in range(60):
        words = draw.choices(["", "a", "wörd", "東京 x", "𝒳y", "long-word"], k=draw.choice([1, 2, 30])) if page else ["", ""]
        rows["d", page] = [(w, k + draw.uniform(0, 900), draw.choice([700.0, 698.5, 696.0, 693.5, 500.0, 10.25]), draw.choice([0.0, 6.5 * len(w)]), draw.choice([0.0, -9.0, 11.0]), 800.0) for k, w in enumerate(words)]
    items = spark.createDataFrame([(d, p, *i) for (d, p), own in rows.items() for i in own], "document_id string, page int, str string, x double, y double, width double, height double, page_height double").repartition(3)
    got = {(r.document_id, r.page_number): (r.text, [tuple(s) for s in r.spans]) for r in S.layout_pages(items).collect()}
    assert got == {key: laid(own) for key, own in rows.items()} and got["d", 0] == ("", [])


def test_words_of_documents_are_not_rows(spark):
    """A page's items go to its layout as one row, and only texts are shuffled."""
    plan = evidence.laid_out_pages(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FlatMapGroups" not in plan
