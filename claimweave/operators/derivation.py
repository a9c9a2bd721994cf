"""Figures that follow from others: a longer period's value as the sum of the periods that tile it.

Four quarters make a fiscal year, whichever document says so. Parts come from one document and are of one length; they are
found by their place in the grid of a longer period, so each part looks up the periods that it can belong to, and no two
facts of a block are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import period_months
from .blocking import KEY
from .reasoning import RELATIVE
from .tables import same_key

#: Months of a part, and of the longer periods that such parts tile.
GRIDS = {1: [3, 6, 9, 12], 3: [6, 9, 12], 6: [12]}


def _scope() -> Column:
    return F.array_join(F.array_sort(F.coalesce("basis", F.array().cast("array<string>"))), "|")


def _figures(facts: DataFrame) -> DataFrame:
    """Facts with a number that can be added up, over whole months of real dates: first, last, months."""
    p = F.col("period")
    known = F.col("normalized_number").isNotNull() & ~F.isnan("normalized_number") & (F.abs("normalized_number") < float("inf")) & ~F.col("normalized_unit").eqNullSafe(F.lit("%"))
    rows = facts.filter(known & F.col("canonical_predicate_id").isNotNull() & p.isNotNull())
    rows = rows.select(*KEY, "fact_seq", "id", "document_id", F.col("normalized_unit").alias("unit"), _scope().alias("scope"), F.col("normalized_number").alias("value"), p["start"].try_cast("date").alias("first"), p["end"].try_cast("date").alias("last"), period_months("period").alias("months"))
    return rows.filter((F.col("months") > 0) & (F.col("last") == F.date_sub(F.add_months("first", F.col("months")), 1)))


def tilings(facts: DataFrame) -> DataFrame:
    """Periods that a document's parts of one length tile, with their sum: KEY, unit, scope, parts_document, first, months, part_months, total, parts (ids in order), seq.

    Of parts that repeat a period the one with the smallest fact_seq counts.
    """
    places = [F.struct(F.lit(part).alias("part_months"), F.lit(whole).alias("whole"), F.lit(k).alias("place")) for part, wholes in GRIDS.items() for whole in wholes for k in range(whole // part)]
    parts = _figures(facts).withColumn("grid", F.explode(F.filter(F.array(*places), lambda g: g["part_months"] == F.col("months"))))
    begin = F.add_months("first", -F.col("grid.place") * F.col("grid.part_months"))
    # The grid of a longer period: back to this part it must lead from its first day.
    parts = parts.withColumn("begin", begin).filter(F.add_months("begin", F.col("grid.place") * F.col("grid.part_months")) == F.col("first"))
    group = [*KEY, "unit", "scope", "document_id", "begin", "grid.whole", "grid.part_months"]
    one = parts.groupBy(*group, "grid.place").agg(F.min_by(F.struct("value", "id", "fact_seq"), "fact_seq").alias("part"))
    whole = one.groupBy(*KEY, "unit", "scope", "document_id", "begin", "whole", "part_months").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("own"))  # twelve at most
    whole = whole.filter(F.size("own") == F.col("whole") / F.col("part_months"))
    total = F.aggregate("own", F.lit(0.0), lambda t, x: t + x["part"]["value"])
    return whole.select(*KEY, "unit", "scope", F.col("document_id").alias("parts_document"), F.col("begin").alias("first"), F.col("whole").alias("months"), "part_months", total.alias("total"), F.transform("own", lambda x: x["part"]["id"]).alias("parts"), F.array_min(F.transform("own", lambda x: x["part"]["fact_seq"])).alias("seq"))


def derivations(facts: DataFrame) -> DataFrame:
    """fact_id, document_id, parts_document, parts (ids), part_months, value, total, holds, verdict of each figure that a tiling stands against.

    Figure and parts are of one block and unit, and of one scope, or one of them names none. A figure meets, for each
    length of parts, the tiling of its own document, else of its own scope, else the first mentioned. The verdict is
    DERIVES where the sum is the figure within the tolerance of numbers, else null: other facts may say why it isn't.
    """
    figures = _figures(facts).drop("last")
    found = tilings(facts)
    key = [*KEY, "unit", "first", "months"]
    order = F.struct("seq", "parts_document")
    tiling = F.struct("scope", "parts_document", "part_months", "total", "parts", "seq")
    # One tiling of each scope for all figures, and those of a figure's own document.
    firsts = found.groupBy(*key, "scope", "part_months").agg(F.min_by(tiling, order).alias("t")).select(*[F.col(k).alias(f"t_{k}") for k in key], "t")
    own = found.select(*[F.col(k).alias(f"t_{k}") for k in key], F.col("parts_document").alias("t_doc"), tiling.alias("t"))
    on = same_key(key, [f"t_{k}" for k in key])
    met = figures.join(firsts, on).select(*figures.columns, "t").union(figures.join(own, on & F.col("document_id").eqNullSafe(F.col("t_doc"))).select(*figures.columns, "t"))
    met = met.filter((F.col("scope") == F.col("t.scope")) | (F.col("scope") == "") | (F.col("t.scope") == ""))
    rank = F.struct(~F.col("t.parts_document").eqNullSafe(F.col("document_id")), F.col("t.scope") != F.col("scope"), F.col("t.seq"), F.col("t.parts_document"))
    best = met.groupBy("fact_seq", "id", "document_id", "value", F.col("t.part_months").alias("part_months")).agg(F.min_by("t", rank).alias("t"))
    size = F.greatest(F.abs("value"), F.abs("t.total"))
    holds = F.when(size == 0, True).otherwise(F.abs(F.col("value") - F.col("t.total")) <= RELATIVE * size)
    return best.select(F.col("id").alias("fact_id"), "document_id", "t.parts_document", "t.parts", "part_months", "value", "t.total", holds.alias("holds"), F.when(holds, "DERIVES").alias("verdict"))
