"""Registered queries for forms and rules that the tables' own facts don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import registry
from ..operators.work import save
from .queries import query, table
from .reconcile import judged_pairs


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd FROM orders),
f AS (SELECT *, y + CASE WHEN m >= 4 THEN 1 ELSE 0 END AS fy FROM d)
SELECT d, form, kind, CAST(s AS VARCHAR) AS period_start, CAST(e AS VARCHAR) AS period_end FROM (
  SELECT d, 'to date' AS form, 'range' AS kind, make_date(fy - 1, 4, 1) AS s, CAST(make_date(fy - 1, 4, 1) + to_months(m) - to_days(1) AS DATE) AS e FROM f
  UNION ALL SELECT d, 'year ended', 'fiscal_year', make_date(fy - 1, 4, 1), make_date(fy, 3, 31) FROM f
  UNION ALL SELECT d, 'bare', 'calendar_year', make_date(y, 1, 1), make_date(y, 12, 31) FROM f
  UNION ALL SELECT d, 'iso', 'instant', d, d FROM f
  UNION ALL SELECT d, 'day first', 'instant', d, d FROM f
  UNION ALL SELECT d, 'calendar', 'calendar_year', make_date(y, 1, 1), make_date(y, 12, 31) FROM f)""")
def parse_more_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in the written forms that parse_periods leaves out: months to date, a year's end, bare years, ISO and day-first dates."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    year, month = F.year("d").cast("string"), F.month("d")
    fy = (F.year("d") + F.when(month >= 4, 1).otherwise(0)).cast("string")
    forms = {
        "to date": F.concat(month.cast("string"), F.lit("M FY"), F.substring(fy, 3, 2)), "year ended": F.concat(F.lit("for the year ended "), F.date_format("d", "MMMM d, yyyy")),
        "bare": F.concat(F.lit("in  "), year), "iso": F.date_format("d", "yyyy-MM-dd"), "day first": F.concat(F.lit("on "), F.dayofmonth("d").cast("string"), F.lit("th "), F.date_format("d", "MMM, yyyy")), "calendar": F.concat(F.lit("CY'"), F.substring(year, 3, 2)),
    }
    rows = d.select("d", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in forms.items()])).alias("x"))
    return rows.select("d", "x.form", P.parse_period("x.raw").alias("p")).select("d", "form", "p.kind", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


#: Case, what differs between its two facts, the rule that is named for it, and the rule where restated and provisional figures go first.
_CASES = [
    ("entities", {"basis": ("segment:north", "segment:south")}, "R-different-entities", "R-different-entities"),
    ("kinds", {"kind": ("number", "categorical")}, "R0", "R0"),
    ("compatible", {"kind": ("categorical", "categorical"), "raw": ("Owned", "Leased")}, "R3", "R3"),
    ("unscoped", {"period": ("FY2024", None)}, "R4-unscoped", "R4-unscoped"),
    ("same page", {"document": ("x", "x")}, "R7b-same-page-breakdown", "R7b-same-page-breakdown"),
    ("basis", {"basis": ("audited", "unaudited")}, "R4-basis", "R4-basis"),
    ("restated", {"basis": ("restated", None)}, "R4-basis", "R5-restated"),
    ("provisional", {"basis": (None, "provisional")}, "R4-basis", "R7-provisional"),
    ("overlap", {"period": ("CY2023", "FY2024")}, "R4-period", "R4-period"),
    ("tenfold", {"times": (10, 1)}, "R8", "R8"),
    ("crore", {"times": (1, 10_000_000)}, "R8", "R8"),
]


def _told(case: str, what: dict, side: int):
    """One fact of a case, for each supplier."""
    pick = lambda name, default: what.get(name, (default, default))[side]
    times = what["times"][side] if "times" in what else 1 + side
    kind, basis = pick("kind", "number"), pick("basis", None)
    number = (F.col("s_suppkey") + 1).cast("double") * times
    return F.struct(
        F.lit(case).alias("case"), F.lit(side).alias("side"), F.lit(what.get("document", ("x", "y"))[side]).alias("document_id"), F.lit(kind).alias("value_kind"),
        F.lit(pick("raw", "Owned")).alias("value_raw"), F.when(F.lit(kind) == "number", number).alias("normalized_number"), F.when(F.lit(kind) == "number", F.lit("INR")).alias("normalized_unit"),
        F.lit(pick("period", "FY2024")).cast("string").alias("written"), (F.array(F.lit(basis)) if basis else F.array().cast("array<string>")).alias("basis"),
    )


@query(
    "WITH c(name, rule_id, documented, basis_aligned, ratio) AS (VALUES "
    + ", ".join(f"('{c}', '{r}', '{d}', {'true' if 'basis' not in w or c == 'entities' and w['basis'][0].startswith('segment:') else 'false'}, {'true' if c in ('tenfold', 'crore') else 'false'})" for c, w, r, d in _CASES)
    + ") SELECT s_suppkey, name AS case_name, rule_id, documented, basis_aligned, ratio FROM supplier, c"
)
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts of every supplier for each rule that the star tables' facts don't reach, judged in both orders of the rules.

    basis_aligned is the basis axis; ratio tells whether the explanation names a ratio that betrays a mistake of scale.
    """
    told = F.explode(F.array(*[_told(case, what, side) for case, what, _, _ in _CASES for side in (0, 1)]))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", told.alias("f")).select("s_suppkey", "s_name", "f.*")
    order = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(_CASES) for x in (c[0], k)]), F.col("case"))
    seq = (F.col("s_suppkey") * 100 + order) * 2 + F.col("side")
    facts = rows.withColumns({
        "fact_seq": seq, "id": F.concat(F.lit("fact_"), seq.cast("string")), "page_number": F.lit(1), "subject": F.col("s_name"), "predicate": F.lit("Floor space"), "fact_type": F.lit("quantity"), "value_iso": F.lit(None).cast("string"),
        "value_id": F.when(F.col("value_kind") == "categorical", F.concat(F.lit("value:"), F.lower("value_raw"))), "period": P.parse_period("written"), "asserted_as_of": F.lit("2024-05-01"),
        "canonical_subject_id": F.concat(F.lit("subject:"), "s_name"), "canonical_predicate_id": F.concat(F.lit("predicate:"), "case"), "confidence": F.lit(0.9),
    })
    facts = save(facts.drop("written", "s_name", "side"), "cases")
    edges = spark.createDataFrame([("value:owned", "value:leased", "compatible")], "a string, b string, kind string")
    judged = judged_pairs(facts, edges)
    first = facts.select(F.col("fact_seq").alias("a_seq"), "s_suppkey", F.col("case").alias("case_name"))
    other = judged_pairs(facts, edges, rules="documented").select("a_seq", F.col("j.decision.rule_id").alias("documented"))
    ratio = F.col("j.value.detail").rlike("10x:|a crore:")
    rows = judged.select("a_seq", F.col("j.decision.rule_id").alias("rule_id"), F.col("j.deltas")[2]["aligned"].alias("basis_aligned"), F.coalesce(ratio, F.lit(False)).alias("ratio"))
    return rows.join(first, "a_seq").join(other, "a_seq").drop("a_seq")


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v, lead(v, 1, (SELECT v FROM e ORDER BY vec_id LIMIT 1)) OVER (ORDER BY vec_id) AS w FROM e),
q AS (SELECT vec_id AS label, list_transform(list_zip(v, w), lambda x: CAST(CAST(x[1] + (0.3 + 0.01 * (vec_id // 100 % 70)) * x[2] AS FLOAT) AS DOUBLE)) AS v FROM p WHERE vec_id % 100 = 0),
s AS (SELECT label, vec_id AS entry, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS c FROM q JOIN e ON label <> vec_id OR label = vec_id)
SELECT label, entry, CAST(floor(c * 10000 + 0.5) AS BIGINT) AS cosine, CAST(row_number() OVER (PARTITION BY label ORDER BY c DESC, entry) AS INT) AS rank FROM s WHERE c >= 0.72 QUALIFY rank <= 3""")
def shortlist_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels between two entries, for the ids that 100 divides: the entries within the shortlist's cosine of 0.72, three at most."""
    e = save(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vectors")
    wanted = e.filter("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("own"), (F.col("vec_id") + 1).alias("after"))
    share = 0.3 + 0.01 * (F.floor(F.col("vec_id") / 100) % 70)
    mixed = F.zip_with("own", "embedding", lambda a, b: (a.cast("double") + share * b.cast("double")).cast("float"))
    q = wanted.join(e.withColumnRenamed("vec_id", "after"), "after").select(F.lit("subject").alias("namespace"), (-F.col("vec_id") - 1).alias("normal"), mixed.alias("embedding"))
    found = registry.shortlist(q, e.select(F.lit("subject").alias("namespace"), F.col("vec_id").alias("normal"), "embedding"))
    return found.select((-F.col("normal") - 1).alias("label"), "entry", F.floor(F.col("score") * 10000 + 0.5).cast("long").alias("cosine"), "rank")
