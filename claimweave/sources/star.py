"""Claims derived from the star tables: what several documents say about revenues of nations and states of customers.

    document    published   says, per nation and fiscal year
    annual      2002-01-31  crore, FY1996 or 1995-96, consolidated
    deck        2002-03-15  million, FY96
    quarterly   2002-03-15  million, Q4 FY96, per quarter
    closing     2002-02-10  crore, March 31, 1996
    standalone  2002-02-10  four fifths of it, standalone
    typo        2002-02-20  7 % more, every fifth nation
    usd         2002-02-20  in dollars, every seventh nation
    status-a/b  two dates   per customer: active or overdrawn
    mix-a/b     two dates   per market segment and fiscal year, crore and million
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import normalize_number
from ..functions.periods import parse_period
from ..functions.text import normalize_subject, normalize_text
from ..operators.work import save

#: Document, published, scale, share of the true value, basis, currency, nations (every so many).
REVENUE_DOCS = [
    (0, "annual", "2002-01-31", "crore", "1", "consolidated", "INR", 1),
    (1, "deck", "2002-03-15", "million", "1", None, "INR", 1),
    (2, "quarterly", "2002-03-15", "million", "1", None, "INR", 1),
    (3, "closing", "2002-02-10", "crore", "1", None, "INR", 1),
    (4, "standalone", "2002-02-10", "crore", "0.8", "standalone", "INR", 1),
    (5, "typo", "2002-02-20", "crore", "1.07", None, "INR", 5),
    (6, "usd", "2002-02-20", "million", "1", None, "USD", 7),
]
STATUS_DOCS = [(7, "status-a", "2001-06-30"), (8, "status-b", "2002-01-31")]
MIX_DOCS = [(9, "mix-a", "2002-01-31", "crore"), (10, "mix-b", "2002-03-15", "million")]
DIVISOR = {"crore": 7, "million": 6}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact order totals by nation, market segment, fiscal year and quarter: combined before anything is derived."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    orders = _table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        (year + F.when(month >= 4, 1).otherwise(0)).alias("fy"), (F.floor(F.pmod(month - 4, F.lit(12)) / 3) + 1).cast("int").alias("q"),
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment", "fy", "q").agg(F.sum("price").alias("total"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims in the shape of an extractor's answers, one row each, with fact_seq as their order."""
    sums = _sums(spark, sf_dir)
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    fy, short = F.col("fy").cast("string"), F.lpad((F.col("fy") % 100).cast("string"), 2, "0")
    spanned = F.concat((F.col("fy") - 1).cast("string"), F.lit("-"), short)
    texts = {
        "annual": F.when(F.col("fy") % 2 == 0, F.concat(F.lit("FY"), fy)).otherwise(spanned),
        "quarterly": F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" FY"), short),
        "closing": F.concat(F.lit("March 31, "), fy),
    }
    parts = []

    def claim(rows: DataFrame, seq, doc: str, published: str, subject, predicate: str, kind: str, raw, period, scale=None, currency=None, basis=None) -> DataFrame:
        return rows.select(
            seq.cast("long").alias("fact_seq"), F.lit(doc).alias("document_id"), F.lit(published).alias("asserted_as_of"), subject.alias("subject"),
            F.lit(predicate).alias("predicate"), F.lit("quantity" if kind == "number" else "state").alias("fact_type"), F.lit(kind).alias("value_kind"), raw.alias("value_raw"),
            F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"), F.lit(scale).cast("string").alias("scale"), F.lit(currency).cast("string").alias("currency"),
            period.alias("period_raw"), (F.array(F.lit(basis)) if basis else F.array().cast("array<string>")).alias("basis"),
            (seq % 7 + 1).cast("int").alias("page_number"), F.lit(0.9).alias("confidence"),
        )

    by_quarter = sums.groupBy("c_nationkey", "fy", "q").agg(F.sum("total").alias("total")).join(nations, "c_nationkey")
    by_year = sums.groupBy("c_nationkey", "fy").agg(F.sum("total").alias("total")).join(nations, "c_nationkey")
    for k, doc, published, scale, share, basis, currency, every in REVENUE_DOCS:
        rows = (by_quarter if doc == "quarterly" else by_year.withColumn("q", F.lit(0))).filter(F.col("c_nationkey") % every == 0)
        seq = ((F.lit(k).cast("long") * 100 + F.col("c_nationkey")) * 10000 + F.col("fy")) * 10 + F.col("q")
        value = (F.col("total") * F.lit(share).cast("decimal(4,2)")).cast("decimal(30,4)")
        raw = F.format_string("%s", (value / F.lit(10 ** DIVISOR[scale]).cast("decimal(10,0)")).cast("decimal(38,12)"))
        subject = F.concat(F.col("n_name"), F.lit(" Limited" if k % 2 else ""))
        parts.append(claim(rows, seq, doc, published, subject, "Revenue from operations", "number", raw, texts.get(doc, F.concat(F.lit("FY"), short)), scale, currency, basis))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    for k, doc, published in STATUS_DOCS:
        state = F.when((F.col("c_acctbal") < 0) & (k == 8), "Overdrawn").otherwise("Active")
        parts.append(claim(customers, F.lit(k).cast("long") * 1_000_000_000 + F.col("c_custkey"), doc, published, F.col("c_name"), "Account status", "categorical", state, F.lit("FY2001")))
    by_segment = sums.groupBy("c_mktsegment", "fy").agg(F.sum("total").alias("total"))
    for k, doc, published, scale in MIX_DOCS:
        raw = F.format_string("%s", (F.col("total").cast("decimal(30,4)") / F.lit(10 ** DIVISOR[scale]).cast("decimal(10,0)")).cast("decimal(38,12)"))
        seq = F.lit(k).cast("long") * 1_000_000_000 + F.ascii("c_mktsegment") * 10_000 + F.col("fy")
        parts.append(claim(by_segment, seq, doc, published, F.initcap("c_mktsegment"), "Segment revenue", "number", raw, F.concat(F.lit("FY"), fy), scale, "INR"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lift(claims: DataFrame) -> DataFrame:
    """Facts from claims: periods parsed, values normalised, subjects and measures folded to registry ids."""
    value = normalize_number("number", "value_raw", "unit", "scale", "currency")
    number = F.when(F.col("value_kind") == "number", value)
    return claims.select(
        "fact_seq", F.concat(F.lit("fact_"), F.col("fact_seq").cast("string")).alias("id"), "document_id", "page_number", "subject", "predicate", "fact_type", "value_kind", "value_raw",
        F.when(F.col("value_kind") == "date", parse_period("value_raw")["start"]).alias("value_iso"),
        F.when(F.col("value_kind").isin("categorical", "entity"), F.concat(F.lit("value:"), normalize_text("value_raw"))).alias("value_id"),
        parse_period("period_raw").alias("period"), "asserted_as_of", F.filter(F.transform("basis", lambda b: F.lower(F.trim(b))), lambda b: b != "").alias("basis"),
        F.concat(F.lit("subject:"), normalize_subject("subject")).alias("canonical_subject_id"), F.concat(F.lit("predicate:"), normalize_text("predicate")).alias("canonical_predicate_id"),
        number["value"].alias("normalized_number"), number["unit"].alias("normalized_unit"), "confidence",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, written once: every later step reads it several times."""
    return save(lift(save(claims(spark, sf_dir), "claims")), "facts")


def edges(spark: SparkSession) -> DataFrame:
    """Registry edges between the states."""
    return spark.createDataFrame([("value:active", "value:overdrawn", "exclusive")], "a string, b string, kind string")


#: The same facts as DuckDB SQL, with values and intervals computed directly from the tables instead of parsed.
FACTS_SQL = r"""
sums AS (
  SELECT c_nationkey AS n, c_mktsegment AS seg, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy,
         ((month(o_orderdate) + 8) % 12) // 3 + 1 AS q, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
docs(k, doc, published, share, basis, cur, every) AS (VALUES
  (0, 'annual', '2002-01-31', 1.0, 'consolidated', 'INR', 1), (1, 'deck', '2002-03-15', 1.0, '', 'INR', 1),
  (2, 'quarterly', '2002-03-15', 1.0, '', 'INR', 1), (3, 'closing', '2002-02-10', 1.0, '', 'INR', 1),
  (4, 'standalone', '2002-02-10', 0.8, 'standalone', 'INR', 1), (5, 'typo', '2002-02-20', 1.07, '', 'INR', 5),
  (6, 'usd', '2002-02-20', 1.0, '', 'USD', 7)),
revenue AS (
  SELECT n, fy, 0 AS q, sum(total) AS total FROM sums GROUP BY n, fy
  UNION ALL SELECT n, fy, q, sum(total) FROM sums GROUP BY n, fy, q),
facts AS (
  SELECT ((CAST(k AS BIGINT) * 100 + n) * 10000 + fy) * 10 + q AS seq, doc, published, 'predicate:revenue from operations' AS p,
         'subject:' || replace(lower(n_name), '_', ' ') AS s, CAST(total AS DOUBLE) * share AS value, cur AS unit, basis, 'number' AS kind, '' AS state,
         CASE WHEN doc = 'closing' THEN make_date(fy, 3, 31)
              WHEN doc = 'quarterly' THEN CAST(make_date(fy - 1, 4, 1) + to_months(3 * CAST(q - 1 AS INT)) AS DATE) ELSE make_date(fy - 1, 4, 1) END AS ps,
         CASE WHEN doc = 'quarterly' THEN CAST(make_date(fy - 1, 4, 1) + to_months(3 * CAST(q AS INT)) - to_days(1) AS DATE) ELSE make_date(fy, 3, 31) END AS pe
  FROM revenue JOIN nation ON n = n_nationkey JOIN docs ON n % every = 0 AND (doc = 'quarterly') = (q > 0)
  UNION ALL
  SELECT k * 1000000000 + c_custkey, doc, published, 'predicate:account status', 'subject:' || replace(lower(c_name), '#', ' '), NULL, NULL, '', 'categorical',
         CASE WHEN c_acctbal < 0 AND k = 8 THEN 'Overdrawn' ELSE 'Active' END, DATE '2000-04-01', DATE '2001-03-31'
  FROM customer, (VALUES (CAST(7 AS BIGINT), 'status-a', '2001-06-30'), (CAST(8 AS BIGINT), 'status-b', '2002-01-31')) t(k, doc, published)
  UNION ALL
  SELECT k * 1000000000 + ascii(seg) * 10000 + fy, doc, published, 'predicate:segment revenue', 'subject:' || lower(seg), CAST(sum(total) AS DOUBLE), 'INR', '', 'number', '',
         make_date(fy - 1, 4, 1), make_date(fy, 3, 31)
  FROM sums, (VALUES (CAST(9 AS BIGINT), 'mix-a', '2002-01-31'), (CAST(10 AS BIGINT), 'mix-b', '2002-03-15')) t(k, doc, published)
  GROUP BY k, doc, published, seg, fy)
"""
