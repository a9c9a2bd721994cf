"""The registered queries over the star tables, embeddings and documents, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..operators import blocking, grounding, ingest, locating, registry, store
from ..operators import segmentation as S
from ..sources import responses, star
from ..operators.work import save, spread
from .reconcile import judged_pairs, relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, over all cores even where they are a single file."""
    return spread(table(spark, sf_dir, "documents"))


def _cents(c):
    return F.floor(c * 100 + 0.5).cast("long")


# ---- numbers -------------------------------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey * 100 + l_linenumber AS n, l_linenumber % 6 AS form FROM lineitem)
SELECT k, form, CASE form WHEN 0 THEN -CAST(n AS DOUBLE) WHEN 1 THEN CAST(n AS DOUBLE) WHEN 2 THEN -CAST(n AS DOUBLE) WHEN 3 THEN CAST('.' || n AS DOUBLE) WHEN 4 THEN CAST(n || '.5' AS DOUBLE) END AS value,
       count(*) AS n FROM k GROUP BY ALL""")
def parse_numeric_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("n"), (F.col("l_linenumber") % 6).alias("form"))
    n = F.col("n").cast("string")
    grouped = F.format_number("n", 0)
    forms = [F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("Rs. "), grouped), F.concat(F.lit("- "), n), F.concat(F.lit("about ."), n), F.concat(F.lit("₹ "), grouped, F.lit(".5 Cr")), F.lit("not applicable")]
    raw = F.element_at(F.array(*forms), F.col("form") + 1)
    return rows.select("k", "form", N.parse_numeric_literal(raw).alias("value")).groupBy("k", "form", "value").agg(F.count("*").alias("n"))


_UNITS = [("crore", "INR", None, 1e7, "INR"), ("Lakhs", "₹", None, 1e5, "INR"), ("mn", "US$", None, 1e6, "USD"), (None, None, "bps", 0.01, "%"), (None, None, "Per  Cent", 1.0, "%"), (None, None, "km", 1000.0, "m"), ("thousand", None, "parcels", 1e3, "parcels"), (None, None, None, 1.0, "count"), ("lakh crore", "rs.", None, 1e12, "INR"), ("bn", None, "eur", 1e9, "EUR")]


@query(
    "WITH u(k, factor, unit) AS (VALUES " + ", ".join(f"({k}, {u[3]!r}::DOUBLE, '{u[4]}')" for k, u in enumerate(_UNITS)) + ") "
    "SELECT k, unit, count(*) AS n, CAST(sum(CAST(floor(l_quantity * factor + 0.5) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS total FROM lineitem JOIN u ON l_orderkey % 10 = k GROUP BY k, unit"
)
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.createDataFrame([(k, *u[:3]) for k, u in enumerate(_UNITS)], "k int, scale string, currency string, unit string")
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_orderkey") % 10).cast("int").alias("k")).join(F.broadcast(units), "k")
    value = N.normalize_number("l_quantity", F.col("l_quantity").cast("string"), "unit", "scale", "currency")
    rows = rows.select("k", value.alias("v"))
    return rows.groupBy("k", F.col("v.unit").alias("unit")).agg(F.count("*").alias("n"), F.sum(F.floor(F.col("v.value") + 0.5).cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))


@query("""
WITH t AS (SELECT c_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, CASE WHEN v < 0 THEN '-' ELSE '' END || format('{:,}', CAST(floor(abs(v)) AS BIGINT)) ||
  CASE WHEN CAST(floor(abs(v) * 1000 + 0.5) AS BIGINT) % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(CAST(floor(abs(v) * 1000 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0'), '0') END || ' kg' AS shown FROM t""")
def format_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("v"))
    return sums.select("c_nationkey", N.format_normalized("v", F.lit("kg")).alias("shown"))


# ---- periods -------------------------------------------------------------------------------------------------------

_DATES = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders"
_FY = "(y + CASE WHEN m >= 4 THEN 1 ELSE 0 END)"
_QSTART = "CAST(make_date(y, ((m - 1) // 3) * 3 + 1, 1) AS DATE)"


@query(f"""
WITH d AS ({_DATES}), f AS (SELECT *, {_FY} AS fy FROM d)
SELECT d, form, kind, CAST(s AS VARCHAR) AS period_start, CAST(e AS VARCHAR) AS period_end FROM (
  SELECT d, 'fy' AS form, 'fiscal_year' AS kind, make_date(fy - 1, 4, 1) AS s, make_date(fy, 3, 31) AS e FROM f
  UNION ALL SELECT d, 'span', 'fiscal_year', make_date(fy - 1, 4, 1), make_date(fy, 3, 31) FROM f
  UNION ALL SELECT d, 'quarter', 'quarter', {_QSTART}, CAST({_QSTART} + to_months(3) - to_days(1) AS DATE) FROM f
  UNION ALL SELECT d, 'half', 'half_year', CASE WHEN m BETWEEN 4 AND 9 THEN make_date(y, 4, 1) ELSE make_date(fy - 1, 10, 1) END, CASE WHEN m BETWEEN 4 AND 9 THEN make_date(y, 9, 30) ELSE make_date(fy, 3, 31) END FROM f
  UNION ALL SELECT d, 'instant', 'instant', d, d FROM f
  UNION ALL SELECT d, 'dmy', 'instant', d, d FROM f
  UNION ALL SELECT d, 'year', 'calendar_year', make_date(y, 1, 1), make_date(y, 12, 31) FROM f
  UNION ALL SELECT d, 'none', NULL, NULL, NULL FROM f)""")
def parse_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in every written form, parsed."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    y, m = F.year("d"), F.month("d")
    fy = y + F.when(m >= 4, 1).otherwise(0)
    short = F.lpad((fy % 100).cast("string"), 2, "0")
    quarter = (F.floor(F.pmod(m - 4, F.lit(12)) / 3) + 1).cast("string")
    forms = {
        "fy": F.concat(F.lit("F.Y. "), fy.cast("string")), "span": F.concat((fy - 1).cast("string"), F.lit("–"), short),
        "quarter": F.concat(F.lit("Q"), quarter, F.lit("FY"), short), "half": F.concat(F.lit("H"), F.when(m.between(4, 9), "1").otherwise("2"), F.lit(" FY"), short),
        "instant": F.concat(F.lit("as at "), F.date_format("d", "MMMM d, yyyy")), "dmy": F.date_format("d", "dd/MM/yyyy"),
        "year": F.concat(F.lit("CY"), y.cast("string")), "none": F.lit("consolidated"),
    }
    rows = d.select("d", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("raw")) for k, v in forms.items()])).alias("x"))
    p = rows.select("d", "x.form", P.parse_period("x.raw").alias("p"))
    return p.select("d", "form", F.col("p.kind").alias("kind"), F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"))


@query(f"""
WITH d AS (SELECT DISTINCT {_FY} AS fy FROM ({_DATES})), s AS (SELECT unnest([1, 4, 7, 10]) AS fy_start)
SELECT fy, fy_start, CAST(CASE WHEN fy_start = 1 THEN make_date(fy, 1, 1) ELSE make_date(fy - 1, fy_start, 1) END AS VARCHAR) AS window_start,
       CAST(CAST(CASE WHEN fy_start = 1 THEN make_date(fy + 1, 1, 1) ELSE make_date(fy, fy_start, 1) END - to_days(1) AS DATE) AS VARCHAR) AS window_end FROM d, s""")
def fiscal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select((F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 4, 1).otherwise(0)).alias("fy")).distinct()
    rows = d.select("fy", F.explode(F.array(*map(F.lit, (1, 4, 7, 10)))).alias("fy_start"))
    w = P.fiscal_window("fy", F.col("fy_start"))
    return rows.select("fy", "fy_start", w["start"].alias("window_start"), w["end"].alias("window_end"))


@query(f"""
WITH d AS (SELECT DISTINCT {_FY} AS fy, y, {_QSTART} AS qs FROM ({_DATES})),
p AS (SELECT DISTINCT 'FY' || fy AS name, make_date(fy - 1, 4, 1) AS s, make_date(fy, 3, 31) AS e FROM d
  UNION SELECT DISTINCT 'CY' || y, make_date(y, 1, 1), make_date(y, 12, 31) FROM d
  UNION SELECT DISTINCT 'March 31, ' || fy, make_date(fy, 3, 31), make_date(fy, 3, 31) FROM d)
SELECT a.name AS a, b.name AS b, CASE WHEN a.s = b.s AND a.e = b.e THEN 'EQUAL'
  WHEN a.s = a.e AND b.s <> b.e AND a.s = b.e THEN 'BOUNDARY' WHEN b.s = b.e AND a.s <> a.e AND b.s = a.e THEN 'BOUNDARY'
  WHEN a.s <= b.s AND a.e >= b.e THEN 'A_CONTAINS_B' WHEN b.s <= a.s AND b.e >= a.e THEN 'B_CONTAINS_A'
  WHEN a.e < b.s OR b.e < a.s THEN 'DISJOINT' ELSE 'OVERLAP' END AS relation,
  (year(b.e) * 12 + month(b.e)) - (year(b.s) * 12 + month(b.s)) + 1 AS months FROM p a, p b""")
def period_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two of the fiscal years, calendar years and closing days that orders fall into: as many as there are years."""
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    fy = (y + F.when(m >= 4, 1).otherwise(0)).cast("string")
    names = table(spark, sf_dir, "orders").select(F.explode(F.array(F.concat(F.lit("FY"), fy), F.concat(F.lit("CY"), y.cast("string")), F.concat(F.lit("March 31, "), fy))).alias("name")).distinct()
    p = names.select("name", P.parse_period("name").alias("p"))
    a, b = (p.select(F.col("name").alias(n), F.col("p").alias(f"p{n}")) for n in "ab")
    # Every period's own list of all names: three for each year that has orders, so the list stays small.
    b = b.agg(F.collect_list(F.struct("b", "pb")).alias("others"))
    return a.crossJoin(F.broadcast(b)).select("a", "pa", F.inline("others")).select("a", "b", P.compare_periods("pa", "pb").alias("relation"), P.period_months("pb").alias("months"))


# ---- text ----------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, lower(substr(s_name, 1, 8)) AS first_word, CASE WHEN s_suppkey % 2 = 0 THEN substr(s_name, 10) || ' supplier' ELSE substr(s_name, 10) || ' supplier' END AS person, 'supplier ' || substr(s_name, 10) AS org, 'supplier ' || substr(s_name, 10) AS subject FROM supplier")
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    number = F.substring("s_name", 10, 100)
    person = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Mr. SUPPLIER, "), number)).otherwise(F.concat(number, F.lit(" Supplier (Shri)")))
    return s.select(
        "s_suppkey", T.normalize_text(F.substring("s_name", 1, 8)).alias("first_word"), T.normalize_person_name(person).alias("person"),
        T.normalize_org_name(F.concat("s_name", F.lit(" Holdings Pvt. Ltd."))).alias("org"), T.normalize_subject(F.concat(F.lit("Dr. "), "s_name", F.lit(" Limited"))).alias("subject"),
    )


@query("SELECT s_suppkey, 'plot ' || s_suppkey || ' mahatma gandhi road sector ' || s_nationkey || ' bengaluru' AS address, 'resigned' AS state, 'bengaluru' AS hinted FROM supplier")
def normalize_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    return s.select(
        "s_suppkey", T.normalize_address(F.concat(F.lit("Plot No. "), key, F.lit(", MG Rd., Sec-"), nation, F.lit(", Bangalore"))).alias("address"),
        T.normalize_categorical(F.concat(F.lit("Resigned w.e.f. "), key)).alias("state"), T.normalize_by_hint(F.lit("Bangalore"), F.concat(F.lit("Registered office of "), "s_name")).alias("hinted"),
    )


@query("""
WITH p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS a, lead(p_name || ' ' || lower(p_type)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
t AS (SELECT p_partkey, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p WHERE b IS NOT NULL)
SELECT p_partkey, CAST(floor(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) * 10000 + 0.5) AS BIGINT) AS dice FROM t""")
def dice_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("a", F.concat_ws(" ", "p_name", "p_type"))
    p = p.withColumn("b", F.lead("a").over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("b is not null")
    return p.select("p_partkey", F.floor(T.text_similarity("a", "b") * 10000 + 0.5).cast("long").alias("dice"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS c FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, CAST(floor(c * 100000 + 0.5) AS BIGINT) AS score FROM r WHERE rank <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of a stated set of queries (ids divisible by 100) among all: the shortlist of the registry."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("vector").alias("namespace"), F.col("vec_id").alias("normal"), "embedding")
    found = registry.shortlist(e.filter("normal % 100 = 0"), e, least=None)
    return found.select(F.col("normal").alias("query_id"), F.col("entry").alias("vec_id"), "rank", F.floor(F.col("score") * 100000 + 0.5).cast("long").alias("score"))


# ---- segmentation --------------------------------------------------------------------------------------------------

_LINES = r"SELECT doc_id, source, trim(x, ' ' || chr(9) || chr(13)) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))


@query(rf"""
WITH l AS ({_LINES}), w AS (SELECT doc_id, line, regexp_split_to_array(line, '\s+') AS words, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM l WHERE line <> '' AND length(line) <= 90)
SELECT doc_id, count(*) AS headings FROM w WHERE NOT regexp_matches(line, '[.;]$') AND len(words) <= 12 AND length(letters) >= 3
  AND (letters = upper(letters) OR regexp_matches(line, '^\d+(\.\d+)*[.)]?\s+\S') OR len(list_filter(words, lambda x: regexp_matches(x, '^[A-Z]'))) / len(words) >= 0.6) GROUP BY doc_id""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).filter(S.is_heading("line")).groupBy("doc_id").agg(F.count("*").alias("headings"))


_ASCII = lambda words: r"(^|[^A-Za-z0-9_])(" + "|".join(words).replace("'", "''") + r")([^A-Za-z0-9_]|$)"


@query(f"SELECT doc_id, regexp_matches(lower(text), '[0-9]') OR regexp_matches(lower(text), '{_ASCII(S.SIGNAL_WORDS)}') OR regexp_matches(lower(text), '{_ASCII(S.DATE_WORDS)}') AS salient FROM documents")
def salient_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", S.is_salient("text").alias("salient"))


@query(rf"""
WITH l AS ({_LINES}) SELECT doc_id, count(*) AS captions FROM l WHERE regexp_matches(lower(line), '(₹|rs\.?|inr|usd|us\$|\$|€|£)\s*(in\s+)?(crores?|lakhs?|lacs?|millions?|billions?|thousands?|mn|bn|cr)([^a-z0-9_]|$)')
  OR (length(line) <= 100 AND regexp_matches(lower(line), '{_ASCII(S.BASIS_WORDS)}')) GROUP BY doc_id""")
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.scale_caption("line").isNotNull() | S.basis_caption("line").isNotNull()
    return _lines(spark, sf_dir).filter(found).groupBy("doc_id").agg(F.count("*").alias("captions"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source."""
    return texts(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page_number"), "text")


@query(r"""
WITH p AS (SELECT source, doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS lines FROM documents),
e AS (SELECT DISTINCT source, doc_id, unnest(lines[1:3] || lines[-3:]) AS line FROM p),
n AS (SELECT source, count(*) AS n FROM p GROUP BY source HAVING count(*) >= 5)
SELECT e.source AS document_id, line, count(*) AS pages FROM e JOIN n USING (source) WHERE length(line) BETWEEN 8 AND 120 GROUP BY e.source, line, n HAVING count(*) >= greatest(3, floor(n * 0.5))""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_headers(_pages(spark, sf_dir))


@query()
def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment(_pages(spark, sf_dir))


# ---- grounding -----------------------------------------------------------------------------------------------------

_FORMS = ["exact", "whitespace", "caseless", "folded", "fabricated"]


def _closing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their last line of some length."""
    return texts(spark, sf_dir).select("doc_id", "text", "source", F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= 12), F.lit(-1)).alias("line")).filter("line is not null")


def _made_up(line: Column) -> Column:
    return F.concat(F.lit("zzqx "), line, F.lit(" qqzx zzqq"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote per document, from its second line on where there is one: as it is, spaced out, in capitals, punctuated, made up."""
    d = _closing_lines(spark, sf_dir)
    line, form = F.trim("line"), F.pmod(F.col("doc_id"), F.lit(5)).cast("int")
    quotes = [line, F.regexp_replace(line, " ", "   "), F.upper(line), F.regexp_replace(line, " ", " - "), _made_up(line)]
    return d.select("doc_id", "text", form.alias("form"), F.element_at(F.array(*quotes), form + 1).alias("quote"))


@query()
def ground_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, method and place of every document's quote; tests hold the places against the text."""
    rows = _quotes(spark, sf_dir).select("doc_id", "form", grounding.ground("text", "quote", F.lit("text"), "quote").alias("g"))
    return rows.select("doc_id", F.element_at(F.array(*map(F.lit, _FORMS)), F.col("form") + 1).alias("form"), "g.status", "g.method", F.col("g.start").alias("char_start"), F.col("g.end").alias("char_end"))


@query("""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1] AS line FROM documents)
SELECT doc_id, instr(text, trim(line)) - 1 AS char_start, instr(text, trim(line)) - 1 + length(trim(line)) AS char_end FROM l WHERE line IS NOT NULL""")
def ground_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the unaltered quote of every document that has one is; the other forms are in ground_quotes."""
    return ground_exact_all(spark, sf_dir)


@query("""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1] AS line FROM documents)
SELECT doc_id, instr(text, trim(line)) - 1 AS char_start, instr(text, trim(line)) - 1 + length(trim(line)) AS char_end FROM l WHERE line IS NOT NULL""")
def ground_exact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the unaltered quote of every document that has one is."""
    rows = _closing_lines(spark, sf_dir).select("doc_id", grounding.locate("text", F.trim("line")).alias("l"))
    return rows.select("doc_id", F.col("l.start").alias("char_start"), F.col("l.end").alias("char_end"))


def derived_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a folder, derived anew by each query."""
    return star.facts(spark, sf_dir)


# ---- claims, blocks, verdicts --------------------------------------------------------------------------------------

_WITH = "WITH " + star.FACTS_SQL
_BLOCKS = ", blocks AS (SELECT p, s, count(*) AS members FROM facts GROUP BY p, s HAVING count(*) > 1)"
_PAIRS = (
    _BLOCKS
    + """, pairs AS (
  SELECT a.p, a.s, a.seq AS a_seq, b.seq AS b_seq, a.doc AS a_doc, b.doc AS b_doc, a.value AS av, b.value AS bv, a.unit AS au, b.unit AS bu, a.basis AS ab, b.basis AS bb, a.kind, a.state AS ast, b.state AS bst,
         a.ps AS aps, a.pe AS ape, b.ps AS bps, b.pe AS bpe, a.published AS apub, b.published AS bpub, row_number() OVER (PARTITION BY a.p, a.s ORDER BY a.seq, b.seq) AS nth
  FROM facts a JOIN facts b ON a.p = b.p AND a.s = b.s AND a.seq < b.seq JOIN blocks k ON k.p = a.p AND k.s = a.s
  WHERE members <= 40 OR a.doc <> b.doc), capped AS (SELECT * FROM pairs WHERE nth <= 1200)"""
)
_JUDGED = (
    _PAIRS
    + """, axes AS (
  SELECT *, CASE WHEN kind = 'categorical' THEN CASE WHEN ast = bst THEN 'SAME' ELSE 'EXCLUSIVE' END WHEN au <> bu THEN 'UNKNOWN'
              WHEN abs(av - bv) / greatest(abs(av), abs(bv)) <= 0.005 THEN 'SAME' ELSE 'DIFFERENT' END AS v,
    CASE WHEN aps = bps AND ape = bpe THEN 'EQUAL' WHEN aps = ape AND bps <> bpe AND aps = bpe THEN 'BOUNDARY' WHEN bps = bpe AND aps <> ape AND bps = ape THEN 'BOUNDARY'
         WHEN aps <= bps AND ape >= bpe THEN 'A_CONTAINS_B' WHEN bps <= aps AND bpe >= ape THEN 'B_CONTAINS_A' WHEN ape < bps OR bpe < aps THEN 'DISJOINT' ELSE 'OVERLAP' END AS r,
    ab = bb OR ab = '' OR bb = '' AS scoped FROM capped),
ruled AS (
  SELECT *, CASE WHEN v = 'UNKNOWN' THEN 'R0-units' WHEN v = 'SAME' AND r = 'EQUAL' AND scoped THEN 'R1' WHEN v = 'SAME' AND r = 'BOUNDARY' AND scoped THEN 'R1b-boundary-period' WHEN v = 'SAME' THEN 'R2'
    WHEN r = 'DISJOINT' THEN 'R4-different-times' WHEN r <> 'EQUAL' THEN 'R4-period' WHEN NOT scoped THEN 'R4-entityScope'
    WHEN v = 'EXCLUSIVE' THEN 'R6-state-changed' WHEN a_doc = b_doc THEN 'R7b-same-page-breakdown' ELSE 'R8' END AS rule_id FROM axes),
judged AS (
  SELECT *, CASE rule_id WHEN 'R1' THEN 'CORROBORATES' WHEN 'R1b-boundary-period' THEN 'CORROBORATES' WHEN 'R8' THEN 'CONTRADICTS' WHEN 'R6-state-changed' THEN 'SUPERSEDED'
      WHEN 'R0-units' THEN 'RECONCILED' WHEN 'R4-period' THEN 'RECONCILED' WHEN 'R4-entityScope' THEN 'RECONCILED' ELSE 'UNRELATED' END AS verdict,
    CASE rule_id WHEN 'R0-units' THEN 'unit' WHEN 'R1b-boundary-period' THEN 'period' WHEN 'R2' THEN CASE WHEN r <> 'EQUAL' THEN 'period' ELSE 'entityScope' END
      WHEN 'R4-different-times' THEN 'period' WHEN 'R4-period' THEN 'period' WHEN 'R4-entityScope' THEN 'entityScope' WHEN 'R6-state-changed' THEN 'vintage' WHEN 'R7b-same-page-breakdown' THEN 'predicate' END AS axis,
    floor(CASE rule_id WHEN 'R0-units' THEN 0.6 WHEN 'R1' THEN 0.95 WHEN 'R1b-boundary-period' THEN 0.75 WHEN 'R2' THEN 0.3 WHEN 'R4-different-times' THEN 0.2 WHEN 'R4-period' THEN 0.85 WHEN 'R4-entityScope' THEN 0.85
      WHEN 'R6-state-changed' THEN 0.85 WHEN 'R7b-same-page-breakdown' THEN 0.25 ELSE CASE WHEN apub = bpub THEN 0.9 ELSE 0.7 END END * (0.6 + 0.4 * 0.9) * 100 + 0.5) / 100 AS confidence FROM ruled)"""
)


@query(_WITH + "SELECT doc AS document_id, p AS canonical_predicate_id, count(*) AS n, count(DISTINCT s) AS subjects, CAST(sum(CAST(floor(value / 1000 + 0.5) AS DECIMAL(38,0))) AS DECIMAL(38,0)) AS thousands, CAST(min(ps) AS VARCHAR) AS first_day, CAST(max(pe) AS VARCHAR) AS last_day FROM facts GROUP BY doc, p")
def star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star.facts(spark, sf_dir)
    return f.groupBy("document_id", "canonical_predicate_id").agg(
        F.count("*").alias("n"), F.countDistinct("canonical_subject_id").alias("subjects"), F.sum(F.floor(F.col("normalized_number") / 1000 + 0.5).cast("decimal(38,0)")).cast("decimal(38,0)").alias("thousands"),
        F.min("period.start").alias("first_day"), F.max("period.end").alias("last_day"),
    )


@query(_WITH + _BLOCKS + "SELECT p AS canonical_predicate_id, s AS canonical_subject_id, members FROM blocks")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocks(derived_facts(spark, sf_dir))


@query(_WITH + _PAIRS + "SELECT p AS canonical_predicate_id, s AS canonical_subject_id, count(*) AS pairs, CAST(sum(a_seq % 1000003 + b_seq % 1000033) AS BIGINT) AS seqs FROM pairs GROUP BY p, s")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_sums(blocking.block_pairs(derived_facts(spark, sf_dir), cap=None))


@query(_WITH + _PAIRS + "SELECT p AS canonical_predicate_id, s AS canonical_subject_id, count(*) AS pairs, CAST(sum(a_seq % 1000003 + b_seq % 1000033) AS BIGINT) AS seqs FROM capped GROUP BY p, s")
def capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the rule of the operator itself, and exact."""
    return _pair_sums(blocking.block_pairs(derived_facts(spark, sf_dir)))


def _pair_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*blocking.KEY).agg(F.count("*").alias("pairs"), F.sum(F.col("a_seq") % 1000003 + F.col("b_seq") % 1000033).alias("seqs"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pairs(derived_facts(spark, sf_dir), star.edges(spark))


def _relations(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    return relations(derived_facts(spark, sf_dir) if facts is None else facts, star.edges(spark))


@query(_WITH + _JUDGED + "SELECT verdict, rule_id, axis, confidence, count(*) AS n FROM judged GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reported figures agree, conflict, or only appear to?"""
    return _judged(spark, sf_dir).groupBy("j.decision.verdict", "j.decision.rule_id", "j.decision.axis", "j.decision.confidence").agg(F.count("*").alias("n"))


@query(_WITH + _JUDGED + "SELECT v AS value_relation, r = 'EQUAL' AS period_aligned, scoped AS scope_aligned, au IS NOT DISTINCT FROM bu AS unit_aligned, apub = bpub AS vintage_aligned, count(*) AS n FROM judged GROUP BY ALL")
def axis_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda k: F.col("j.deltas")[k]["aligned"]
    rows = _judged(spark, sf_dir).select(F.col("j.value.relation").alias("value_relation"), d(0).alias("period_aligned"), d(1).alias("scope_aligned"), d(3).alias("unit_aligned"), d(5).alias("vintage_aligned"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


_KEPT = ", kept AS (SELECT *, 'rel_' || a_seq || '_' || b_seq AS id FROM judged WHERE verdict <> 'UNRELATED')"


@query(_WITH + _JUDGED + _KEPT + "SELECT id, verdict, rule_id, confidence, p AS canonical_predicate_id FROM kept")
def all_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir).select("id", "verdict", "rule_id", "confidence", "canonical_predicate_id")


@query(_WITH + _JUDGED + _KEPT + "SELECT id, verdict, confidence FROM kept ORDER BY confidence DESC, id LIMIT 200")
def relation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_relations(_relations(spark, sf_dir)).select("id", "verdict", "confidence")


@query(_WITH + _JUDGED + _KEPT + ", b AS (SELECT verdict, min(id) AS id, confidence FROM kept k WHERE a_doc <> b_doc GROUP BY verdict, confidence) SELECT verdict, id, confidence, true AS cross FROM b QUALIFY row_number() OVER (PARTITION BY verdict ORDER BY confidence DESC, id) = 1")
def best_case_per_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir)
    return store.best_per_verdict(_relations(spark, sf_dir, f), f)


@query(_WITH + _JUDGED + _KEPT + ", ends AS (SELECT a_seq AS seq FROM kept UNION ALL SELECT b_seq FROM kept), n AS (SELECT seq, count(*) AS relations FROM ends GROUP BY seq) SELECT 'fact_' || f.seq AS id, doc AS document_id, coalesce(relations, 0) AS relations FROM facts f LEFT JOIN n USING (seq)")
def fact_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir)
    pages = f.select("document_id", "page_number").distinct().withColumn("text", F.lit(""))
    return store.fact_details(f, pages, _relations(spark, sf_dir, f)).select("id", "document_id", "relations")


@query(_WITH + "SELECT 'fact_' || seq AS id, s AS canonical_subject_id FROM facts WHERE doc = 'annual' AND s LIKE '%nation 1%' ORDER BY seq LIMIT 50 OFFSET 10")
def facts_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir).withColumn("claim", F.concat_ws(" ", "subject", "predicate"))
    return store.list_facts(f, document_id="annual", q="NATION_1%", limit=50, offset=10).select("id", "canonical_subject_id")


@query(_WITH + _JUDGED + _KEPT + "SELECT count(*) AS relations, (SELECT count(*) FROM facts WHERE doc <> 'typo') AS facts FROM kept WHERE a_doc <> 'typo' AND b_doc <> 'typo'")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir)
    left = store.delete_document({"facts": f, "relations": _relations(spark, sf_dir, f)}, "typo")
    return left["relations"].agg(F.count("*").alias("relations")).join(left["facts"].agg(F.count("*").alias("facts")))


@query(_WITH + _JUDGED + _KEPT + "SELECT CASE WHEN verdict = 'CONTRADICTS' THEN 'REVIEWED' ELSE verdict END AS verdict, count(*) AS n FROM kept GROUP BY ALL")
def upsert_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _relations(spark, sf_dir).select("fact_a_id", "fact_b_id", "verdict", "confidence")
    new = rel.filter("verdict = 'CONTRADICTS'").withColumn("verdict", F.lit("REVIEWED"))
    return store.relation_counts(store.upsert(rel, new, ["fact_a_id", "fact_b_id"]))


@query(_WITH + "SELECT doc AS document_id, count(*) AS claims, count(*) * 2 AS doubled FROM facts GROUP BY doc")
def dedupe_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim twice, once with other case and spaces: one of the two stays."""
    c = star.claims(spark, sf_dir).withColumn("claim_pos", F.lit(0))
    again = c.withColumn("subject", F.concat(F.lit(" "), F.upper("subject"))).withColumn("predicate", F.lower("predicate")).withColumn("claim_pos", F.lit(1))
    both = c.unionByName(again)
    kept = ingest.dedupe(both, ["claim_pos", "fact_seq"]).groupBy("document_id").agg(F.count_if(F.col("claim_pos") == 0).alias("claims"))
    return kept.join(both.groupBy("document_id").agg(F.count("*").alias("doubled")), "document_id")


@query("""
WITH r AS (SELECT 'src' || (doc_id % 7) AS document_id, doc_id % 3 <> 0 AND doc_id % 7 <> 6 AS hit FROM documents)
SELECT document_id, count(*) AS units, count(*) FILTER (hit) AS answered, CASE WHEN count(*) FILTER (hit) / count(*) < 0.5 THEN 'skip' WHEN count(*) FILTER (hit) / count(*) < 0.99 THEN 'partial' ELSE 'full' END AS state FROM r GROUP BY document_id""")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("document_id"), responses.response_key(F.lit("v2"), "extract", F.col("doc_id").cast("string")).alias("key"))
    known = d.filter("doc_id % 3 <> 0 and doc_id % 7 <> 6").select("key", F.lit("m1").alias("model"))
    known = known.union(known.withColumn("model", F.lit("m2")))
    return responses.coverage(d.select("document_id", "key"), known).select("document_id", "units", "answered", "state")


@query("SELECT source AS document_id, count(*) AS kept, count(*) AS rejected, CAST(0.5 AS DOUBLE) AS rate FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1] AS line FROM documents) WHERE line IS NOT NULL GROUP BY source")
def quarantine_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and made-up quotes of every document that has one, grounded and counted by source, with the share kept."""
    rows = quarantine_rate_all(spark, sf_dir)
    return rows.withColumn("rate", F.col("kept") / (F.col("kept") + F.col("rejected")))


@query("SELECT source AS document_id, count(*) AS kept, count(*) AS rejected FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1] AS line FROM documents) WHERE line IS NOT NULL GROUP BY source")
def quarantine_rate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact and a made-up quote of every document that has one, grounded and counted by source."""
    quotes = F.array(*[F.struct(q.alias("quote")) for q in (F.trim("line"), _made_up(F.trim("line")))]).alias("claims")
    rows = locating.hits(_closing_lines(spark, sf_dir).select(F.col("source").alias("document_id"), "text", quotes), "text", "claims")
    # Written once: kept and rejected quotes are read apart.
    rows = save(rows.select("document_id", F.explode(F.transform("hits", lambda hit: hit.isNull())).alias("lost")), "located")
    return store.grounding_rate(rows.filter("not lost"), rows.filter("lost")).select("document_id", "kept", "rejected")


# ---- registry ------------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers and parts as labels: subjects in three spellings, measures with long and near-equal names."""
    s = table(spark, sf_dir, "supplier").select(F.lit("subject").alias("namespace"), F.explode(F.array(F.struct(F.col("s_name").alias("label"), (F.col("s_suppkey") * 3).alias("seq")), F.struct(F.concat("s_name", F.lit(" Ltd.")).alias("label"), (F.col("s_suppkey") * 3 + 1).alias("seq")), F.struct(F.upper("s_name").alias("label"), (F.col("s_suppkey") * 3 + 2).alias("seq")))).alias("x")).select("namespace", "x.label", F.lit("").alias("hint"), "x.seq")
    words = F.concat_ws(" ", F.lit("average monthly retail price of every"), "p_name", F.lower("p_type"), F.when(F.col("p_partkey") % 2 == 0, "(net)"))
    p = table(spark, sf_dir, "part").select(F.lit("predicate").alias("namespace"), words.alias("label"), F.lit("").alias("hint"), (F.col("p_partkey") + 10_000_000).alias("seq"))
    return s.unionByName(p)


@query("""
SELECT 'subject' AS namespace, lower(replace(s_name, '#', ' ')) AS normal, CAST(3 AS BIGINT) AS occurrences, s_name AS canonical FROM supplier
UNION ALL SELECT 'predicate', 'average monthly retail price of every ' || p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' net' ELSE '' END, count(*),
  'average monthly retail price of every ' || p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' (net)' ELSE '' END FROM part GROUP BY ALL""")
def registry_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.forms(_labels(spark, sf_dir)).select("namespace", "normal", "occurrences", "canonical")


@query("""
WITH f AS (SELECT DISTINCT 'average monthly retail price of every ' || p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' net' ELSE '' END AS n, p_partkey FROM part),
g AS (SELECT n, min(p_partkey) AS seq, list_distinct(string_split(n, ' ')) AS w FROM f GROUP BY n)
SELECT a.n AS a, b.n AS b, CAST(floor(2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) * 10000 + 0.5) AS BIGINT) AS dice FROM g a JOIN g b ON a.seq < b.seq WHERE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) >= 0.92""")
def registry_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = registry.lexical_pairs(registry.forms(_labels(spark, sf_dir).filter("namespace = 'predicate'")))
    return pairs.select("a", "b", F.floor(F.col("score") * 10000 + 0.5).cast("long").alias("dice"))


#: Every label's entry, one label after the other: it joins the nearest entry so far, else it becomes one.
SETTLED = """
WITH RECURSIVE o AS MATERIALIZED (
  SELECT n, occurrences, list_distinct(string_split(n, ' ')) AS w, row_number() OVER (ORDER BY seq) AS i FROM (
    SELECT 'average monthly retail price of every ' || p_name || ' ' || lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' net' ELSE '' END AS n, min(p_partkey) AS seq, count(*) AS occurrences FROM part GROUP BY ALL)),
near AS MATERIALIZED (
  SELECT b.i, list(struct_pack(s := -2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)), a := a.i)) AS c
  FROM o a JOIN o b ON a.i < b.i WHERE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) >= 0.92 GROUP BY b.i),
fold(i, entries, joined) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT i, CASE WHEN best IS NULL THEN list_append(entries, i) ELSE entries END, best FROM (
    SELECT o.i, f.entries, list_sort(list_filter(n.c, lambda x: list_contains(f.entries, x.a)))[1].a AS best FROM fold f JOIN o ON o.i = f.i + 1 LEFT JOIN near n ON n.i = o.i)),
settled AS (
  SELECT 'predicate' AS namespace, o.n AS normal, coalesce(e.n, o.n) AS entry, CASE WHEN joined IS NULL THEN 'minted' ELSE 'lexical' END AS tier, o.occurrences
  FROM fold JOIN o USING (i) LEFT JOIN o e ON e.i = joined
  UNION ALL SELECT 'subject', lower(replace(s_name, '#', ' ')), lower(replace(s_name, '#', ' ')), 'minted', CAST(3 AS BIGINT) FROM supplier)
"""


@query(SETTLED + "SELECT namespace, normal, entry, tier FROM settled")
def registry_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled in the order of mention; tests hold it against a sequential loop."""
    _, members, _ = registry.canonicalize(_labels(spark, sf_dir))
    return members
