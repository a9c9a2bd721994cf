"""Registered queries of single operators and of the read model, beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..functions.columns import squash
from ..operators import grounding, ingest, registry, store
from ..operators import segmentation as S
from ..operators.reasoning import compare_dates, compare_numbers, compare_states, context
from ..sources import files, responses, star
from . import queries as core
from .queries import _JUDGED, _KEPT, _WITH, derived_facts, query, table
from .reconcile import canonicalized, judged_pairs

# ---- numbers, periods, text ----------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || ' crore INR' WHEN 1 THEN 'Rs. ' || o_orderkey || ' Cr' WHEN 2 THEN o_orderkey || ' parcels' ELSE '$' || o_orderkey || ' million' END AS shown,
       CASE WHEN o_orderkey % 4 = 3 THEN 'USD' WHEN o_orderkey % 4 = 2 THEN 'parcels' ELSE 'INR' END AS unit, o_orderkey % 4 <> 2 AND o_orderkey % 4 <> 3 AS in_rupees FROM orders""")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed values with the scale and unit that they don't show, and whether their units are comparable with rupees."""
    form, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") if x is None or isinstance(x, str) else x for x in v]), (form + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(key, F.concat(F.lit("Rs.  "), key, F.lit(" Cr")), key, F.concat(F.lit("$"), key)).alias("raw"), pick("crore", "crore", None, "million").alias("scale"),
        pick(None, None, "parcels", None).alias("unit"), pick("INR", "INR", None, "USD").alias("currency"),
    )
    number = N.normalize_number(F.lit(None).cast("double"), "raw", "unit", "scale", "currency")
    rows = o.select("o_orderkey", N.value_text(F.lit("number"), "raw", "scale", "unit", "currency").alias("shown"), number["unit"].alias("unit"))
    return rows.withColumn("in_rupees", N.units_comparable("unit", F.lit("INR")))


@query("""
WITH v AS (SELECT c_custkey, CAST(floor(abs(c_acctbal) * 100 + 0.5) AS BIGINT) * 1000 * (c_custkey % 7 + 1) AS n, c_acctbal < 0 AS neg FROM customer),
s AS (SELECT *, CASE WHEN n >= 10000000 THEN 10000000 WHEN n >= 100000 THEN 100000 ELSE 1 END AS unit FROM v),
c AS (SELECT *, CAST(floor(n / unit * 100 + 0.5) AS BIGINT) AS h FROM s)
SELECT c_custkey, CASE WHEN neg AND h > 0 THEN '₹-' ELSE '₹' END ||
  CASE WHEN h // 100 >= 1000 THEN regexp_replace(left(CAST(h // 100 AS VARCHAR), -3), '(\\d)(?:(\\d\\d))?$', '\\1\\2') || ',' || right(CAST(h // 100 AS VARCHAR), 3) ELSE CAST(h // 100 AS VARCHAR) END ||
  CASE WHEN h % 100 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(h % 100 AS VARCHAR), 2, '0'), '0') END || CASE unit WHEN 10000000 THEN ' crore' WHEN 100000 THEN ' lakh' ELSE '' END AS shown FROM c""")
def format_rupees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances from paise to thousands of crores, in rupees."""
    cents = F.floor(F.abs("c_acctbal") * 100 + 0.5)
    value = F.when(F.col("c_acctbal") < 0, -1).otherwise(1) * cents * 1000 * (F.col("c_custkey") % 7 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", N.format_normalized(value.cast("double"), F.lit("INR")).alias("shown"))


@query("""
SELECT DISTINCT 'FY' || y || ' [' || (y - 1) || '-04-01 → ' || y || '-03-31]' AS label, CAST(12 AS INT) AS months FROM (SELECT year(o_orderdate) AS y FROM orders)
UNION ALL SELECT 'unscoped', NULL""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").select(F.concat(F.lit(" FY"), F.year("o_orderdate").cast("string")).alias("raw")).distinct()
    rows = years.union(spark.createDataFrame([("no period",)], "raw string")).select(P.parse_period("raw").alias("p"))
    return rows.select(P.period_label("p").alias("label"), P.period_months("p").alias("months"))


@query("""SELECT doc_id, upper(source[1]) || source[2:] || ' Report ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Title ' || doc_id END AS own_title,
  CASE WHEN doc_id % 2 = 0 THEN '2024-05-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS published_at FROM documents""")
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from file names and from document properties, and days from date properties."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    name = F.concat(F.lit("/data/up_a1b2c3_2024-"), "source", F.lit("_report-"), key, F.lit(".pdf"))
    own = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" Title "), key, F.lit("\t")))
    created = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D:202405"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("103000+05'30'"))).otherwise("May 2024")
    rows = d.select("doc_id", T.title_from_filename(name).alias("title"), files.metadata(own, created).alias("m"))
    return rows.select("doc_id", "title", F.col("m.title").alias("own_title"), "m.published_at")


# ---- answers, pages ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' WHEN doc_id % 3 = 1 THEN 'other' END AS model, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id WHEN doc_id % 3 = 1 THEN 'o' || doc_id END AS value FROM documents""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of the preferred model where it has one, of another where not."""
    d = table(spark, sf_dir, "documents").select("doc_id", responses.response_key(F.lit("v2"), "extract", F.col("doc_id").cast("string")).alias("key"))
    known = lambda model, where: d.filter(where).select("key", F.lit(model).alias("model"), F.concat(F.lit(model[0]), F.col("doc_id").cast("string")).alias("value"), F.lit("2024-01-01").alias("created_at"))
    answers = known("first", "doc_id % 3 = 0").union(known("other", "doc_id % 3 <> 2"))
    return responses.answered(d, answers, ["first", "second"]).select("doc_id", "model", "value")


_HEADED = "coalesce(source, '') || ' Annual Report' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '(Rs. in crore)' ELSE 'Amounts in INR lakhs' END || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Consolidated' ELSE 'Standalone' END || ' results' || chr(10)"


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their source, each below a running header and its scale and basis captions."""
    head = [F.concat(F.coalesce("source", F.lit("")), F.lit(" Annual Report")), F.when(F.col("doc_id") % 2 == 0, "(Rs. in crore)").otherwise("Amounts in INR lakhs"), F.concat(F.when(F.col("doc_id") % 3 == 0, "Consolidated").otherwise("Standalone"), F.lit(" results"))]
    text = F.concat_ws("\n", *head, F.coalesce("text", F.lit("")))
    return core.texts(spark, sf_dir).select(F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("page_number"), text.alias("text"))


@query(f"""
WITH p AS (SELECT source, doc_id, {_HEADED} || coalesce(text, '') AS text FROM documents),
l AS (SELECT source, doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS lines FROM p),
e AS (SELECT DISTINCT source, doc_id, unnest(lines[1:3] || lines[-3:]) AS line FROM l),
n AS (SELECT source, count(*) AS n FROM p GROUP BY source HAVING count(*) >= 5)
SELECT e.source AS document_id, line, count(*) AS pages FROM e JOIN n USING (source) WHERE length(line) BETWEEN 8 AND 120 GROUP BY e.source, line, n HAVING count(*) >= greatest(3, floor(n * 0.5))""")
def running_headers_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_headers(_headed(spark, sf_dir))


@query("""SELECT doc_id AS page_number, CASE WHEN doc_id % 2 = 0 THEN 'Rs. in crore' ELSE 'Amounts in INR lakhs' END AS scales, CASE WHEN doc_id % 3 = 0 THEN 'consolidated' ELSE 'standalone' END AS bases FROM documents""")
def captions_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first different scale and basis captions among the first lines of each page, each line taken twice in two cases."""
    lines = F.slice(F.split("text", "\n"), 1, 3)
    twice = F.concat(lines, F.transform(lines, F.upper))
    own = lambda f: F.array_join(S.first_unique(F.filter(F.transform(twice, f), lambda c: c.isNotNull()), 2), "|")
    return _headed(spark, sf_dir).select(F.col("page_number").cast("long").alias("page_number"), own(S.scale_caption).alias("scales"), own(S.basis_caption).alias("bases"))


@query("""SELECT doc_id, 'DOCUMENT: ' || source || chr(10) || 'PAGE: ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'SECTION CONTEXT: Part > Section ' || doc_id ELSE '' END || chr(10) || 'SCOPE CAPTIONS ON THIS PAGE: Rs. in crore | consolidated' || chr(10) || chr(10) || 'PAGE EXCERPT:' || chr(10) || text AS prompt FROM documents""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Part"), F.concat(F.lit("Section "), F.col("doc_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    captions = F.array(F.lit("Rs. in crore"), F.lit("consolidated"))
    return table(spark, sf_dir, "documents").select("doc_id", S.render_prompt("source", "doc_id", headings, captions, "text").alias("prompt"))


# ---- grounding -----------------------------------------------------------------------------------------------------

_LINE = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1]"
_NONE = ", ".join(f"'{w}'" for w in grounding.NOT_IDENTIFYING)


@query(rf"""
WITH l AS (SELECT doc_id, text, {_LINE} AS line FROM documents), q AS (SELECT doc_id, text, trim(line) AS quote FROM l WHERE line IS NOT NULL),
p AS (SELECT *, instr(text, quote) - 1 AS s FROM q),
w AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE s - coalesce(nullif(instr(reverse(left(text, s)), chr(10)), 0) - 1, s) END AS b,
        CASE WHEN instr(text[s + length(quote) + 1:], chr(10)) > 0 THEN s + length(quote) + instr(text[s + length(quote) + 1:], chr(10)) - 1 ELSE length(text) END AS e FROM p)
SELECT doc_id, claim, CASE WHEN claim = 'empty' THEN 'page_not_found' WHEN claim = 'made up' THEN 'quote_not_found'
    WHEN len(list_filter(regexp_extract_all(lower(text[b + 1:e]), '[a-z]{{3,}}'), lambda x: x NOT IN ({_NONE}))) = 0 THEN 'quote_lacks_context' WHEN claim = 'other value' THEN 'value_not_in_quote' ELSE 'grounded' END AS status
FROM w, (SELECT unnest(['exact', 'other value', 'made up', 'empty']) AS claim)""")
def ground_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims of every document that has a quote: its own words, another value, a made-up quote, a page without text."""
    line = F.trim("line")
    claim = lambda name, page, quote, kind, raw: F.struct(F.lit(name).alias("claim"), page.alias("page"), quote.alias("quote"), F.lit(kind).alias("kind"), raw.alias("raw"))
    d = core._closing_lines(spark, sf_dir)
    rows = d.select("doc_id", F.explode(F.array(
        claim("exact", F.col("text"), line, "number", F.lit(None).cast("string")), claim("other value", F.col("text"), line, "number", F.lit("98,765,432,198")),
        claim("made up", F.col("text"), core._made_up(line), "text", line), claim("empty", F.lit(""), line, "text", line),
    )).alias("c")).select("doc_id", "c.*")
    # The quote's own words are its value where the kind is text.
    kind = F.when(F.col("claim") == "exact", "text").otherwise(F.col("kind"))
    raw = F.when(F.col("claim") == "exact", F.col("quote")).otherwise(F.col("raw"))
    return rows.select("doc_id", "claim", grounding.ground("page", "quote", kind, raw)["status"].alias("status"))


@query(rf"""
WITH l AS (SELECT doc_id, source, text, {_LINE} AS line FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, source, text, trim(line) AS quote, instr(text, trim(line)) - 1 AS s FROM l WHERE line IS NOT NULL)
SELECT doc_id, CASE WHEN s > 40 THEN '…' ELSE '' END || text[greatest(s - 40, 0) + 1:s] AS before, quote AS mark, text[s + length(quote) + 1:s + length(quote) + 40] || CASE WHEN length(text) > s + length(quote) + 40 THEN '…' ELSE '' END AS after FROM q""")
def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quote with 40 characters around it."""
    rows = core._closing_lines(spark, sf_dir).select("doc_id", "text", grounding.locate("text", F.trim("line")).alias("l"))
    return rows.select("doc_id", store.evidence_window(F.col("text"), F.col("l.start"), F.col("l.end"), 40).alias("w")).select("doc_id", "w.before", "w.mark", "w.after")


# ---- comparisons ---------------------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN day(CAST(l_shipdate AS DATE)) = 1 THEN 'SAME' ELSE 'DIFFERENT' END AS dates,
  CASE WHEN abs(l_discount - l_tax) * 100 <= 0.05 THEN 'SAME' ELSE 'DIFFERENT' END AS shares, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'COMPATIBLE' WHEN l_linestatus = l_returnflag THEN 'SAME' ELSE 'DIFFERENT' END AS states
FROM lineitem""")
def value_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship date and the first of its month, two percentages and two states of every line, compared."""
    i = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")

    def side(iso, number, raw):
        return F.struct(iso.cast("string").alias("value_iso"), number.alias("normalized_number"), F.lit("%").alias("normalized_unit"), raw.alias("value_raw"), F.lit("status").alias("predicate"), none.alias("value_id"))

    rows = i.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), side(F.to_date("l_shipdate"), F.col("l_discount") * 100, F.col("l_linestatus")).alias("a"), side(F.trunc(F.to_date("l_shipdate"), "month"), F.col("l_tax") * 100, F.col("l_returnflag")).alias("b"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "compatible").alias("edge"),
    )
    a, b = F.col("a"), F.col("b")
    return rows.select("k", compare_dates(a, b)["relation"].alias("dates"), compare_numbers(a, b)["relation"].alias("shares"), compare_states(a, b, F.col("edge"))["relation"].alias("states"))


@query("""SELECT s_suppkey, 'segment:branch ' || s_nationkey AS narrow, CASE WHEN s_suppkey % 2 = 0 THEN 'consolidated, ' ELSE '' END || 'segment:branch ' || s_nationkey AS scope, CASE WHEN s_suppkey % 3 = 0 THEN 'restated' ELSE '' END AS other, s_suppkey % 3 = 0 AS restated FROM supplier""")
def scope_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifiers that name another entity, plain scopes, the rest, and the markers among them."""
    s = table(spark, sf_dir, "supplier")
    basis = F.array_compact(F.array(F.when(F.col("s_suppkey") % 2 == 0, "consolidated"), F.concat(F.lit("segment:branch "), F.col("s_nationkey").cast("string")), F.concat(F.lit("segment:"), F.lower("s_name")), F.when(F.col("s_suppkey") % 3 == 0, "restated")))
    c = s.select("s_suppkey", context(F.struct(F.col("s_name").alias("subject"), basis.alias("basis"))).alias("c"))
    return c.select("s_suppkey", *[F.array_join(f"c.{n}", ", ").alias(n) for n in ("narrow", "scope", "other")], "c.restated")


# ---- the chain: labels, registry, blocks, verdicts -----------------------------------------------------------------

_LONG = "Total revenue from the operations of all business lines as it is reported for the whole period under review"


@query(_WITH + _JUDGED + "SELECT verdict, rule_id, axis, confidence, count(*) AS n FROM judged GROUP BY ALL")
def chain_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over facts whose measures go by two near-equal names, or by two names that an adjudication calls the same.

    The registry merges them and an adjudication makes two states exclusive, so the verdicts are those of one vocabulary;
    without the merges documents wouldn't share blocks.
    """
    odd = F.col("document_id").isin("deck", "closing", "typo")
    name = F.when(F.col("predicate") == "Revenue from operations", F.when(odd, f"{_LONG} (net)").otherwise(_LONG)).when((F.col("predicate") == "Account status") & (F.col("document_id") == "status-b"), "Standing of the account").otherwise(F.col("predicate"))
    facts = derived_facts(spark, sf_dir).withColumn("predicate", name).withColumns({c: F.lit(None).cast("string") for c in ("canonical_subject_id", "canonical_predicate_id", "value_id")})
    answers = [("predicate", "standing of the account", "account status", "same"), ("value", "overdrawn", "active", "exclusive")]
    adjudications = spark.createDataFrame(answers, "namespace string, normal string, candidate string, relation string")
    named, edges = canonicalized(store.pending_facts(facts), adjudications)
    judged = judged_pairs(core.save(named, "canonical"), edges)
    return judged.groupBy("j.decision.verdict", "j.decision.rule_id", "j.decision.axis", "j.decision.confidence").agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS c FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT q.vec_id AS label, CASE WHEN (q.vec_id // 100) % 2 = 0 THEN r.vec_id END AS candidate, CASE WHEN (q.vec_id // 100) % 2 = 0 AND r.vec_id IS NOT NULL THEN 'same' ELSE 'different' END AS relation
FROM e q LEFT JOIN r ON query_id = q.vec_id AND rank = (q.vec_id // 100) % 5 AND rank <= 3 WHERE q.vec_id % 100 = 0""")
def adjudicated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about the shortlists of the stated queries: some name no candidate, some a relation that subjects don't have."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("subject").alias("namespace"), F.col("vec_id").alias("normal"), "embedding")
    q = e.filter("normal % 100 = 0")
    number = F.floor(F.col("normal") / 100)
    answers = q.select("namespace", "normal", (number % 5).cast("int").alias("match"), F.when(number % 2 == 0, "same").otherwise("exclusive").alias("relation"))
    told = registry.adjudications(answers, registry.shortlist(q, e, least=None))
    return told.select(F.col("normal").alias("label"), "candidate", "relation")


@query("""SELECT 'subject' AS namespace, lower(replace(s_name, '#', ' ')) AS normal, 3 AS occurrences, lower(s_name) || '|' || lower(s_name) || ' ltd.' AS aliases FROM supplier""")
def registry_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the suppliers' names with all spellings that they came in."""
    entries, _, _ = registry.canonicalize(core._labels(spark, sf_dir).filter("namespace = 'subject'"))
    return store.registry_view(entries).select("namespace", "normal", F.col("occurrences").cast("int").alias("occurrences"), F.array_join("aliases", "|").alias("aliases"))


@query("""
WITH e AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a, b, 'subsumes' AS kind, 'b_to_a' AS direction FROM e UNION ALL SELECT b, a, 'subsumes', 'a_to_b' FROM e""")
def registry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge between each nation and its region, found from either side."""
    e = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))
    pairs = e.union(e.select("b", "a"))
    return registry.find_edges(pairs, e.withColumn("kind", F.lit("subsumes")))


# ---- read model ----------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("/in/"), (F.col("doc_id") % 50).cast("string"), F.lit(".pdf")).alias("source_path"), F.col("n_chars").alias("ingested_at"),
        F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("doc_id") % 7 == 0, "no text").alias("error"),
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, n_chars AS ingested_at FROM documents")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_documents(_documents(spark, sf_dir)).select("document_id", "ingested_at")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'no text' END AS error FROM documents WHERE doc_id IN (14, 15)")
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    return store.document_status(d, "14").union(store.document_status(store.get_document(d, "15"), "15"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id = 15 THEN 'ready again' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents")
def document_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.patch(_documents(spark, sf_dir), "document_id", "15", {"status": F.lit("ready again")}).select("document_id", "status")


@query("""
WITH p AS (SELECT *, '/in/' || (doc_id % 50) || '.pdf' AS path FROM documents), old AS (SELECT * FROM p WHERE doc_id % 2 = 0)
SELECT path AS source_path, count(*) AS arriving, bool_or(path IN (SELECT path FROM old)) AS refused, (SELECT count(*) FROM old o WHERE o.path = p.path) AS replaced FROM p WHERE doc_id % 3 = 0 GROUP BY path""")
def reingest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive while others are stored: refused where their path is known, or, forced, in place of those."""
    d = _documents(spark, sf_dir)
    stored, arriving = d.filter("cast(document_id as int) % 2 = 0"), d.filter("cast(document_id as int) % 3 = 0")
    facts = stored.select(F.concat(F.lit("f"), "document_id").alias("id"), "document_id")
    tables = {"documents": stored, "facts": facts, "relations": facts.select(F.col("id").alias("fact_a_id"), F.col("id").alias("fact_b_id"))}
    left = store.replace_documents(tables, store.admit(stored, arriving, force=True)[0])["documents"]
    admitted, refused = store.admit(stored, arriving)
    n = admitted.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True))).groupBy("source_path").agg(F.count("*").alias("arriving"), F.bool_or("refused").alias("refused"))
    before, after = (t.groupBy("source_path").agg(F.count("*").alias(c)) for t, c in ((stored, "before"), (left, "after")))
    both = n.join(before, "source_path", "left").join(after, "source_path", "left").fillna(0)
    return both.select("source_path", "arriving", "refused", (F.col("before") - F.col("after")).alias("replaced"))


@query(r"SELECT doc_id AS page_number, length(text) AS chars FROM documents WHERE source = (SELECT min(source) FROM documents)")
def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page texts of the first source."""
    pages = core._pages(spark, sf_dir)
    first = pages.agg(F.min("document_id")).first()[0]
    return store.page_texts(pages, first).select(F.col("page_number").cast("long").alias("page_number"), F.length("text").cast("long").alias("chars"))


@query(_WITH + "SELECT doc AS document_id, count(*) AS n, CAST((SELECT count(*) FROM facts) AS BIGINT) AS of_all FROM facts WHERE doc = 'annual' GROUP BY doc")
def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir)
    every = store.count_facts(f).first()["n"]
    return store.count_facts(f, "annual").select(F.lit("annual").alias("document_id"), "n", F.lit(every).cast("long").alias("of_all"))


@query(_WITH + _JUDGED + _KEPT + ", one AS (SELECT min(a_seq) AS seq FROM kept) SELECT id, verdict FROM kept, one WHERE a_seq = seq OR b_seq = seq")
def fact_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of the first fact that has some."""
    facts = derived_facts(spark, sf_dir)
    rel = core.save(core._relations(spark, sf_dir, facts), "relations")
    f = facts.select("id", "fact_seq").join(rel.select(F.col("fact_a_id").alias("id")).distinct(), "id").orderBy("fact_seq").first()
    return store.relations_of(rel, f["id"] if f else "").select("id", "verdict")


@query(_WITH + _JUDGED + _KEPT + """, ends AS (SELECT a_seq AS seq, b_seq AS other, verdict, confidence, id FROM kept UNION ALL SELECT b_seq, a_seq, verdict, confidence, id FROM kept),
  n AS (SELECT seq, string_agg(verdict || ' fact_' || other, ', ' ORDER BY confidence DESC, id) AS relations FROM ends GROUP BY seq)
  SELECT 'fact_' || f.seq AS id, 'Revenue page ' || (f.seq % 7 + 1) AS before, 'fact_' || f.seq AS mark, relations FROM facts f LEFT JOIN n USING (seq)""")
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with its place in its page and all its relations."""
    f = facts = derived_facts(spark, sf_dir)
    page = F.concat(F.lit("Revenue page "), F.col("page_number").cast("string"))
    # A page of its own for each fact: a line that says what the page is, then the fact's id.
    f = f.withColumn("document_id", F.concat("document_id", F.lit("/"), "id"))
    pages = f.select("document_id", "page_number", F.concat(page, F.col("id")).alias("text"))
    f = f.withColumn("char_start", F.length(page)).withColumn("char_end", F.length(page) + F.length("id"))
    whole = store.whole_facts(f, pages, core.save(core._relations(spark, sf_dir, facts), "relations"))
    told = F.nullif(F.array_join(F.transform("relations", lambda r: F.concat(r["verdict"], F.lit(" "), r["other"])), ", "), F.lit(""))
    return whole.select("id", "evidence.before", "evidence.mark", told.alias("relations"))


@query(_WITH + "SELECT doc AS document_id, count(*) FILTER (seq % 3 = 0) AS cache_hits, count(*) FILTER (seq % 11 = 0) AS errors, count(*) + count(*) FILTER (seq % 4 = 0) AS claims, count(*) FILTER (seq % 4 = 0) AS duplicates, count(*) FILTER (seq % 5 = 1) AS quote_not_found, count(*) FILTER (seq % 5 = 2) AS value_not_in_quote, count(*) FILTER (seq % 5 NOT IN (1, 2)) AS facts, count(DISTINCT seq % 7) AS pages FROM facts GROUP BY doc")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of pages, facts and quarantine by reason, where claims are rejected by the rest of their number by five."""
    f = derived_facts(spark, sf_dir).withColumn("rest", F.col("fact_seq") % 5)
    pages = f.select("document_id", "page_number").distinct().withColumn("text", F.lit("x" * 60))
    units = pages.withColumn("salient", F.lit(True))
    bad = f.filter("rest in (1, 2)").withColumn("reason", F.when(F.col("rest") == 1, "quote_not_found").otherwise("value_not_in_quote"))
    requests = f.select("document_id", (F.col("fact_seq") % 3 == 0).alias("hit"), F.when(F.col("fact_seq") % 11 == 0, "no answer").alias("error"))
    claims = f.select("document_id").unionAll(f.filter("fact_seq % 4 = 0").select("document_id"))
    counted = ingest.ingest_stats(pages, units, f.filter("rest not in (1, 2)"), bad, requests, claims)
    return counted.select("document_id", "cache_hits", "errors", "claims", "duplicates", "quote_not_found", "value_not_in_quote", "facts", "pages")


@query(_WITH + "SELECT CASE WHEN seq % 5 = 1 THEN 'quote_not_found' ELSE 'value_not_in_quote' END AS reason, count(*) AS n FROM facts WHERE seq % 5 IN (1, 2) GROUP BY ALL")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = derived_facts(spark, sf_dir).withColumn("rest", F.col("fact_seq") % 5)
    return store.quarantine_by_reason(f.filter("rest in (1, 2)").withColumn("reason", F.when(F.col("rest") == 1, "quote_not_found").otherwise("value_not_in_quote")))


@query(_WITH + "SELECT 'fact_' || seq AS id FROM facts WHERE doc = 'quarterly' AND seq % 5 = 1 ORDER BY ((seq % 7) + 1), seq LIMIT 50")
def quarantine_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 rejected claims of one document and reason; the limit is the list's own."""
    f = derived_facts(spark, sf_dir).filter("fact_seq % 5 = 1").withColumns({"reason": F.lit("quote_not_found"), "unit": F.lit(0), "claim_pos": F.col("fact_seq")})
    return store.list_quarantine(f, "quarterly", "quote_not_found", 50).select("id")
