"""Registered queries of evidence: quotes of every tier located through indexes of pages, pages laid out from items, boxes, units called from SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..operators.grounding import boxes_for_range
from ..operators.locating import ground_by_index
from ..operators.segmentation import layout_items, running_headers
from .queries import _closing_lines, _pages, query, table

_SP = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_SPACED = lambda words: f"array_to_string(list_transform({words}, lambda x: regexp_escape(x)), '{_SP}+')"
_SQUASH = lambda text: f"trim(regexp_replace({text}, '{_SP}+', ' ', 'g'))"
_TOKENS = lambda text: f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9.]*'), lambda x: length(x) >= 2))"

#: Quotes of every document's last line, each looked for in the whole text tier after tier.
TIERS = rf"""
WITH d AS (SELECT doc_id, text, trim(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) >= 12)[-1]) AS line FROM documents),
w AS (SELECT *, string_split(line, ' ') AS w FROM d WHERE line IS NOT NULL),
c AS (SELECT doc_id, text, unnest([
    {{'form': 'exact', 'quote': line}}, {{'form': 'spaced', 'quote': replace(line, ' ', '   ')}}, {{'form': 'capitals', 'quote': translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}},
    {{'form': 'punctuated', 'quote': replace(line, ' ', ' - ')}}, {{'form': 'reversed', 'quote': array_to_string(list_reverse(w), ' ')}},
    {{'form': 'cut', 'quote': array_to_string(w[:3], ' ') || ' zzqx ' || array_to_string(w[greatest(len(w) - 2, 1):], ' ')}}, {{'form': 'made up', 'quote': 'zzqx ' || line || ' qqzx zzqq'}}]) AS c FROM w),
q AS MATERIALIZED (SELECT doc_id, text, c.form AS form, c.quote AS own, regexp_replace(c.quote, '^{_SP}+|{_SP}+$', '', 'g') AS quote FROM c),
p AS (SELECT *, {_SPACED(f"regexp_split_to_array(quote, '{_SP}+')")} AS pattern FROM q),
m AS (SELECT *, instr(text, quote) AS place, regexp_extract(text, pattern) AS spaced, regexp_extract(text, '(?i)' || pattern) AS caseless FROM p),
near AS MATERIALIZED (SELECT *, CASE WHEN place > 0 THEN 'exact' WHEN spaced <> '' THEN 'whitespace' WHEN caseless <> '' THEN 'caseless' END AS method,
    CASE WHEN place > 0 THEN place - 1 WHEN spaced <> '' THEN instr(text, spaced) - 1 WHEN caseless <> '' THEN instr(text, caseless) - 1 END AS s, length(CASE WHEN place > 0 THEN quote WHEN spaced <> '' THEN spaced ELSE caseless END) AS n FROM m),
chars AS (SELECT doc_id, string_split(text, '') AS c FROM w),
letters AS MATERIALIZED (SELECT doc_id, list_filter(range(1, len(c) + 1), lambda i: regexp_matches(c[i], '[A-Za-z0-9\x{{0130}}\x{{212a}}]')) AS places, regexp_replace(lower(array_to_string(c, '')), '[^a-z0-9]', '', 'g') AS folded FROM chars),
fq AS (SELECT doc_id, form, regexp_replace(lower(quote), '[^a-z0-9]', '', 'g') AS f FROM near WHERE method IS NULL),
folded AS MATERIALIZED (SELECT doc_id, form, places[instr(folded, f)] - 1 AS s, places[instr(folded, f) + length(f) - 1] AS e FROM fq JOIN letters USING (doc_id) WHERE length(f) >= 8 AND instr(folded, f) > 0),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM w),
ll AS MATERIALIZED (SELECT doc_id, k, sum(length(x) + 1) OVER o - length(x) - 1 AS s, sum(length(x) + 1) OVER o - 1 AS e, {_TOKENS("x")} AS t FROM ls WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
windows AS (SELECT doc_id, 1 AS size, k, s, e, t FROM ll
    UNION ALL SELECT a.doc_id, 2, a.k, a.s, b.e, a.t || b.t FROM ll a JOIN ll b ON b.doc_id = a.doc_id AND b.k = a.k + 1
    UNION ALL SELECT a.doc_id, 3, a.k, a.s, c.e, a.t || b.t || c.t FROM ll a JOIN ll b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN ll c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
sq AS (SELECT doc_id, form, {_TOKENS("quote")} AS want, len(list_filter(regexp_extract_all(lower(quote), '[a-z0-9][a-z0-9.]*'), lambda x: length(x) >= 2)) AS n FROM near WHERE method IS NULL),
scattered AS MATERIALIZED (SELECT doc_id, form, min_by(v.s, size * 100000000 + k) AS s, min_by(v.e, size * 100000000 + k) AS e FROM sq JOIN windows v USING (doc_id) WHERE n >= 2 AND list_has_all(t, want) GROUP BY doc_id, form),
aw AS (SELECT doc_id, form, text, quote, list_filter(string_split({_SQUASH("quote")}, ' '), lambda x: length(x) > 1) AS a FROM near WHERE method IS NULL),
ah AS (SELECT *, regexp_extract(text, '(?is)' || {_SPACED("a[1:3]")}) AS head FROM aw WHERE len(a) >= 4),
ar AS (SELECT *, instr(text, head) AS h FROM ah WHERE head <> ''),
tails AS (SELECT *, text[h:] AS rest, regexp_extract(text[h:], '(?is)' || {_SPACED("a[len(a) - 2:]")}) AS tail FROM ar),
anchored AS (SELECT doc_id, form, h - 1 AS s, h - 1 + instr(rest, tail) - 1 + length(tail) AS e FROM tails WHERE tail <> '' AND length({_SQUASH("rest[:instr(rest, tail) - 1 + length(tail)]")}) - 1 < 3 * length({_SQUASH("quote")})),
hit AS (SELECT n.doc_id, n.form, n.text, n.own, CASE WHEN method IS NOT NULL THEN method WHEN f.s IS NOT NULL THEN 'folded' WHEN g.s IS NOT NULL THEN 'scattered' WHEN h.s IS NOT NULL THEN 'anchored' END AS method,
    coalesce(n.s, f.s, g.s, h.s) AS s, CASE WHEN n.method IS NOT NULL THEN n.s + n.n ELSE coalesce(f.e, g.e, h.e) END AS e
    FROM near n LEFT JOIN folded f USING (doc_id, form) LEFT JOIN scattered g USING (doc_id, form) LEFT JOIN anchored h USING (doc_id, form)),
lined AS (SELECT *, s - coalesce(nullif(instr(reverse(text[:s]), chr(10)), 0) - 1, s) AS ls, e + coalesce(nullif(instr(text[greatest(e, 1):], chr(10)), 0) - 2, length(text) - e) AS le FROM hit),
status AS (SELECT *, CASE WHEN method IS NULL THEN 'quote_not_found'
    WHEN len(list_filter(regexp_extract_all(lower(text[ls + 1:le]), '[a-z]{{3,}}'), lambda x: x NOT IN ('inr', 'usd', 'eur', 'gbp', 'crore', 'crores', 'lakh', 'lakhs', 'million', 'billion', 'thousand', 'and', 'the', 'for', 'per'))) = 0 THEN 'quote_lacks_context'
    WHEN NOT regexp_matches(own, '[\p{{L}}\p{{N}}]') THEN 'value_not_in_quote' ELSE 'grounded' END AS status FROM lined)
SELECT doc_id, form, status, coalesce(method, 'none') AS method, CAST(CASE WHEN status = 'quote_lacks_context' THEN s ELSE ls END AS INT) AS char_start, CAST(CASE WHEN status = 'quote_lacks_context' THEN e ELSE le END AS INT) AS char_end FROM status"""


@query(TIERS)
def ground_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven quotes of every document's last line: as printed, spaced, in capitals, punctuated, backwards, cut in the middle, made up."""
    lines = _closing_lines(spark, sf_dir).select("doc_id", "text", F.trim("line").alias("line"))
    words = F.split("line", " ")
    cut = F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit(" zzqx "), F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3)), " "))
    forms = {
        "exact": F.col("line"), "spaced": F.replace("line", F.lit(" "), F.lit("   ")), "capitals": F.translate("line", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "punctuated": F.replace("line", F.lit(" "), F.lit(" - ")), "reversed": F.array_join(F.reverse(words), " "), "cut": cut, "made up": F.concat(F.lit("zzqx "), "line", F.lit(" qqzx zzqq")),
    }
    page = [F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number")]
    quotes = lines.select(*page, F.explode(F.array(*[F.struct(F.lit(k).alias("form"), q.alias("quote")) for k, q in forms.items()])).alias("c"))
    claims = quotes.select("document_id", "page_number", "c.form", "c.quote", F.lit("text").alias("value_kind"), F.col("c.quote").alias("value_raw"))
    rows = ground_by_index(claims, lines.select(*page, "text"))
    return rows.select(F.col("document_id").alias("doc_id"), "form", "grounding.status", "grounding.method", F.col("grounding.start").alias("char_start"), F.col("grounding.end").alias("char_end"))


#: Words stand ten character widths apart, further where they are longer, lines twelve points.
_ITEMS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
w AS (SELECT * FROM (SELECT doc_id, k, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS j FROM l) WHERE word <> ''),
g AS (SELECT *, lag(length(word)) OVER o AS n, j - lag(j) OVER o AS step FROM w WINDOW o AS (PARTITION BY doc_id, k ORDER BY j)),
p AS (SELECT doc_id, k, string_agg(repeat(' ', coalesce(least(greatest(10 * step - n, 0), 12), 0)) || word, '' ORDER BY j) AS line, min(60 * j) AS x, max(60 * j + 6 * length(word)) AS right_x FROM g GROUP BY doc_id, k)
SELECT doc_id, sha256(string_agg(line || chr(10), '' ORDER BY k)) AS text_sha256, CAST(sum(length(line) + 1) AS INT) AS n_chars,
  CAST(max_by(x, k) AS INT) AS x, CAST(12 * max(k) - 10 AS INT) AS y, CAST(max_by(right_x - x, k) AS INT) AS w, CAST(10 AS INT) AS h FROM p GROUP BY doc_id"""


@query(_ITEMS)
def laid_out_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words as positioned items, laid out as a page, and the box of the page's last printed line."""

    def item(word: Column, j: Column, k: Column) -> Column:
        place = [(j * 60.0).alias("x"), (800.0 - k * 12.0).alias("y"), (F.length(word) * 6.0).alias("width"), F.lit(10.0).alias("height"), F.lit(800.0).alias("page_height")]
        return F.struct(word.alias("str"), *place)

    words = lambda line, k: F.transform(F.split(line, " "), lambda word, j: item(word, j, k))
    # Rows of one doc_id are one page; a page without words has no text.
    own = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    items = F.flatten(F.transform("texts", lambda text: F.flatten(F.transform(F.split(text, "\n"), words))))
    pages = layout_items(own.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), items.alias("items"))).filter("text <> ''")
    last = F.substring_index(F.expr("left(text, length(text) - 1)"), "\n", -1)
    boxes = pages.select(F.col("document_id").alias("doc_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), F.length("text").alias("n_chars"), F.inline(boxes_for_range("spans", F.length("text") - 1 - F.length(last), F.length("text"))))
    return boxes.select("doc_id", "text_sha256", "n_chars", *[F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h")])


@query()
def segment_units_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of segment_units, by SQL that calls page_units for every page; a test holds both equal."""
    sql.register(spark)
    pages = _pages(spark, sf_dir)
    return spark.sql(
        """SELECT p.document_id, p.page_number, u.* FROM {pages} p LEFT JOIN (SELECT document_id, collect_set(line) AS headers FROM {headers} GROUP BY document_id) h USING (document_id),
           LATERAL page_units(p.text, h.headers) u""", pages=pages, headers=running_headers(pages))  # fmt: skip
