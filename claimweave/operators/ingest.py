"""From extracted claims to facts and quarantine: validation, deduplication, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import col
from ..functions.numbers import parse_numeric_literal

FACT_TYPES = ["quantity", "state", "identity", "date"]
KINDS = ["number", "date", "entity", "categorical"]
#: The wire shape of an extractor's answer.
WIRE = (
    "array<struct<claim:string,subject:string,predicate:string,factType:string,value:struct<kind:string,raw:string,number:double,unit:string,scale:string,currency:string>,"
    "period:string,basis:array<string>,quote:string,confidence:double>>"
)
REASONS = ["page_not_found", "quote_not_found", "quote_lacks_context", "value_not_in_quote"]


def signed(number: Column | str, raw: Column | str) -> Column:
    """The number with the printed literal's sign, where both have the same magnitude; else the number, or the literal."""
    number, printed = col(number), parse_numeric_literal(raw)
    close = F.abs(F.abs(number) - F.abs(printed)) <= F.greatest(F.abs(printed), F.lit(1.0)) * 1e-9
    return F.when(close & ((printed < 0) != (number < 0)), F.when(printed < 0, -F.abs(number)).otherwise(F.abs(number))).otherwise(F.coalesce(number, printed))


def raw_claims(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) claims of responses (document_id, page_number, unit, value as JSON), one row each.

    A claim is rejected for a type or kind that isn't known, or a confidence outside 0 to 1.
    """
    parsed = responses.select("document_id", "page_number", "unit", F.posexplode(F.from_json("value", WIRE)).alias("claim_pos", "c")).select("document_id", "page_number", "unit", "claim_pos", "c.*")
    valid = F.col("factType").isin(FACT_TYPES) & F.col("value.kind").isin(KINDS) & F.col("confidence").between(0, 1) & F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("value.raw").isNotNull()
    valid = F.coalesce(valid, F.lit(False))
    return parsed.filter(valid), parsed.filter(~valid)


def scoped(valid: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims in the flat shape that grounding and lifting take; documents (document_id, published_at) date them."""
    rows = valid.join(documents.select("document_id", F.col("published_at").alias("asserted_as_of")), "document_id", "left")
    return rows.select(
        "document_id", "page_number", "unit", "claim_pos", "claim", "subject", "predicate", F.col("factType").alias("fact_type"), F.col("value.kind").alias("value_kind"), F.col("value.raw").alias("value_raw"),
        F.when(F.col("value.kind") == "number", signed("value.number", "value.raw")).alias("number"), F.col("value.unit").alias("unit_text"), F.col("value.scale").alias("scale"), F.col("value.currency").alias("currency"),
        F.col("period").alias("period_raw"), F.filter(F.transform(F.coalesce("basis", F.array().cast("array<string>")), lambda b: F.lower(F.trim(b))), lambda b: b != "").alias("basis"), "quote", "confidence", "asserted_as_of",
    )


def identity() -> list[Column]:
    """What makes two claims of a document the same."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    return [F.col("document_id"), low("subject"), low("predicate"), F.trim(F.col("value_raw")), F.col("period_raw"), F.array_join(F.array_sort("basis"), ","), F.col("page_number")]


def dedupe(claims: DataFrame, order: list[str]) -> DataFrame:
    """The first of equal claims by order. The key holds the document and page, so no group is larger than a page's claims."""
    return claims.withColumn("__nth", F.row_number().over(Window.partitionBy(*identity()).orderBy(*order))).filter("__nth = 1").drop("__nth")


def split_grounded(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantine) of claims with a grounding struct; claims in quarantine keep everything, and the reason."""
    return claims.filter("grounding.status = 'grounded'"), claims.filter("grounding.status <> 'grounded'").withColumn("reason", F.col("grounding.status"))


def ingest_stats(pages: DataFrame, units: DataFrame, kept: DataFrame, quarantine: DataFrame, requests: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Counters per document: pages, those with text, units, skipped ones, facts, and quarantined claims by reason.

    With requests (document_id, hit, error): units answered, errors, answers from the cache and beside it. With claims, all
    that were extracted: their number, and how many were left out as duplicates.
    """
    p = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.length(F.trim("text")) > 50).alias("pages_with_text"))
    u = units.groupBy("document_id").agg(F.count("*").alias("units"), F.count_if(~F.col("salient")).alias("skipped"))
    k = kept.groupBy("document_id").agg(F.count("*").alias("facts"))
    q = quarantine.groupBy("document_id").agg(F.count("*").alias("quarantined"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    out = p.join(u, "document_id", "left").join(k, "document_id", "left").join(q, "document_id", "left")
    if requests is not None:
        failed = F.col("error").isNotNull()
        r = requests.groupBy("document_id").agg(F.count_if(~failed).alias("extracted"), F.count_if(failed).alias("errors"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit")).alias("cache_misses"))
        out = out.join(r, "document_id", "left")
    if claims is not None:
        out = out.join(claims.groupBy("document_id").agg(F.count("*").alias("claims")), "document_id", "left").fillna(0)
        out = out.withColumn("duplicates", F.col("claims") - F.col("facts") - F.col("quarantined"))
    return out.fillna(0)
