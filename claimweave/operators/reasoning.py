"""Comparing pairs of facts: values, axes of context, and the ordered verdict table, as column expressions.

A fact is a struct column with the fields of FACT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.numbers import format_normalized
from ..functions.periods import compare_periods, period_label, period_months
from ..functions.text import normalize_by_hint, normalize_subject

FACT = (
    "fact_seq bigint, id string, document_id string, page_number int, subject string, predicate string, fact_type string,"
    " value_kind string, value_raw string, value_iso string, value_id string,"
    " period struct<raw:string,kind:string,start:string,end:string>, asserted_as_of string, basis array<string>,"
    " canonical_subject_id string, canonical_predicate_id string, normalized_number double, normalized_unit string, confidence double"
)
# What makes an entity scope, a restatement and a provisional figure.
ENTITY_SCOPES = ["consolidated", "standalone", "unconsolidated", "combined"]
RESTATED = ["restated", "revised", "reinstated", "regrouped", "reclassified"]
PROVISIONAL = ["provisional", "projection", "projected", "forecast", "estimate", "estimated", "budgeted", "preliminary", "advance"]
#: A qualifier that names an entity, such as segment:express.
NARROWING = r"^[a-z][A-Za-z0-9_ ]*:"
#: Numbers within these distances are the same: in points for percentages, else relative to the larger.
POINTS, RELATIVE = 0.051, 0.005
# Ratios that betray a mistake of scale.
RATIOS = [(10.0, "10x: a mismatch of scale or units"), (100.0, "100x: a mismatch of scale or units"), (1000.0, "1000x: a mismatch of scale or units"), (1e7, "a crore: rupees against crores")]
AXES = ["period", "entityScope", "basis", "unit", "predicate", "vintage"]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def compare_numbers(a: Column, b: Column) -> Column:
    """struct<relation, detail, ratio> of two facts with numbers; ratio is b / a, infinite for a = 0."""
    unit, other = F.coalesce(a["normalized_unit"], F.lit("")), F.coalesce(b["normalized_unit"], F.lit(""))
    unknown = lambda text: _value("UNKNOWN", text)

    def known(x: Column, y: Column) -> Column:
        gap, size = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
        same = F.when(unit == "%", gap <= POINTS).when(size == 0, F.lit(True)).otherwise(F.try_divide(gap, size) <= RELATIVE)
        return let(same, lambda s: let(F.when(x == 0, F.when(s, 1.0).otherwise(float("inf"))).otherwise(F.try_divide(y, x)), lambda r: told(x, y, s, r)))

    def told(x: Column, y: Column, same: Column, ratio: Column) -> Column:
        near = lambda k: (F.abs(F.abs(ratio) - k) / k < 0.005) | (F.abs(F.abs(ratio) - 1 / k) * k < 0.005)
        hint = reduce(lambda c, k: c.when(near(k[0]), k[1]), RATIOS[1:], F.when(near(RATIOS[0][0]), RATIOS[0][1]))
        detail = F.concat(format_normalized(x, unit), F.when(same, " equals ").otherwise(" against "), format_normalized(y, unit))
        text = F.when(same, detail).otherwise(F.concat_ws("; ", detail, hint))
        return F.struct(F.when(same, "SAME").otherwise("DIFFERENT").alias("relation"), text.alias("detail"), ratio.cast("double").alias("ratio"))

    x, y = a["normalized_number"], b["normalized_number"]
    return (
        F.when(~_finite(x) | ~_finite(y), unknown(F.lit("A value has no number")))
        .when(unit != other, unknown(F.concat(F.lit("No common unit: "), unit, F.lit(" and "), other)))
        .otherwise(let(x, lambda x: let(y, lambda y: known(x, y))))
    )


def _value(relation: str, detail: Column, ratio: Column | None = None) -> Column:
    return F.struct(F.lit(relation).alias("relation"), detail.alias("detail"), (F.lit(None) if ratio is None else ratio).cast("double").alias("ratio"))


def compare_dates(a: Column, b: Column) -> Column:
    x, y = F.nullif(a["value_iso"], F.lit("")), F.nullif(b["value_iso"], F.lit(""))
    return (
        F.when(x.isNull() | y.isNull(), _value("UNKNOWN", F.lit("A date can't be read")))
        .when(x == y, _value("SAME", F.concat(F.lit("Both are "), x)))
        .otherwise(_value("DIFFERENT", F.concat(x, F.lit(" against "), y)))
    )


def compare_states(a: Column, b: Column, edge: Column) -> Column:
    """Names and states: equal normal forms or registry ids are the same; edge (exclusive, compatible) decides the rest."""
    text = F.concat(a["value_raw"], F.lit(" against "), b["value_raw"])
    same = let(normalize_by_hint(a["value_raw"], a["predicate"]), lambda x: (x != "") & (x == normalize_by_hint(b["value_raw"], b["predicate"])))
    return (
        F.when(same | (a["value_id"] == b["value_id"]), _value("SAME", F.concat(F.lit("Both mean "), a["value_raw"])))
        .when(edge == "exclusive", _value("EXCLUSIVE", F.concat(text, F.lit(": one excludes the other"))))
        .when(edge == "compatible", _value("COMPATIBLE", F.concat(text, F.lit(": both can hold"))))
        .otherwise(_value("DIFFERENT", text))
    )


def compare_values(a: Column, b: Column, edge: Column) -> Column:
    return (
        F.when(a["value_kind"] != b["value_kind"], _value("UNKNOWN", F.concat(F.lit("Kinds differ: "), a["value_kind"], F.lit(" and "), b["value_kind"])))
        .when(a["value_kind"] == "number", compare_numbers(a, b))
        .when(a["value_kind"] == "date", compare_dates(a, b))
        .otherwise(compare_states(a, b, edge))
    )


def narrowings(fact: Column) -> Column:
    """The qualifiers that name an entity other than the subject, sorted."""
    name = lambda t: normalize_subject(F.regexp_replace(t, "^[^:]*:", ""))
    return let(normalize_subject(fact["subject"]), lambda s: F.array_sort(F.filter(fact["basis"], lambda t: t.rlike(NARROWING) & (name(t) != s))))


def context(fact: Column) -> Column:
    """struct<narrow, scope, other, restated, provisional>: what the axes need of one fact; compute it before pairing."""
    plain = F.filter(fact["basis"], lambda t: t.isin(ENTITY_SCOPES))
    other = F.array_sort(F.filter(fact["basis"], lambda t: ~t.isin(ENTITY_SCOPES) & ~t.startswith("segment:")))
    marked = lambda words: F.exists(fact["basis"], lambda t: t.isin(words))
    return let(
        narrowings(fact),
        lambda n: F.struct(n.alias("narrow"), F.array_sort(F.concat(plain, n)).alias("scope"), other.alias("other"), marked(RESTATED).alias("restated"), marked(PROVISIONAL).alias("provisional")),
    )


def axis_deltas(a: Column, b: Column, ca: Column, cb: Column, relation: Column, broader: Column | None = None) -> Column:
    """array<struct<dimension, aligned, a, b, note>> in the order of AXES; relation is that of the periods, broader the side (a, b) whose measure contains the other's."""
    told = lambda c, none: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(none))
    shown = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))

    def delta(name: str, aligned: Column, x: Column, y: Column, yes: Column, no: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), aligned.alias("aligned"), x.alias("a"), y.alias("b"), F.when(aligned, yes).otherwise(no).alias("note"))

    pa, pb = period_label(a["period"]), period_label(b["period"])
    months = lambda inner, outer: F.concat(period_months(inner["period"]).cast("string"), F.lit(" of "), period_months(outer["period"]).cast("string"), F.lit(" months"))
    why = (
        F.when(relation == "MISSING", F.concat(F.lit("No period on one side: "), pa, F.lit(" and "), pb))
        .when(relation == "BOUNDARY", F.concat(pa, F.lit(" and "), pb, F.lit(": one is the closing day of the other")))
        .when(relation == "A_CONTAINS_B", F.concat(pb, F.lit(" lies within "), pa, F.lit(", "), months(b, a)))
        .when(relation == "B_CONTAINS_A", F.concat(pa, F.lit(" lies within "), pb, F.lit(", "), months(a, b)))
        .when(relation == "DISJOINT", F.concat(pa, F.lit(" and "), pb, F.lit(" have no day in common")))
        .otherwise(F.concat(pa, F.lit(" and "), pb, F.lit(" overlap in part")))
    )
    equal = ca["scope"] == cb["scope"]
    silent = (F.size(ca["scope"]) == 0) | (F.size(cb["scope"]) == 0)
    narrow = (F.size(ca["narrow"]) > 0) | (F.size(cb["narrow"]) > 0)
    contains = F.lit("") if broader is None else F.when(broader == "a", ": the first contains the second").when(broader == "b", ": the second contains the first").otherwise("")
    ua, ub, va, vb = a["normalized_unit"], b["normalized_unit"], a["asserted_as_of"], b["asserted_as_of"]
    return F.array(
        delta("period", relation == "EQUAL", period_or_null(a), period_or_null(b), F.concat(F.lit("Same period: "), pa), why),
        delta("entityScope", equal | (silent & ~narrow), shown(ca["scope"]), shown(cb["scope"]), F.concat(F.lit("Entity scopes agree: "), told(F.array_union(ca["scope"], cb["scope"]), "none stated")), F.concat(F.lit("Entity scopes differ: "), told(ca["scope"], "none"), F.lit(" and "), told(cb["scope"], "none"))),
        delta("basis", ca["other"] == cb["other"], shown(ca["other"]), shown(cb["other"]), F.concat(F.lit("Qualifiers agree: "), told(ca["other"], "none")), F.concat(F.lit("Qualifiers differ: "), told(ca["other"], "none"), F.lit(" and "), told(cb["other"], "none"))),
        delta("unit", ua.eqNullSafe(ub), ua, ub, F.concat(F.lit("Same base unit: "), F.coalesce(ua, F.lit("none"))), F.concat(F.lit("Base units differ: "), F.coalesce(ua, F.lit("none")), F.lit(" and "), F.coalesce(ub, F.lit("none")))),
        delta("predicate", a["canonical_predicate_id"].eqNullSafe(b["canonical_predicate_id"]), a["predicate"], b["predicate"], F.concat(F.lit("Same measure: "), a["predicate"]), F.concat(F.lit("Measures differ: "), a["predicate"], F.lit(" and "), b["predicate"], contains)),
        delta("vintage", va.eqNullSafe(vb), va, vb, F.concat(F.lit("Published alike: "), F.coalesce(va, F.lit("undated"))), F.when(va.isNull() | vb.isNull(), F.lit("One side has no publication date")).otherwise(F.concat(F.lit("Published "), va, F.lit(" and "), vb, F.when(va < vb, F.lit(": b is later")).otherwise(F.lit(": a is later"))))),
    )


def period_or_null(fact: Column) -> Column:
    return F.when(fact["period"].isNotNull(), period_label(fact["period"]))


def decide(a: Column, b: Column, ca: Column, cb: Column, value: Column, relation: Column, deltas: Column, rules: str = "reference") -> Column:
    """struct<verdict, rule_id, axis, confidence, explanation>: the first rule that holds.

    rules="documented" puts restated and provisional figures before R4 where basis is the only axis that differs.
    """
    off = F.filter(F.slice(deltas, 1, 5), lambda d: ~d["aligned"])

    def table(off: Column) -> Column:
        first, rel, detail = F.get(off, F.lit(0)), value["relation"], value["detail"]
        aligned = F.size(off) == 0
        only = lambda axis: (F.size(off) == 1) & (first["dimension"] == axis)
        differ = rel.isin("DIFFERENT", "EXCLUSIVE")
        va, vb = a["asserted_as_of"], b["asserted_as_of"]
        later = (va != vb) & va.isNotNull() & vb.isNotNull()
        dated = deltas[5]["aligned"]
        restated, provisional = ca["restated"] != cb["restated"], ca["provisional"] != cb["provisional"]
        none = F.lit(None).cast("string")

        def rule(verdict: str, name, axis, base, text: Column) -> Column:
            own = lambda x: F.lit(x) if isinstance(x, str) else x
            trust = F.lit(base) if isinstance(base, float) else base
            confidence = F.floor(F.least(F.lit(1.0), trust * (0.6 + 0.4 * F.least(a["confidence"], b["confidence"]))) * 100 + 0.5) / 100
            return F.struct(F.lit(verdict).alias("verdict"), own(name).alias("rule_id"), own(axis).alias("axis"), confidence.alias("confidence"), text.alias("explanation"))

        say = lambda text, *more: F.concat_ws(" ", F.lit(text), *more)
        restated_rule = rule("SUPERSEDED", "R5-restated", "basis", 0.9, say("One figure restates the other.", detail))
        provisional_rule = rule("RECONCILED", "R7-provisional", "basis", 0.8, say("One figure is provisional.", detail))
        early = []
        if rules == "documented":
            early = [(differ & restated & only("basis"), restated_rule), (differ & provisional & only("basis"), provisional_rule)]
        chain = [
            ((F.size(ca["narrow"]) > 0) & (F.size(cb["narrow"]) > 0) & (ca["narrow"] != cb["narrow"]), rule("UNRELATED", "R-different-entities", "entityScope", 0.2, say("Different entities:", F.array_join(ca["narrow"], ", "), F.lit("and"), F.array_join(cb["narrow"], ", ")))),
            ((rel == "UNKNOWN") & _finite(a["normalized_number"]) & _finite(b["normalized_number"]) & ~deltas[3]["aligned"], rule("RECONCILED", "R0-units", "unit", 0.6, say("Not comparable, and nothing is converted.", deltas[3]["note"]))),
            (rel == "UNKNOWN", rule("UNRELATED", "R0", none, 0.2, detail)),
            ((rel == "SAME") & aligned, rule("CORROBORATES", "R1", none, 0.95, say("Same value in the same context.", detail))),
            ((rel == "SAME") & (relation == "BOUNDARY") & only("period"), rule("CORROBORATES", "R1b-boundary-period", "period", 0.75, say("Same value; a closing day stands for its period.", detail))),
            (rel == "SAME", rule("UNRELATED", "R2", first["dimension"], 0.3, say("Same value by coincidence.", first["note"]))),
            (rel == "COMPATIBLE", rule("CORROBORATES", "R3", none, 0.7, say("No conflict.", detail))),
            *early,
            (~aligned & (relation == "MISSING"), rule("UNRELATED", "R4-unscoped", "period", 0.2, say("Nothing to reconcile.", deltas[0]["note"]))),
            (~aligned & (relation == "DISJOINT"), rule("UNRELATED", "R4-different-times", "period", 0.2, say("Different times.", deltas[0]["note"]))),
            (~aligned, rule("RECONCILED", F.concat(F.lit("R4-"), first["dimension"]), first["dimension"], 0.85, say("The contexts explain the difference.", first["note"], detail))),
            (restated, restated_rule),
            ((rel == "EXCLUSIVE") & later, rule("SUPERSEDED", "R6-state-changed", "vintage", 0.85, say("The state changed in between.", deltas[5]["note"], detail))),
            (provisional, provisional_rule),
            ((a["document_id"] == b["document_id"]) & (a["page_number"] == b["page_number"]), rule("UNRELATED", "R7b-same-page-breakdown", "predicate", 0.25, say("Rows of one breakdown.", detail))),
        ]
        last = rule("CONTRADICTS", "R8", none, F.when(dated, 0.9).otherwise(0.7), say("Same context, different values.", detail, F.when(~dated, deltas[5]["note"])))
        return reduce(lambda c, r: c.when(*r), chain[1:], F.when(*chain[0])).otherwise(last)

    return let(off, table)


def judge(a: Column, b: Column, ca: Column, cb: Column, edge: Column, rules: str = "reference", broader: Column | None = None) -> Column:
    """struct<value, deltas, decision> of a pair of facts with their contexts."""
    periods = compare_periods(a["period"], b["period"])

    def all_of(value: Column, relation: Column) -> Column:
        return let(axis_deltas(a, b, ca, cb, relation, broader), lambda d: F.struct(value.alias("value"), d.alias("deltas"), decide(a, b, ca, cb, value, relation, d, rules).alias("decision")))

    return let(compare_values(a, b, edge), lambda v: let(periods, lambda r: all_of(v, r)))
