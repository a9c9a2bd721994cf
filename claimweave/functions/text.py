"""Normal forms of names, organisations, addresses, states and subjects, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import AT, TO, col, let, lookup, squash, words_at

# Words that carry no identity in a person's name, at the end of an organisation's, and alone.
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "shri", "sri", "smt", "sh", "md", "cs", "ca", "adv", "hon", "honble", "justice"]
ORG_SUFFIXES = ["limited", "ltd", "private", "pvt", "plc", "llp", "inc", "incorporated", "corporation", "corp", "company", "co", "holdings", "group"]
ARTICLES = ["the", "a", "an", "of", "and"]
# Abbreviations in addresses, and former names of places.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "ln": "lane", "blvd": "boulevard", "hwy": "highway", "mg": "mahatma gandhi",
    "no": "", "nos": "", "flr": "floor", "fl": "floor", "bldg": "building", "bldgs": "building", "opp": "opposite", "nr": "near",
    "ph": "phase", "sec": "sector", "ext": "extension", "dist": "district", "po": "post office", "ps": "police station",
    "apt": "apartment", "ste": "suite",
}
PLACES = {
    "gurgaon": "gurugram", "bangalore": "bengaluru", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai", "poona": "pune",
    "baroda": "vadodara", "trivandrum": "thiruvananthapuram", "cochin": "kochi", "mysore": "mysuru", "pondicherry": "puducherry",
    "orissa": "odisha", "uttaranchal": "uttarakhand", "gauhati": "guwahati",
}
# Words of a hint that tell what a value is; the first list that matches decides.
ADDRESS_HINTS = ["address", "office", "premises", "location", "situated", "registered"]
PERSON_HINTS = ["director", "officer", "person", "name", "chairman", "ceo", "cfo", "secretary", "auditor", "promoter"]
ORG_HINTS = ["company", "subsidiary", "entity", "issuer", "firm", "bank", "institution"]


@lru_cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks: one character for one, and the longer ones."""
    one, to, more = [], [], {}
    for k in range(0xA0, 0xFFFF):
        c = chr(k)
        if 0xAC00 <= k <= 0xD7A3 or 0xD800 <= k <= 0xDFFF or 0x300 <= k <= 0x36F:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ")
        if d != c:
            if len(d) == 1:
                one.append(c)
                to.append(d)
            else:
                more[c] = d
    return "".join(one), "".join(to), more


def _decomposed(c: Column) -> Column:
    """NFKD without U+0300-036F, for the characters of the basic plane but Hangul syllables."""
    one, to, _ = _folds()
    return F.when(c.rlike("^[\\x00-\\x7f]*$"), c).otherwise(let(F.regexp_replace(F.translate(c, one, to), "[\\u0300-\\u036f]", ""), _expanded))


def _expanded(marks: Column) -> Column:
    """Ligatures, fractions and signs spelled out."""
    more = _folds()[2]
    rare = {k: v for k, v in more.items() if not (0x3200 <= ord(k) <= 0xFAFF or 0xFB50 <= ord(k) <= 0xFDFF)}
    single = F.array_join(F.transform(F.split(marks, ""), lambda x: F.coalesce(lookup(rare, x), x)), "")
    odd = "[" + "".join(f"\\u{ord(k):04x}" for k in rare) + "]"
    return F.when(marks.rlike(odd), single).otherwise(marks)


def normalize_text(c: Column | str) -> Column:
    """Lower case, no marks, no punctuation, single spaces; null becomes empty."""
    low = F.lower(_decomposed(F.coalesce(col(c), F.lit(""))))
    return squash(F.regexp_replace(low, "[^\\p{L}\\p{N}\\s]", " "))


def _split(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def tokens(c: Column | str) -> Column:
    return _split(normalize_text(c))


def _without(words: Column, drop: list[str]) -> Column:
    return F.filter(words, lambda t: ~t.isin(drop))


def _trailing(text: Column) -> Column:
    """text without the legal forms at its end."""
    return F.regexp_replace(text, "(?:(?:^| )(?:" + "|".join(ORG_SUFFIXES) + "))+$", "")


def normalize_person_name(c: Column | str) -> Column:
    return F.array_join(F.array_sort(_without(tokens(c), HONORIFICS)), " ")


def normalize_org_name(c: Column | str) -> Column:
    return let(normalize_text(c), lambda norm: _identifying(_trailing(norm), norm))


def _identifying(short: Column, full: Column) -> Column:
    """short, unless nothing but articles is left of it."""
    return let(short, lambda s: F.when(F.size(_without(_split(s), ARTICLES)) > 0, s).otherwise(full))


def normalize_address(c: Column | str) -> Column:
    full = F.array_join(F.transform(tokens(c), lambda t: F.coalesce(lookup(ADDRESS_WORDS, t), t)), " ")
    return F.array_join(F.transform(_split(full), lambda t: F.coalesce(lookup(PLACES, t), t)), " ")


def normalize_categorical(c: Column | str) -> Column:
    text = normalize_text(c)
    for tail in (AT + r"w\s*e\s*f" + TO, AT + "with effect from" + TO, AT + "as (?:at|on|of)" + TO, AT + r"\d{1,2}\s+\d{4}" + TO):
        text = F.regexp_replace(text, tail + ".*$", "")
    return F.trim(text)


def normalize_subject(c: Column | str) -> Column:
    """What a fact is about: no honorifics, no legal form at the end, words in order."""
    plain = lambda norm: F.array_join(_without(_split(norm), HONORIFICS), " ")
    return let(normalize_text(c), lambda norm: let(plain(norm), lambda p: _identifying(_trailing(F.coalesce(F.nullif(p, F.lit("")), norm)), p)))


def normalize_by_hint(value: Column | str, hint: Column | str) -> Column:
    return let(normalize_text(hint), lambda h: _hinted(col(value), h))


def _hinted(value: Column, hint: Column) -> Column:
    return (
        F.when(hint.rlike(words_at(ADDRESS_HINTS)), normalize_address(value))
        .when(hint.rlike(words_at(PERSON_HINTS)), normalize_person_name(value))
        .when(hint.rlike(words_at(ORG_HINTS)), normalize_org_name(value))
        .otherwise(normalize_text(value))
    )


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """Dice coefficient of the token sets; 0 if one is empty."""
    return let(F.array_distinct(tokens(a)), lambda x: let(F.array_distinct(tokens(b)), lambda y: _dice(x, y)))


def _dice(x: Column, y: Column) -> Column:
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double")))


def title_from_filename(name: Column | str) -> Column:
    base = F.regexp_replace(F.substring_index(col(name), "/", -1), r"\.[^.]*$", "")
    base = F.regexp_replace(F.regexp_replace(base, "(?i)^up_[a-z0-9]+_", ""), r"^\d+[-_]", "")
    words = F.split(F.trim(F.regexp_replace(base, "[-_]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")
