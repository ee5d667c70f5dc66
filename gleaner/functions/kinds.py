"""Field kinds: inference from names, plausibility and normal forms of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog as C
from .text import is_blank, trim


def infer_kind(name: Column) -> Column:
    """The kind of a field by its name: an exact synonym, first in catalogue
    order; else the longest synonym that contains or is contained in the name,
    first among equals; else Text."""
    tokens = [(kind, token) for kind, tokens in C.SYNONYMS.items() for token in tokens]
    known = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("token"), F.lit(len(t)).alias("size"), F.lit(-i).alias("early")) for i, (k, t) in enumerate(tokens)))

    def pick(n: Column) -> Column:
        exact = F.try_element_at(F.filter(known, lambda c: c["token"] == n), F.lit(1))["kind"]
        near = F.filter(known, lambda c: n.contains(c["token"]) | c["token"].contains(n))
        best = F.array_max(F.transform(near, lambda c: F.struct(c["size"].alias("size"), c["early"].alias("early"), c["kind"].alias("kind"))))["kind"]
        return F.when(n == "", "Text").otherwise(F.coalesce(exact, best, F.lit("Text")))

    # The name is prepared once, as the element of a one-item array.
    return F.transform(F.array(F.coalesce(F.lower(trim(name)), F.lit(""))), pick)[0]


def tokens_of(name: str, kind: str) -> list[str]:
    """What labels a field: its name and, but for numbers, its kind's synonyms."""
    own = [name.strip().lower()]
    return [t for t in dict.fromkeys(own + (C.SYNONYMS.get(kind, []) if kind != "Number" else [])) if t]


def has_shape(kind: str, value: Column) -> Column:
    out = F.lit(False)
    for pattern in C.PATTERNS[kind]:
        out = out | value.rlike(pattern)
    return out


def plausible(kind: Column, value: Column) -> Column:
    """Whether a value can be of its kind at all."""
    v = trim(value)
    n, digits = F.length(v), F.length(F.regexp_replace(v, r"(?U)\D", ""))
    rule = (
        F.when(kind == "Currency", has_shape("Currency", v))
        .when(kind == "Email", has_shape("Email", v))
        .when(kind == "Phone", has_shape("Phone", v) & (digits > 0))
        .when(kind == "Url", has_shape("Url", v) | v.contains("/"))
        .when(kind == "Rating", has_shape("Rating", v))
        .when(kind == "Number", digits.between(1, 4))
        .when(kind == "Location", n.between(2, 1000) & ~has_shape("Currency", v) & ~has_shape("Email", v) & ~has_shape("Phone", v))
        .when(kind == "Name", n.between(2, 150))
        .when(kind == "Biography", n.between(20, 8000))
        .otherwise(n <= 3000)
    )
    return F.when(is_blank(value), F.lit(False)).otherwise(rule)


def normal_number(value: Column) -> Column:
    """Digits and commas stay; else the first count of years; else nothing."""
    v = trim(value)
    found = F.regexp_extract(v, C.PATTERNS["Number"][0], 0)
    return F.when(v.rlike(r"^[0-9,]+$"), v).when(found != "", found)


def normal_currency(value: Column) -> Column:
    """A short value that shows an amount stays; of a longer one its distinct
    amounts; without any, short text stays and long text goes."""
    v = trim(value)
    a, b = (F.regexp_extract_all(v, F.lit(p), F.lit(0)) for p in C.PATTERNS["Currency"])
    amounts = F.array_distinct(F.transform(F.concat(a, b), trim))
    return F.when(has_shape("Currency", v) & (F.length(v) <= 200), v).when(F.size(amounts) > 0, F.array_join(amounts, "; ")).when(F.length(v) <= 60, v)


def normal(kind: Column, value: Column) -> Column:
    return F.when(kind == "Number", normal_number(value)).when(kind == "Currency", normal_currency(value)).otherwise(value)


def _tidy(values: Column) -> Column:
    """Trimmed, without end commas and stops, without empty and noisy ones."""
    tidy = F.transform(values, lambda v: F.regexp_replace(trim(v), "[,.]+$", ""))
    noisy = F.array(*map(F.lit, C.LOCATION_NOISE))
    return F.filter(tidy, lambda v: (v != "") & ~F.exists(noisy, lambda w: F.lower(v).contains(w)))


def every_match(kind: str, text: Column, most: int = 10) -> Column:
    """All distinct values of the first pattern that yields any, joined."""
    group = 1 if kind == "Location" else 0
    found = [F.slice(F.array_distinct(_tidy(F.regexp_extract_all(text, F.lit(p), F.lit(group)))), 1, most) for p in C.PATTERNS[kind]]
    return F.coalesce(*(F.when(F.size(f) > 0, F.array_join(f, "; ")) for f in found))


def first_match(kind: str, text: Column) -> Column:
    """The first value of the first pattern that matches."""
    hits = (F.regexp_extract(text, p, 0) for p in C.PATTERNS[kind])
    return F.coalesce(*(F.when(h != "", F.regexp_replace(trim(h), "[,.]+$", "")) for h in hits))


def scannable(text: Column) -> Column:
    """Text without web addresses, whose digits look like phone numbers."""
    return F.regexp_replace(text, r"https?://\S+", " ")


def looks_like_name(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    titled = F.size(words).between(2, 5) & F.lower(F.regexp_replace(words[0], r"\.+$", "")).isin(C.HONORIFICS)
    return F.coalesce(titled | (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= 2), F.lit(False))
