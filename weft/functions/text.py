"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms; patterns of personal data.
MARKED = "àâäáãçèéêëìíîïñòóôöõùúûüýÿ"
PLAIN = "aaaaaceeeeiiiinooooouuuuyy"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"


def strip_accents(text: Column) -> Column:
    """Lower-cases and removes marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def norm_code(code: Column) -> Column:
    """Upper case; runs of separators become one dash; no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(code), "[^A-Z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column, size: int = 32) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(strip_accents(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def pii_kinds(text: Column) -> Column:
    """Sorted kinds of personal data in the text, never the data."""
    kinds = [F.when(text.rlike(p), F.lit(k)) for k, p in (("email", EMAIL), ("ip", IP), ("phone", PHONE))]
    return F.array_compact(F.array(*kinds))


def redact(text: Column) -> Column:
    for kind, pattern in (("EMAIL", EMAIL), ("IP", IP), ("PHONE", PHONE)):
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def status_of(confidence: Column, low: float, high: float) -> Column:
    return (
        F.when(confidence.isNull(), "missing").when(confidence < low, "unreadable").when(confidence < high, "review")
        .otherwise("known")
    )


def inches_to_mm(inches: Column) -> Column:
    return F.bround(inches * 25.4, 0).cast("long")


def band(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age < 20, "<20").when(age < 35, "20-34").otherwise("35+")


def uniform(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the first 8 hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2**32


def pii_incident(value: Column, key: Column, exempt: dict[str, tuple[str, ...]], identifiers: tuple[str, ...]) -> Column:
    """Sorted kinds for which a field's value may not be kept, empty if it may; null values may.

    `exempt` names for a kind the words in keys of fields where it is no personal data; fields with a word of `identifiers` in
    their key are never kept, whatever they hold.
    """
    def named(words: tuple[str, ...]) -> Column:
        return sum((F.contains(key, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0

    kinds = [F.when(value.rlike(p) & ~named(exempt.get(k, ())), F.lit(k)) for k, p in (("email", EMAIL), ("ip", IP), ("phone", PHONE))]
    found = F.array_sort(F.array_compact(F.array(*kinds, F.when(named(identifiers), F.lit("identifier_field")))))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(found)
