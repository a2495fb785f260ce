"""String tests and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a string strip removes (ASCII and Unicode white space).
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"
BOOLEAN = r"^\s*(?i:true|false|yes|no)\s*$"

# Shapes of date text. A bare number is never taken as a date.
_TIME = r"([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|UTC|[+-]\d{2}:?\d{2})?)?"
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}" + _TIME + r"\s*$"
SLASH_DATE = r"^\s*\d{4}/\d{1,2}/\d{1,2}" + _TIME + r"\s*$"
MONTH_FIRST_DATE = r"^\s*\d{1,2}/\d{1,2}/\d{4}" + _TIME + r"\s*$"
NAMED_MONTH_DATES = {
    "d MMM yyyy": r"^\s*\d{1,2} [A-Z][a-z]{2} \d{4}\s*$",
    "d-MMM-yyyy": r"^\s*\d{1,2}-[A-Z][a-z]{2}-\d{4}\s*$",
    "MMM d, yyyy": r"^\s*[A-Z][a-z]{2} \d{1,2}, \d{4}\s*$",
    "MMMM d, yyyy": r"^\s*[A-Z][a-z]{3,8} \d{1,2}, \d{4}\s*$",
}
LEXICAL_CLASSES = ("int", "float", "bool", "date", "text")


def trimmed(text: Column) -> Column:
    """Both ends stripped of every kind of white space (the built-in trim only strips spaces)."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_edge_space(text: Column) -> Column:
    return text.rlike(rf"\A{SPACE}|{SPACE}\z")


def case_key(text: Column) -> Column:
    return F.lower(trimmed(text))


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def parse_timestamp(text: Column) -> Column:
    """Text to ``timestamp_ntz``; anything that is not a whole date becomes NULL."""
    clean = trimmed(text)
    month_first = F.regexp_replace(clean, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    day_first = F.regexp_replace(clean, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$2-$1")
    parsed = (
        F.when(text.rlike(ISO_DATE), clean.try_cast("timestamp_ntz"))
        .when(text.rlike(SLASH_DATE), F.translate(clean, "/", "-").try_cast("timestamp_ntz"))
        .when(
            text.rlike(MONTH_FIRST_DATE),
            F.coalesce(month_first.try_cast("timestamp_ntz"), day_first.try_cast("timestamp_ntz")),
        )
    )
    for pattern, shape in NAMED_MONTH_DATES.items():
        parsed = parsed.when(text.rlike(shape), F.try_to_timestamp(clean, F.lit(pattern)).cast("timestamp_ntz"))
    return parsed


def lexical_class(text: Column) -> Column:
    """What a value looks like: one of ``LEXICAL_CLASSES``."""
    return (
        F.when(text.rlike(INTEGER), "int")
        .when(text.rlike(NUMERIC), "float")
        .when(text.rlike(BOOLEAN), "bool")
        .when(parse_timestamp(text).isNotNull(), "date")
        .otherwise("text")
    )
