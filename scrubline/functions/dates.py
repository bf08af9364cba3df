"""Date expressions: recognising, parsing, parts, spans, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.text import strip

# Accepted date layouts, in order of preference.
DATE_FORMATS = (
    "yyyy-M-d", "d-M-yyyy", "M-d-yyyy", "d/M/yyyy", "M/d/yyyy",
    "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "yyyyMMdd", "d-MMM-yyyy", "d-MMMM-yyyy",
)

# Layouts tried on the first value of a column; month comes before day when both fit.
GUESS_FORMATS = (
    "yyyy-M-d", "yyyy-M-d HH:mm:ss", "yyyy-M-d HH:mm", "yyyy-M-d'T'HH:mm:ss",
    "yyyy-M-d HH:mm:ss.SSSSSS", "yyyy-M-d'T'HH:mm:ss.SSSSSS",
    "M-d-yyyy", "d-M-yyyy", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d",
    "M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "d/M/yyyy HH:mm",
    "M.d.yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "yyyyMMdd", "d-MMM-yyyy", "d-MMMM-yyyy",
)

# A date-shaped piece anywhere in the text.
DATE_SHAPE = r"\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}"

# The older variant's date shapes.
LEGACY_DATE_SHAPE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{1,2} \w+ \d{4}"

_FIELD_SHAPES = {
    "yyyyMMdd": r"\d{8}",
    "yyyy": r"\d{4}",
    "MMMM": r"\p{L}+",
    "MMM": r"\p{L}+",
    "SSSSSS": r"\d{6}",
    "HH": r"\d{2}",
    "mm": r"\d{2}",
    "ss": r"\d{2}",
    "M": r"\d{1,2}",
    "d": r"\d{1,2}",
    "'T'": "T",
    ".": r"\.",
}


def _shape(fmt: str) -> str:
    """Regular expression for the texts a layout can match."""
    out, rest = "", fmt
    while rest:
        field = next((f for f in _FIELD_SHAPES if rest.startswith(f)), rest[0])
        out += _FIELD_SHAPES.get(field, field)
        rest = rest[len(field):]
    return f"^{out}$"


def parse_date(c: Column, fmt: str) -> Column:
    """Text in one layout to a zone-free timestamp, NULL when it does not fit.

    The shape test runs first: a failed parse costs an exception per row.
    """
    t = strip(c)
    return F.when(t.rlike(_shape(fmt)), F.try_to_timestamp(t, F.lit(fmt))).cast("timestamp_ntz")


def parse_mixed_date(c: Column, formats=DATE_FORMATS) -> Column:
    """First layout that fits, value by value."""
    return F.coalesce(*[parse_date(c, f) for f in formats])


def looks_like_date(c: Column) -> Column:
    """True for a text in a known layout, or one holding a date-shaped piece."""
    t = strip(c)
    # six and seven digits read as year, month and day of one or two digits
    compact = t.rlike(r"^\d{4}(0?[1-9]|1[0-2])(0?[1-9]|[12]\d|3[01])$")
    known = reduce(lambda a, b: a | b, [parse_date(t, f).isNotNull() for f in DATE_FORMATS])
    return t.rlike(DATE_SHAPE) | compact | known


def date_parts(c: Column, base: str) -> list[Column]:
    """Year, month and quarter columns."""
    return [
        F.year(c).alias(f"{base}_year"),
        F.month(c).alias(f"{base}_month"),
        F.quarter(c).alias(f"{base}_quarter"),
    ]


def feature_base(name: str) -> str:
    """Column name without its date word: the stem of the derived columns."""
    for word in ("_date", "date_"):
        name = name.replace(word, "")
    return name.strip("_")


def span_days(first: Column, last: Column) -> Column:
    """Whole 24-hour periods between two moments."""
    return F.timestamp_diff("DAY", first, last)


def month_end(c: Column) -> Column:
    """Month bucket, labelled by its last day."""
    return F.last_day(c)


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def day_label(c: Column) -> Column:
    return F.date_format(c, "dd MMM yyyy")


def month_label(c: Column) -> Column:
    return F.date_format(c, "MMM yyyy")
