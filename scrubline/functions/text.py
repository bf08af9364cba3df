"""Text expressions: fake nulls, whitespace, casing, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value" once trimmed and lower-cased.
FAKE_NULLS = (
    "", "nan", "none", "null", "na", "n/a", "n.a.", "-", "--",
    "nil", "undefined", "unknown", "#n/a", "missing", "not available",
)

# The older variant's tokens, compared exactly and after title-casing.
LEGACY_NULLS = ("Nan", "nan", "None", "none", "NULL", "null", "Na", "N/A", "n/a")

# Every character Unicode counts as white space, plus the ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space (``trim`` alone removes only U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_fakes(c: Column, tokens=FAKE_NULLS) -> Column:
    """NULL where the value is one of the placeholder texts."""
    return F.when(~F.lower(strip(c)).isin(*tokens), c)


def drop_controls(c: Column) -> Column:
    """Remove control and format characters, keeping tab and newline."""
    return F.regexp_replace(c, r"[\p{C}&&[^\t\n]]", "")


def squeeze_spaces(c: Column) -> Column:
    """Trim, and turn each run of white space into one space."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_text(c: Column) -> Column:
    """Control characters out, white space squeezed, empty text to NULL."""
    return F.nullif(squeeze_spaces(drop_controls(c)), F.lit(""))


def title_case(c: Column) -> Column:
    """Capitalise after every character that has no case (``t-SHIRT`` -> ``T-Shirt``).

    ``initcap`` looks only at spaces, so the text is cut into cased and
    caseless runs first and each run is capitalised on its own.
    """
    cased = r"[\p{Lu}\p{Ll}\p{Lt}\p{IsUppercase}\p{IsLowercase}]"
    runs = F.regexp_extract_all(c, F.lit(f"({cased}+|[^{cased[1:-1]}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def humanise(c: Column) -> Column:
    """Identifier to label: underscores to spaces, title case."""
    return title_case(F.replace(c, F.lit("_"), F.lit(" ")))


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
