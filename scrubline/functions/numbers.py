"""Number expressions: parsing, clipping, scores, rounding, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline.functions.text import WHITESPACE, strip

# Symbols removed before a money text is read as a number.
CURRENCY_SYMBOLS = "$€£¥₹₩₪₺,"


def to_number(c: Column) -> Column:
    """Text to double, NULL when it is no number."""
    return _number(strip(c))


def _number(t: Column) -> Column:
    """Trimmed text to double.

    The added exponent changes no number, but keeps out the ``1d``/``1f``
    spellings and the ``inf``/``nan`` words the cast alone would accept.
    """
    plain = F.concat(t, F.lit("e0")).try_cast("double")
    return F.coalesce(plain, F.when(t.rlike(r"^[+-]?[\d.]+[eE][+-]?\d+$"), t.try_cast("double")))


def parse_currency(c: Column) -> Column:
    """Remove money symbols, thousands separators and white space, then read the number."""
    return _number(F.translate(c, CURRENCY_SYMBOLS + WHITESPACE, ""))


def parse_percent(c: Column) -> Column:
    """Drop trailing percent signs, read the number, divide by 100."""
    return to_number(F.rtrim(strip(c), F.lit("%"))) / 100


def finite(c: Column) -> Column:
    """NaN folded to NULL: missing means NULL everywhere in this library."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, lower, upper) -> Column:
    """Values beyond a bound become the bound; NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lower), F.least(c, F.lit(upper))))


def z_score(c: Column, mean, std) -> Column:
    """Distance from the mean in standard deviations, NULL when there is no spread."""
    return F.try_divide(c - F.lit(mean), F.lit(std))


def round_even(c: Column, digits: int) -> Column:
    """Round half to even in binary floating point, without a negative zero."""
    unit = 10.0**digits
    return F.rint(c.cast("double") * unit) / unit + 0.0


def variation_pct(std: Column, mean: Column) -> Column:
    """Coefficient of variation in percent, 0 for a zero mean."""
    return F.when(mean == 0, F.lit(0.0)).otherwise(F.try_divide(std, mean) * 100)


def quality_band(score: Column) -> Column:
    """Traffic light for a quality score."""
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def clamp_pct(c: Column) -> Column:
    """Bring a score into 0..100 for display."""
    return clip(c, 0.0, 100.0)


def _fixed(c: Column, digits: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def compact(c: Column, digits: int = 2, big_digits: int = 1) -> Column:
    """Short label: millions as ``x.xM``, thousands as ``x.xK``, else separators and decimals."""
    v = c.cast("double")
    return (
        F.when(F.abs(v) >= 1e6, F.concat(_fixed(v / 1e6, big_digits), F.lit("M")))
        .when(F.abs(v) >= 1e3, F.concat(_fixed(v / 1e3, big_digits), F.lit("K")))
        .otherwise(F.format_number(v, digits))
    )


def compact_axis(c: Column) -> Column:
    """Chart label: as ``compact`` with one decimal, three for a fraction below one."""
    v = c.cast("double")
    return F.when((F.abs(v) < 1) & (v != 0), _fixed(v, 3)).otherwise(compact(v, 1))


def compact_dashboard(c: Column) -> Column:
    """Dashboard label: at most two decimals, a dash for no value."""
    v = finite(c.cast("double"))
    plain = F.regexp_replace(F.format_number(v, 2), r"\.?0+$", "")
    return F.coalesce(F.when(F.abs(v) >= 1000, compact(v)).otherwise(plain), F.lit("—"))


def as_written(c: Column, data_type: str) -> Column:
    """Number as plain decimal text; ``cast`` alone turns exponential at ten million."""
    text = c.cast("string")
    if data_type not in ("double", "float"):
        return text
    plain = F.regexp_replace(c.cast("decimal(38,17)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(text)
