"""Numbers with more digits than a double holds: order statistics, means and bounds to the last digit.

Casting to double keeps the order of values, so the search on doubles finds the
double of each wanted rank and how many values lie below it. Where several values
share that double, the search goes on among them, on what they exceed the smallest
of them by. Each step settles some 16 digits, so three do for any decimal.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.columns import quoted
from scrubline.operators.quantiles import order_statistics

DOUBLE_WHOLE = 2**53  # whole numbers below are doubles
WIDEST = 38
WHOLE_TYPE = T.DecimalType(24, 4)  # long whole numbers whose bounds have a fraction


def exact_type(df: DataFrame, col: str, low: float | None = None, high: float | None = None) -> T.DecimalType | None:
    """The decimal type in which a column's bounds are exact; None where double is as good.

    ``low`` and ``high`` are the column's ends; whole numbers need decimals only if they are far from zero.
    """
    kind = df.schema[col].dataType
    if isinstance(kind, T.DecimalType):
        return kind
    if isinstance(kind, T.LongType) and low is not None and max(abs(low), abs(high)) >= DOUBLE_WHOLE:
        return WHOLE_TYPE
    return None


def nth_values(df: DataFrame, ranks: dict[str, Sequence[int]], counts: dict[str, int]) -> dict[str, dict[int, Decimal]]:
    """The values at ``ranks`` (from 0, missing values left out) of decimal or whole-number columns."""
    found = order_statistics(df, ranks, counts)
    out: dict[str, dict[int, Decimal]] = {c: {} for c in ranks}
    for c, by_rank in found.items():
        shared: dict[float, list[int]] = {}
        for k, (value, _, _) in by_rank.items():
            shared.setdefault(value, []).append(k)
        for value, same in shared.items():
            x = quoted(c)
            alike = df.where(x.cast("double") == F.lit(value)).select(x.cast(_wide(df.schema[c].dataType)).alias("x"))
            low, high = alike.agg(F.min("x"), F.max("x")).first()
            if low == high:
                out[c].update(dict.fromkeys(same, low))
                continue
            rest = alike.select((F.col("x") - F.lit(low)).cast(alike.schema["x"].dataType).alias("x"))
            places = {k: k - by_rank[k][1] for k in same}
            deeper = nth_values(rest, {"x": sorted(places.values())}, {"x": by_rank[same[0]][2]})["x"]
            with localcontext(prec=2 * WIDEST):
                out[c].update({k: low + deeper[at] for k, at in places.items()})
    return out


def _wide(kind: T.DataType) -> T.DecimalType:
    return T.DecimalType(WIDEST, kind.scale if isinstance(kind, T.DecimalType) else 0)


def exact_decimal_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], counts: dict[str, int]
) -> dict[str, dict[float, Decimal | None]]:
    """Quantiles with linear interpolation, exact; None for a column without values."""
    with localcontext(prec=2 * WIDEST):
        at = {c: {p: Decimal(p) * (counts[c] - 1) for p in probs} for c in cols if counts[c]}
        ranks = {c: sorted({k for x in found.values() for k in (int(x), min(int(x) + 1, counts[c] - 1))}) for c, found in at.items()}
        values = nth_values(df, ranks, counts) if ranks else {}
        out: dict[str, dict[float, Decimal | None]] = {c: dict.fromkeys(probs) for c in cols}
        for c, found in at.items():
            for p, x in found.items():
                low, high = (values[c][k] for k in (int(x), min(int(x) + 1, counts[c] - 1)))
                out[c][p] = low + (high - low) * (x - int(x))
    return out


def exact_means(df: DataFrame, cols: Sequence[str]) -> dict[str, Decimal | None]:
    """Means of decimal columns; None without values, or where the sum has more digits than a decimal."""
    if not cols:
        return {}
    row = df.agg(*[x for i, c in enumerate(cols) for x in (F.try_sum(quoted(c)).alias(f"s{i}"), F.count(quoted(c)).alias(f"n{i}"))]).first()
    with localcontext(prec=2 * WIDEST):
        return {c: row[f"s{i}"] / row[f"n{i}"] if row[f"s{i}"] is not None else None for i, c in enumerate(cols)}


def filled_type(kind: T.DecimalType) -> T.DecimalType:
    """The type of a decimal column with a fill of four decimals, as far as its whole digits leave room."""
    whole = kind.precision - kind.scale
    scale = min(max(kind.scale, 4), WIDEST - whole)
    return T.DecimalType(whole + scale, scale)


def fitted(value: Decimal, kind: T.DecimalType) -> Decimal:
    """``value`` rounded to the type's scale and brought into its range."""
    with localcontext(prec=2 * WIDEST):
        unit = Decimal(1).scaleb(-kind.scale)
        most = Decimal(10) ** (kind.precision - kind.scale) - unit
        return max(-most, min(most, value.quantize(unit, ROUND_HALF_UP)))
