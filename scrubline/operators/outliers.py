"""Outliers: Tukey fences, counts beyond them, capping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.config import CURRENT, CleanConfig
from scrubline.functions.numbers import clip, z_score
from scrubline.jobs import together
from scrubline.operators.columns import batches, number, numeric_columns, quoted, small_frame
from scrubline.operators.exact import WHOLE_TYPE, exact_decimal_quantiles, exact_type, fitted
from scrubline.operators.frequencies import distinct_counts
from scrubline.operators.profile import Moments, moments
from scrubline.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Fence:
    """Capping bounds of one column and what lies beyond them; the bounds of decimals are decimals."""

    column: str
    lower: float | Decimal
    upper: float | Decimal
    mean: float
    std: float  # population
    outside: int = 0
    far: int = 0  # beyond the z limit
    rows: int = 0

    @property
    def pct(self) -> float:
        return self.outside * 100 / self.rows if self.rows else 0.0


def tukey_fences(
    df: DataFrame, cols: Sequence[str] | None = None, config: CleanConfig = CURRENT,
    stats: dict[str, Moments] | None = None,
) -> list[Fence]:
    """Fences of the columns long, varied and spread enough to have outliers.

    The moments found on the way are left in ``stats``.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    known, distinct = together(
        lambda: moments(df, cols), lambda: distinct_counts(df, cols, config.min_outlier_distinct)
    )
    if stats is not None:
        stats.update(known)
    stats = known
    cols = [c for c in cols if stats[c].n >= config.min_outlier_values and distinct[c] > config.min_outlier_distinct]
    kinds = {c: exact_type(df, c, stats[c].min, stats[c].max) for c in cols}
    counts = {c: stats[c].n for c in cols}
    quartiles = exact_quantiles(df, [c for c in cols if not kinds[c]], [0.25, 0.75], counts)
    quartiles |= exact_decimal_quantiles(df, [c for c in cols if kinds[c]], [0.25, 0.75], counts)
    out = []
    for c in cols:
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        factor = Decimal(str(config.fence_factor)) if kinds[c] else config.fence_factor
        reach = factor * (q3 - q1)
        if reach:
            ends = (q1 - reach, q3 + reach)
            ends = tuple(fitted(e, kinds[c]) for e in ends) if kinds[c] else ends
            out.append(Fence(c, *ends, stats[c].mean, stats[c].std_pop))
    return out


def _compared(df: DataFrame, fence: Fence) -> Column:
    """The column in a type in which it compares with its fence without loss."""
    if not isinstance(fence.lower, Decimal):
        return number(fence.column)
    kind = df.schema[fence.column].dataType
    return quoted(fence.column) if isinstance(kind, T.DecimalType) else quoted(fence.column).cast(WHOLE_TYPE)


def count_outside(df: DataFrame, fences: Sequence[Fence], config: CleanConfig = CURRENT) -> list[Fence]:
    """Fences with their counts, all from one scan per few columns; idle fences are left out."""
    out = []
    for some in batches(list(fences), 8):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, f in enumerate(some):
            c, exact = number(f.column), _compared(df, f)
            aggs.append(F.count_if((exact < F.lit(f.lower)) | (exact > F.lit(f.upper))).alias(f"o{i}"))
            aggs.append(F.count_if(F.abs(z_score(c, f.mean, f.std)) > config.z_limit).alias(f"z{i}"))
        row = df.agg(*aggs).first()
        for i, f in enumerate(some):
            if row[f"o{i}"]:
                out.append(Fence(f.column, f.lower, f.upper, f.mean, f.std, row[f"o{i}"], row[f"z{i}"], row["rows"]))
    return out


def cap(df: DataFrame, fences: Sequence[Fence]) -> DataFrame:
    """Bring values beyond a fence onto it. No row is removed.

    Decimals keep their type and long whole numbers become decimals; other numbers become double.
    """
    new = {}
    for f in fences:
        c = _compared(df, f)
        if isinstance(f.lower, Decimal):
            kind = df.schema[f.column].dataType
            kind = kind if isinstance(kind, T.DecimalType) else WHOLE_TYPE
            new[f.column] = clip(c, F.lit(fitted(f.lower, kind)).cast(kind), F.lit(fitted(f.upper, kind)).cast(kind)).cast(kind)
        else:
            new[f.column] = clip(c, f.lower, f.upper)
    return df.withColumns(new)


def outlier_report(df: DataFrame, fences: Sequence[Fence]) -> DataFrame:
    """``ord, column, outside, far, lower, upper, pct`` per capped column."""
    rows = [
        (i, f.column, f.outside, f.far, round(float(f.lower), 4), round(float(f.upper), 4), round(f.pct, 2))
        for i, f in enumerate(fences)
    ]
    return small_frame(
        df, rows,
        "ord int, column string, outside bigint, far bigint, lower double, upper double, pct double",
    )
