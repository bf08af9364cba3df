"""Column profiles: counts, moments, completeness, descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.numbers import round_even, variation_pct
from scrubline.jobs import together
from scrubline.operators.columns import (
    batches, data_columns, number, numeric_columns, quoted, small_frame,
)
from scrubline.operators.quantiles import exact_quantiles

BATCH = 8  # columns per aggregation


@dataclass(frozen=True)
class Moments:
    """One column's numbers. All but ``n`` are None for an empty column."""

    n: int
    mean: float | None
    std: float | None  # sample
    min: float | None
    max: float | None
    total: float | None
    skew: float | None  # bias-adjusted

    @property
    def std_pop(self) -> float | None:
        return None if self.std is None else self.std * sqrt((self.n - 1) / self.n)


def adjusted_skew(c: Column) -> Column:
    """Bias-adjusted skewness: NULL below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(g1, F.lit(0.0)))


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, Moments]:
    """Moments of numeric columns, one aggregation per few columns."""
    out = {}
    for some in batches(list(cols), BATCH):
        row = df.agg(
            *[
                F.struct(
                    F.count(x), F.stddev_samp(x), F.min(x), F.max(x), F.sum(x), adjusted_skew(x)
                ).alias(f"m{i}")
                for i, x in enumerate(map(number, some))
            ]
        ).first()
        for i, c in enumerate(some):
            n, std, low, high, total, skew = row[f"m{i}"]
            out[c] = Moments(n, total / n if n else None, std, low, high, total, skew)
    return out


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows, and missing values per column, in one scan."""
    cols = list(cols if cols is not None else data_columns(df))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)],
    ).first()
    return row["rows"], {c: row[f"c{i}"] for i, c in enumerate(cols)}


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, missing values, rows and the missing share in percent."""
    cols = data_columns(df)
    cells = [
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"c{i}").alias("nulls"), F.col("rows"))
        for i, c in enumerate(cols)
    ]
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(quoted(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)],
    )
    return counted.select(F.inline(F.array(*cells))).withColumn(
        "null_pct", F.coalesce(F.try_divide(F.col("nulls") * 100, F.col("rows")), F.lit(0.0))
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and completeness in percent."""
    per_column = null_profile(df)
    return per_column.agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("rows").alias("cells"),
        F.sum("nulls").alias("nulls"),
    ).withColumn("completeness_pct", (1 - F.coalesce(F.try_divide("nulls", "cells"), F.lit(0.0))) * 100)


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, spread, range, missing and skew of each numeric column with values."""
    cols = list(cols if cols is not None else numeric_columns(df))
    m, (_, nulls) = together(lambda: moments(df, cols), lambda: null_counts(df, cols))
    q = exact_quantiles(df, cols, [0.5], {c: m[c].n for c in cols})
    rows = [
        (i, c, m[c].n, nulls[c], m[c].mean, q[c][0.5], m[c].std, m[c].min, m[c].max, m[c].skew)
        for i, c in enumerate(cols)
        if m[c].n
    ]
    schema = (
        "ord int, column string, n bigint, missing bigint, mean double, median double, "
        "std double, min double, max double, skew double"
    )
    return small_frame(df, rows, schema).select(
        "ord", "column", "n", "missing",
        *[round_even(F.col(c), 2).alias(c) for c in ("mean", "median", "std", "min", "max", "skew")],
    )


def describe(df: DataFrame, first: int = 8) -> DataFrame:
    """Mean, sample deviation, range and quartiles of the first numeric columns."""
    cols = numeric_columns(df)[:first]
    m = moments(df, cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], {c: m[c].n for c in cols})
    rows = [
        (i, c, m[c].n, m[c].mean, m[c].std, m[c].min, q[c][0.25], q[c][0.5], q[c][0.75], m[c].max)
        for i, c in enumerate(cols)
    ]
    schema = (
        "ord int, column string, n bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    return small_frame(df, rows, schema).select(
        "ord", "column", "n",
        *[round_even(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def variation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Coefficient of variation in percent per numeric column."""
    cols = list(cols if cols is not None else numeric_columns(df))
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            variation_pct(F.col(f"s{i}"), F.col(f"m{i}")).alias("variation_pct"),
        )
        for i, c in enumerate(cols)
    ]
    parts = [a for i, c in enumerate(cols)
             for a in (F.avg(number(c)).alias(f"m{i}"), F.stddev_samp(number(c)).alias(f"s{i}"))]
    return df.agg(*parts).select(F.inline(F.array(*cells)))
