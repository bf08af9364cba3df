"""Normality tests per numeric column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.columns import ROW_ID, number, numeric_columns, quoted, small_frame
from scrubline.operators.ordering import is_numbered
from scrubline.operators.roles import ranked_by_number

SAMPLE = 50
_TESTED = "column string, n bigint, w double, p double"
SEED = 42
CHUNK = 1_000_000  # copies of a value numbered in one row of the plan


def jarque_bera(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, n, statistic, p`` from skewness and kurtosis of all values."""
    cols = list(cols if cols is not None else numeric_columns(df))
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(number(c)).alias("n"),
                F.skewness(number(c)).alias("s"),
                F.kurtosis(number(c)).alias("k"),
            ).alias(f"c{i}")
            for i, c in enumerate(cols)
        ]
    )
    tall = wide.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cols))])))
    statistic = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return tall.select("column", "n", statistic.alias("statistic"), F.exp(-statistic / 2).alias("p"))


def hashed_sample(df: DataFrame, col: str, k: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``k`` values drawn by a digest of the value and the number of its copy: the same ones on every layout.

    Copies of a value draw apart from each other, so the sample has each value
    as often as the column has it, by chance. Copies are numbered in chunks,
    which are dealt out anew: a value with a third of all rows fills no single task.
    """
    counts = df.select(number(col).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    chunks = counts.select("value", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk"))
    first, last = F.col("chunk") * CHUNK + 1, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK)
    copies = chunks.repartition("value", "chunk").select("value", F.explode(F.sequence(first, last)).alias("copy"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("value").cast("string"), F.col("copy").cast("string")))
    return copies.withColumn("_draw", draw).orderBy("_draw", "value").limit(k).select(F.lit(col).alias("column"), "value")


def keyed_sample(df: DataFrame, cols: Sequence[str], key: Sequence[str], k: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``column, value``: ``k`` values of each column, drawn by a digest of the row's key, of all columns in one scan.

    Each task keeps the rows with the ``k`` smallest digests per column. ``key`` tells
    rows apart: rows of equal key are drawn together.
    """
    parts = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in key]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")
    values = {c: number(c).cast("string") for c in cols}  # a double's text gives the double back
    drawn = df.select(draw.alias(ROW_ID), *[v.alias(c) for c, v in values.items()])
    return ranked_by_number(drawn, {c: quoted(c) for c in cols}, k).select("column", F.col("value").cast("double").alias("value"))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(float(x)) for x in p])


# Royston's 1995 polynomials for the weights and the null distribution.
_WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_LOG_STD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_STD = (-0.4803, -0.082676, 0.0030302)
_SMALL_SHIFT = (-2.273, 0.459)


def weights(n: int) -> np.ndarray:
    """Weights of the ordered values of a sample of 4 to 50."""
    m = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    size, u = float(m @ m), 1 / np.sqrt(n)
    a = m / np.sqrt(size)
    last = a[-1] + _poly(_WEIGHT_LAST, u)
    if n > 5:
        nxt = a[-2] + _poly(_WEIGHT_NEXT, u)
        phi = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
        a = m / np.sqrt(phi)
        a[[0, 1, -2, -1]] = -last, -nxt, nxt, last
    else:
        phi = (size - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / np.sqrt(phi)
        a[[0, -1]] = -last, last
    return a


def _poly(coefficients, at) -> float:
    return float(np.polynomial.polynomial.polyval(at, coefficients))


def shapiro_wilk(values: np.ndarray) -> tuple[float | None, float | None]:
    """W and p of a sample of 4 to 50 values; neither for fewer or for a constant sample."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return None, None
    a = weights(n)
    centred = x - x.mean()
    w = min(float((a @ x) ** 2 / (centred @ centred)), 1.0)

    from statistics import NormalDist

    if w >= 1.0:
        return 1.0, 1.0
    y = np.log(1 - w)
    if n <= 11:
        limit = _poly(_SMALL_SHIFT, n)
        if y >= limit:
            return w, 0.0
        y, mean, std = -np.log(limit - y), _poly(_SMALL_MEAN, n), np.exp(_poly(_SMALL_LOG_STD, n))
    else:
        mean, std = _poly(LARGE_MEAN, np.log(n)), np.exp(_poly(LARGE_LOG_STD, np.log(n)))
    return w, 1 - NormalDist(mean, float(std)).cdf(float(y))


def shapiro_sample(
    df: DataFrame, cols: Sequence[str] | None = None, k: int = SAMPLE, order_by: Sequence[str] | None = None
) -> DataFrame:
    """``column, n, w, p`` of the Shapiro-Wilk test on ``k`` sampled values per column; no column without values.

    With a row number or a key ``order_by`` the values are drawn in one scan. Without
    either, equal rows could not be told apart, and values and copies are counted first.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    if not cols:
        return small_frame(df, [], _TESTED)
    key = list(order_by) if order_by else [ROW_ID] if is_numbered(df) else []
    if key:
        sample = keyed_sample(df, cols, key, k)
    else:
        sample = reduce(DataFrame.unionByName, [hashed_sample(df, c, k) for c in cols])
    drawn = {r["column"]: r["values"] for r in sample.groupBy("column").agg(F.collect_list("value").alias("values")).collect()}
    rows = [(c, len(drawn[c]), *shapiro_wilk(np.array(drawn[c]))) for c in cols if c in drawn]
    return small_frame(df, rows, _TESTED)
