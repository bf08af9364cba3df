"""Summaries behind charts: key figures, monthly trend, category by number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.dates import month_end
from scrubline.functions.numbers import compact_axis
from scrubline.operators.columns import number, numeric_columns, quoted
from scrubline.operators.frequencies import most_frequent

BIG_TOTAL = 9999  # a sum above this is shown as total, else the mean is


def key_figures(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``ord, column, label, value, text``: total or mean of each column."""
    cols = list(cols if cols is not None else numeric_columns(df))
    wide = df.agg(
        *[a for i, c in enumerate(cols) for a in (F.sum(number(c)).alias(f"s{i}"), F.avg(number(c)).alias(f"m{i}"))]
    )
    cells = []
    for i, c in enumerate(cols):
        big = F.col(f"s{i}") > BIG_TOTAL
        cells.append(
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(c).alias("column"),
                F.when(big, "Total").otherwise("Mean").alias("label"),
                F.when(big, F.col(f"s{i}")).otherwise(F.col(f"m{i}")).alias("value"),
            )
        )
    return wide.select(F.inline(F.array(*cells))).withColumn("text", compact_axis(F.col("value")))


def monthly_trend(df: DataFrame, date: str, value: str) -> DataFrame:
    """Monthly mean with a 3-month rolling mean and a straight-line trend.

    Only months with values appear. The windows run over the months, of which
    a calendar has few; the rows themselves are aggregated by month first.
    """
    monthly = (
        df.where(quoted(date).isNotNull() & number(value).isNotNull())
        .groupBy(month_end(quoted(date)).alias("month"))
        .agg(F.avg(number(value)).alias("mean"))
    )
    by_month = Window.orderBy("month")
    whole = Window.partitionBy()
    x, y = F.col("idx").cast("double"), F.col("mean")
    slope, intercept = F.regr_slope(y, x).over(whole), F.regr_intercept(y, x).over(whole)
    r = F.try_divide(
        F.covar_pop(x, y).over(whole), F.stddev_pop(x).over(whole) * F.stddev_pop(y).over(whole)
    )
    return (
        monthly.withColumn("idx", F.row_number().over(by_month) - 1)
        .withColumn("months", F.count(F.lit(1)).over(whole))
        .withColumn(
            "rolling", F.when(F.col("months") >= 4, F.avg("mean").over(by_month.rowsBetween(-2, 0)))
        )
        .withColumns({"slope": slope, "intercept": intercept, "r": r})
        .withColumn("trend", F.col("slope") * x + F.col("intercept"))
        .withColumn("direction", F.when(F.col("slope") > 0, "up").otherwise("down"))
    )


def category_summary(df: DataFrame, category: str, value: str, k: int = 8) -> DataFrame:
    """Mean, sum, count and share of a number within the ``k`` most frequent categories.

    One aggregation over all categories answers both which are frequent and
    what they hold, so the table is read once and joined with nothing.
    """
    x = number(value)
    grouped = (
        df.where(quoted(category).isNotNull())
        .groupBy(quoted(category).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(x).alias("mean"),
            F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"),
            F.count(x).alias("count"),
        )
        .orderBy(F.desc("rows"), "category")
        .limit(k)
    )
    share = F.try_divide(F.col("sum") * 100, F.sum("sum").over(Window.partitionBy()))
    return grouped.withColumn("share_pct", share).orderBy(F.desc("sum"), "category")


def members_of_top(df: DataFrame, category: str, k: int = 8) -> DataFrame:
    """The rows whose category is among the ``k`` most frequent."""
    top = most_frequent(df, category, k).select(F.col("value").alias("_top"))
    return df.join(F.broadcast(top), quoted(category) == F.col("_top"), "left_semi")
