"""Report tables: what a written report shows, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.numbers import round_even

from scrubline.functions.text import truncate
from scrubline.operators.columns import data_columns, numeric_columns, row_order, small_frame
from scrubline.operators.frequencies import distinct_counts, distinct_estimates, near
from scrubline.operators.missing import fill_log
from scrubline.operators.profile import null_counts, numeric_stats, table_shape
from scrubline.operators.roles import Role, first_values
from scrubline.plans.cleaning import Cleaned, Report
from scrubline.plans.insights import OVERVIEW

SCHEMA_COLUMNS, FILL_ROWS, RENAME_ROWS, STEP_ROWS = 20, 12, 15, 8
FEW = 1000  # distinct values up to which an approximate schema table counts exactly
NO_STEPS = "No cleaning steps were needed."

METHODS = (
    ("Names and roles", "Column names become snake case; each column gets a role from its name, type and first values."),
    ("Missing values", "Numbers get the mean or, when skewed, the median; labels the mode or Unknown; dates their neighbour's."),
    ("Duplicates", "Exact copies go first, then repeats of the first id and date column."),
    ("Text", "Hidden characters and placeholder texts are removed, spacing is evened out, labels are put in title case."),
    ("Dates", "Date texts are parsed; year, month and quarter are added where at least ten dates differ."),
    ("Outliers", "Numbers beyond 1.5 interquartile ranges from the quartiles are capped, never removed."),
    ("Quality score", "Completeness 40, uniqueness 20, consistency 30 and validity 10 points."),
)


def key_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric columns, completeness."""
    return table_shape(df).select(
        "rows", "columns", F.lit(len(numeric_columns(df))).alias("numeric_fields"),
        round_even(F.col("completeness_pct"), 1).alias("completeness_pct"),
    )


def schema_table(
    df: DataFrame, roles: Sequence[Role], order_by: Sequence[str] | None = None, first: int = SCHEMA_COLUMNS,
    approx: bool = False,
) -> DataFrame:
    """Field, type, role, filled and distinct values and the first value of the leading columns.

    An exact distinct count shuffles a digest of every value; with ``approx`` only
    columns of few values are counted, the others have no ``unique``, and
    ``unique_about`` holds the estimate of every column.
    """
    cols = data_columns(df)[:first]
    rows, nulls = null_counts(df, cols)
    simple = [f.name for f in df.schema.fields if f.name in cols and f.dataType.simpleString().find("<") < 0]
    about = distinct_estimates(df, cols) if approx else {}
    distinct = distinct_counts(df, near(about, FEW) if approx else cols)
    filled = {c: rows - nulls[c] for c in cols}
    by_role = {r.column: r.role for r in roles}
    types = dict(df.dtypes)
    table = small_frame(
        df,
        [(i, c, types[c], by_role.get(c, "—"), filled[c], distinct.get(c), about.get(c)) for i, c in enumerate(cols)],
        "ord int, field string, type string, role string, non_null bigint, unique bigint, unique_about bigint",
    )
    table = table if approx else table.drop("unique_about")
    samples = first_values(df, simple, row_order(df, order_by), 1, rows, filled)
    samples = samples.select(F.col("column").alias("field"), F.substring("value", 1, 20).alias("sample"))
    return table.join(F.broadcast(samples), "field", "left").withColumn("sample", F.coalesce("sample", F.lit("—")))


def comparison(cleaned: Cleaned) -> DataFrame:
    """Rows, missing values, duplicates and score, before and after."""
    r = cleaned.report
    pairs = (
        ("rows", r.rows_before, r.rows_after),
        ("missing", sum(r.nulls_before.values()), sum(r.nulls_after.values())),
        ("duplicates", r.duplicates_before, r.duplicates_after),
        ("score", r.quality_before, r.quality_after),
    )
    rows = [(i, name, float(a), float(b)) for i, (name, a, b) in enumerate(pairs)]
    table = small_frame(cleaned.table, rows, "ord int, metric string, before double, after double")
    gain = F.when(F.col("metric") == "score", F.col("after") - F.col("before")).otherwise(
        F.col("before") - F.col("after")
    )
    return table.withColumn("improvement", round_even(gain, 1))


def fill_detail(cleaned: Cleaned, first: int = FILL_ROWS) -> DataFrame:
    """Field, count, share, strategy and value of the leading fills."""
    return (
        fill_log(cleaned.table, cleaned.report.fills)
        .where(F.col("ord") < first)
        .withColumn("fill_value", truncate(F.col("fill_value"), 20))
    )


def findings(insights: DataFrame) -> DataFrame:
    """Findings grouped by category in first-seen order, the overview left out."""
    by_category = Window.partitionBy("category")
    first = F.min(F.struct("chapter", "ord", "place")).over(by_category)
    return (
        insights.withColumn("_first", first)
        .where(F.col("category") != OVERVIEW)
        .orderBy("_first", "chapter", "ord", "place")
        .drop("_first")
    )


def rename_log(cleaned: Cleaned, first: int = RENAME_ROWS) -> DataFrame:
    return cleaned.renames().where(F.col("ord") < first)


def actions(cleaned: Cleaned, first: int | None = STEP_ROWS) -> DataFrame:
    """The leading cleaning steps; one line saying so when there were none."""
    steps = cleaned.report.steps or [NO_STEPS]
    return small_frame(cleaned.table, list(enumerate(steps[:first])), "ord int, step string")


def methods(df: DataFrame) -> DataFrame:
    return small_frame(df, [(i, *m) for i, m in enumerate(METHODS)], "ord int, pass string, description string")


def methods_applied(cleaned: Cleaned) -> DataFrame:
    """Each pass with its description and what it touched: columns, cells or rows, or points gained."""
    r = cleaned.report
    touched = (
        (len(r.renames), "columns"), (sum(f.count for f in r.fills), "cells"), (r.exact_removed + r.key_removed, "rows"),
        (len(r.texts), "columns"), (len(r.dates_parsed), "columns"), (sum(f.outside for f in r.fences), "cells"),
        (round(r.quality_after - r.quality_before, 1), "points"),
    )
    rows = [(i, *m, float(n), unit) for i, (m, (n, unit)) in enumerate(zip(METHODS, touched))]
    return small_frame(cleaned.table, rows, "ord int, pass string, description string, touched double, unit string")


def legacy_stats(df: DataFrame, first: int = 10) -> DataFrame:
    """The older variant's statistics table: no skew, ten columns."""
    return numeric_stats(df, numeric_columns(df)[:first]).drop("skew", "n")


def report_row(df: DataFrame, report: Report) -> DataFrame:
    """The whole report as one row, one JSON column per part."""
    import json

    parts = report.as_dict()
    return small_frame(df, [tuple(json.dumps(v) for v in parts.values())], ", ".join(f"{k} string" for k in parts))
