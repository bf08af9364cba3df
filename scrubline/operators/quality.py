"""Quality score: completeness 40, uniqueness 20, consistency 30, validity 10."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from scrubline.jobs import together
from scrubline.config import CURRENT, CleanConfig
from scrubline.operators.columns import data_columns, numeric_columns, small_frame
from scrubline.operators.duplicates import duplicate_count
from scrubline.operators.profile import moments, null_counts

# The points each part is worth.
COMPLETENESS, UNIQUENESS, CONSISTENCY, VALIDITY = 40, 20, 30, 10
NO_NUMERIC = 0.8  # consistency of a table without numeric columns


def consistency(skews: Iterable[float | None], config: CleanConfig = CURRENT) -> float:
    """Share of numeric columns without extreme skew; an unknown skew counts against."""
    calm = [s is not None and abs(s) < config.max_consistent_skew for s in skews]
    return sum(calm) / len(calm) if calm else NO_NUMERIC


def score(rows: int, columns: int, nulls: int, duplicates: int, consistent: float) -> float:
    """Points out of 100, one decimal."""
    missing = nulls / max(rows * columns, 1)
    repeated = duplicates / max(rows, 1)
    points = (1 - missing) * COMPLETENESS + (1 - repeated) * UNIQUENESS + consistent * CONSISTENCY + VALIDITY
    return min(round(points, 1), 100.0)


def quality_score(df: DataFrame, config: CleanConfig = CURRENT) -> DataFrame:
    """The parts and the score of one table, as one row."""
    (rows, nulls), repeats, stats = together(
        lambda: null_counts(df),
        lambda: duplicate_count(df).first()["duplicates"],
        lambda: moments(df, numeric_columns(df)),
    )
    consistent = consistency((m.skew for m in stats.values()), config)
    columns = len(data_columns(df))
    total = sum(nulls.values())
    return small_frame(
        df,
        [(rows, columns, total, repeats, consistent, score(rows, columns, total, repeats, consistent))],
        "rows bigint, columns int, nulls bigint, duplicates bigint, consistency double, score double",
    )
