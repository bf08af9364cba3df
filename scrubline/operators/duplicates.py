"""Duplicates: exact copies and repeats of a business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.config import CURRENT, CleanConfig
from scrubline.operators.columns import ROW_ID, data_columns, orderable, quoted, row_order
from scrubline.operators.ordering import is_numbered
from scrubline.operators.roles import Role


def copy_counts(df: DataFrame) -> DataFrame:
    """Each distinct row once, with its number of copies as ``_copies``.

    NULLs are equal to each other. Copies collapse before the shuffle, so a
    row repeated a billion times travels as one row per task.
    """
    cols = [quoted(c) for c in data_columns(df)]
    keep = [F.min(ROW_ID).alias(ROW_ID)] if ROW_ID in df.columns else []
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"), *keep)


def with_digest(df: DataFrame) -> DataFrame:
    """``df`` with a 128-bit digest ``_d1, _d2`` of its data columns; equal digests are taken for equal rows."""
    cols = [quoted(c) for c in data_columns(df)]
    marked = [*cols, *[c.isNull() for c in cols]]  # a NULL leaves a digest as it is
    return df.withColumns({f"_d{i}": F.xxhash64(F.lit(i), *marked) for i in (1, 2)})


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, and how many of them repeat another row; digests travel, not the rows."""
    copies = with_digest(df).groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )


def drop_exact(df: DataFrame) -> DataFrame:
    """One of each distinct row; with a row id, the first."""
    if ROW_ID not in df.columns:
        return df.dropDuplicates()
    return copy_counts(df).select(*[quoted(c) for c in df.columns])


def business_key(roles: Sequence[Role], config: CleanConfig = CURRENT) -> list[str]:
    """The first id column and the first date column; one of them alone will do."""
    if not config.business_key:
        return []
    ids = [r.column for r in roles if r.role == "id"][:1]
    dates = [r.column for r in roles if r.role == "date"][:1]
    if config.require_both_keys and not (ids and dates):
        return []
    return ids + dates


def key_groups(df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """First row of each key in the row order, with the key's row count as ``_repeats``.

    A first row is a minimum, found by partial aggregation: a key holding a
    third of the table sends one row per task. A numbered table has its
    minimum by hash aggregation; otherwise whole rows are compared, sorted by key.
    """
    if is_numbered(df) and not order_by:
        first = df.groupBy(*[quoted(c).alias(f"_key{i}") for i, c in enumerate(key)]).agg(
            F.min(ROW_ID).alias(ROW_ID), F.count(F.lit(1)).alias("_repeats")
        )
        return df.join(first.select(ROW_ID, "_repeats"), ROW_ID).select(*[quoted(c) for c in df.columns], "_repeats")
    order = row_order(df, order_by)
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*[quoted(c) for c in order + rest])
    if all(orderable(df.schema[c].dataType) for c in rest):
        first = F.min(row)
    else:
        first = F.min_by(row, F.struct(*[quoted(c) for c in order]))
    return (
        df.groupBy(*[quoted(c).alias(f"_key{i}") for i, c in enumerate(key)])
        .agg(first.alias("_row"), F.count(F.lit(1)).alias("_repeats"))
        .select(*[F.col("_row").getField(c).alias(c) for c in df.columns], "_repeats")
    )


def first_of_each(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rows of a numbered table without exact copies, then without repeats of ``key``.

    The first of each group stays, with the number of different rows of its key
    as ``_repeats``. Both steps find the smallest row number by hash
    aggregation of digests and keys; the rows themselves move once.
    """
    narrow = with_digest(df).select("_d1", "_d2", ROW_ID, *[quoted(c).alias(f"_key{i}") for i, c in enumerate(key)])
    keys = [f"_key{i}" for i in range(len(key))]
    rows = narrow.groupBy("_d1", "_d2", *keys).agg(F.min(ROW_ID).alias(ROW_ID))
    if key:
        rows = rows.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID), F.count(F.lit(1)).alias("_repeats"))
    else:
        rows = rows.select(ROW_ID, F.lit(1).cast("long").alias("_repeats"))
    return df.join(rows.select(ROW_ID, "_repeats"), ROW_ID).select(*[quoted(c) for c in df.columns], "_repeats")


def drop_key_repeats(df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first row of each key; NULL keys are equal to each other."""
    return key_groups(df, key, order_by).drop("_repeats")
