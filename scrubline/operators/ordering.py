"""The row order of a table: its first rows, and a number for each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.columns import ROW_ID, quoted, row_order
from scrubline.operators.sketches import GROUPS
from scrubline.staging import stage

LIMITED = 1000  # up to here Spark keeps a group's first rows within each task, before the shuffle
RANGE_BITS = 33  # a row's number: the range of the order that it lies in, then its place there


def first_rows(df: DataFrame, order_by: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows in the order of ``order_by``.

    Every task keeps its first ``k`` rows, groups of tasks merge theirs, and
    the last step merges a fixed number of groups. Beyond ``LIMITED`` rows,
    which is more than any pass asks for, the tasks' first rows are merged at once.
    """
    order = [quoted(c) for c in order_by]
    if k <= LIMITED:
        w = Window.partitionBy("_group").orderBy(*order)
        grouped = df.withColumn("_group", F.spark_partition_id() % GROUPS).withColumn("_place", F.row_number().over(w))
        df = grouped.where(F.col("_place") <= k).drop("_group", "_place")
    return df.orderBy(*order).limit(k)


def is_numbered(df: DataFrame) -> bool:
    return ROW_ID in df.columns and isinstance(df.schema[ROW_ID].dataType, T.LongType)


def numbered(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its rows numbered in their order by a whole number ``_rid``, written once.

    The order is settled here for all later passes, which may rename, retype or
    drop the columns it came from. Rows that are equal in every column are told
    apart by where they were read, so that any number of them can be split.
    """
    if is_numbered(df) and not order_by:
        return df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [quoted(c) for c in row_order(df, order_by)]
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie", ROW_ID)
    return stage(ranged.withColumn(ROW_ID, F.monotonically_increasing_id()), "numbered")
