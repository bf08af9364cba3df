"""Column families and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROW_ID = "_rid"


def quoted(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row id."""
    return [c for c in df.columns if c != ROW_ID]


def family(dtype: T.DataType) -> str:
    """numeric, text, date, boolean or other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def of_family(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != ROW_ID and family(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return of_family(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return of_family(df, "text")


def date_columns(df: DataFrame) -> list[str]:
    return of_family(df, "date")


def number(name: str) -> Column:
    """Numeric column as double, NaN folded to NULL."""
    c = quoted(name).cast("double")
    return F.when(~F.isnan(c), c)


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    floats = (T.DoubleType, T.FloatType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, floats)]
    return df.withColumns({n: F.when(~F.isnan(quoted(n)), quoted(n)) for n in names})


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def row_order(df: DataFrame, order_by: Sequence[str] | None = None) -> list[str]:
    """Columns that put the rows in a total order.

    The given ones first, then the row id when the table has one, else every
    other orderable column, so that the order never depends on partitioning.
    """
    order = list(order_by or [])
    if ROW_ID in df.columns:
        return order + [ROW_ID]
    return order + [f.name for f in df.schema.fields if f.name not in order and orderable(f.dataType)]


def batches(items: Sequence, size: int) -> Iterable[list]:
    """Columns are profiled some at a time to keep one aggregation's plan small."""
    for i in range(0, len(items), size):
        yield list(items[i : i + size])


def small_frame(df: DataFrame | SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows that number like columns, decisions or bins, never like records.

    They go in as one Arrow table, which Spark plans as a local relation.
    """
    spark = df if isinstance(df, SparkSession) else df.sparkSession
    struct = T.StructType.fromDDL(schema)
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(struct)), struct)
