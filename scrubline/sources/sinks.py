"""Writing results: export layout, CSV and Parquet folders, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions.numbers import round_even
from pyspark.sql import types as T

from scrubline.functions.dates import iso_day
from scrubline.operators.columns import data_columns, date_columns, quoted


def export_layout(df: DataFrame) -> DataFrame:
    """Dates as ``yyyy-MM-dd`` text, floating-point numbers with four decimals, no row id."""
    dates = set(date_columns(df))
    out = []
    for name in data_columns(df):
        c = quoted(name)
        if name in dates:
            c = iso_day(c)
        elif isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            c = round_even(c.cast("double"), 4)
        out.append(c.alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV parts with header, missing values empty."""
    export_layout(df).write.mode(mode).csv(path, header=True, nullValue="", emptyValue="", escape='"')


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The same table with its types, for later Spark jobs."""
    df.select(*[quoted(c) for c in data_columns(df)]).write.mode(mode).parquet(path)


def to_json(df: DataFrame) -> Column:
    """All columns of a row as one JSON text."""
    return F.to_json(F.struct(*[quoted(c) for c in df.columns]))


def from_json(text: Column, schema: T.StructType | str) -> Column:
    return F.from_json(text, schema)
