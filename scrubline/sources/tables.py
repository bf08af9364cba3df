"""Reading tables: formats, row ids, types of CSV columns, previews, load summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.functions.numbers import to_number
from scrubline.operators.columns import ROW_ID, batches, data_columns, fold_nan, quoted, row_order
from scrubline.operators.ordering import first_rows
from scrubline.operators.profile import null_profile
from scrubline.staging import stage

FORMATS = ("csv", "parquet", "orc", "json")

# CSV cells read as missing.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_WHOLE = r"^\s*[+-]?\d+\s*$"
_EXACT = 2**53  # whole numbers below are exact as double
_BROKEN = "_broken_line"


class RaggedRows(ValueError):
    """A CSV file has lines with more cells than its header."""


class EmptyTable(ValueError):
    """The input holds no rows."""


def read_table(
    spark: SparkSession, path: str | Sequence[str], format: str | None = None, row_id: bool = False,
    multi_line: bool = False, land: bool = False,
) -> DataFrame:
    """Read files of one format, NaN folded to NULL.

    ``row_id`` adds ``_rid``, which orders the rows as they lie in the files:
    by file, then by place in the file. CSV columns get the narrowest type all
    their values fit: whole number, number, boolean, else text. Whole numbers
    that a type would round stay text. Lines with more cells than the header
    stop the read with their number; missing cells at a line's end are NULL.

    ``land`` writes the table once as Parquet stage table. Profiling reads a
    table many times, a few columns each; a large CSV or JSON input would be
    parsed in full every time.
    """
    paths = [path] if isinstance(path, str) else list(path)
    format = format or paths[0].rstrip("/").rsplit(".", 1)[-1].lower()
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}; one of {', '.join(FORMATS)}")
    reader = spark.read
    if format == "csv":
        reader = reader.options(header=True, inferSchema=False, multiLine=multi_line, escape='"')
    df = reader.format(format).load(paths)
    if format == "csv":
        columns = T.StructType([*df.schema.fields, T.StructField(_BROKEN, T.StringType())])
        df = reader.schema(columns).option("columnNameOfCorruptRecord", _BROKEN).csv(paths)
    if row_id:
        place = "row_index" if format == "parquet" else "file_block_start"
        at = [F.col("_metadata.file_path").alias("file_path"), F.col(f"_metadata.{place}").alias("place")]
        if format != "parquet":  # within one split the id grows with the row; splits are told apart by their start
            at.append(F.monotonically_increasing_id().alias("row"))
        df = df.withColumn(ROW_ID, F.struct(*at))
    df = typed_csv(df) if format == "csv" else fold_nan(df)
    return stage(df, "landed") if land else df


def typed_csv(df: DataFrame) -> DataFrame:
    """Missing-value tokens to NULL, then the narrowest type per column, decided in one scan."""
    names = [c for c in data_columns(df) if c != _BROKEN]
    surplus = F.lit(0).alias("surplus")
    if _BROKEN in df.columns:
        surplus = F.count_if(_surplus(df, names)).alias("surplus")
    texts = df.withColumns({c: F.when(~quoted(c).isin(*CSV_NULLS), quoted(c)) for c in names})
    kinds: dict[str, str] = {}
    for some in batches(names, 64):  # few scans: a CSV is parsed in full each time
        aggs = []
        for i, c in enumerate(some):
            v = quoted(c)
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.count_if(v.rlike(_WHOLE)).alias(f"w{i}"),
                F.count_if(v.rlike(_WHOLE) & F.trim(v).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                F.count_if(v.rlike(_WHOLE) & (F.abs(to_number(v)) >= _EXACT)).alias(f"l{i}"),
                F.count(to_number(v)).alias(f"d{i}"),
                F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
            ]
        row = texts.agg(*aggs, surplus).first()
        if row["surplus"]:
            raise RaggedRows(f"{row['surplus']} line(s) with more cells than the header")
        for i, c in enumerate(some):
            n = row[f"n{i}"]
            if n and row[f"i{i}"] == n:
                kinds[c] = "bigint"
            elif n == 0 or row[f"d{i}"] == n and not row[f"l{i}"]:
                kinds[c] = "double"
            elif row[f"b{i}"] == n:
                kinds[c] = "boolean"
    casts = {
        c: to_number(quoted(c)) if kind == "double" else F.trim(quoted(c)).try_cast(kind)
        for c, kind in kinds.items()
    }
    texts = texts.drop(_BROKEN)
    return texts.withColumns(casts) if casts else texts


def _surplus(df: DataFrame, names: Sequence[str]) -> Column:
    """Whether a line has more cells than the header; such a line is kept whole in ``_BROKEN``."""
    schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    cells = F.from_csv(F.col(_BROKEN), schema, {"nullValue": "\u0001", "emptyValue": "", "escape": '"', "mode": "PERMISSIVE"})
    return F.col(_BROKEN).isNotNull() & cells[f"c{len(names)}"].isNotNull()


def require_rows(df: DataFrame) -> DataFrame:
    """Stop early on an empty input."""
    if df.isEmpty():
        raise EmptyTable("the table is empty")
    return df


def preview(df: DataFrame, k: int = 6, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first rows as text, missing values as empty text."""
    head = first_rows(df, row_order(df, order_by), k)
    return head.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(c) for c in data_columns(df)])


def load_summary(df: DataFrame) -> DataFrame:
    """One row per column: position, missing values, rows and missing share."""
    return null_profile(df)
