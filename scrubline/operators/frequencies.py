"""Frequencies: value counts, modes, top values, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.operators.columns import batches, quoted, small_frame
from scrubline.staging import stage

DISTINCT_MARGIN = 4  # a sketch above this multiple of a threshold is above the threshold
TALL = 64  # columns whose digests travel in one tall table
LEAD = 7  # bytes of a value in one whole number
BROADCAST_ROWS = 100_000  # candidates, of some 30 bytes each, that are sent to every task


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """``value, n`` without missing values."""
    return df.where(quoted(col).isNotNull()).groupBy(quoted(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def most_frequent(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; equal counts in value order."""
    return value_counts(df, col).orderBy(F.desc("n"), "value").limit(k)


def all_value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, value, n`` of several columns in one shuffle, values as text."""
    cells = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; empty columns left out.

    The winner is a minimum, so it is found by partial aggregation.
    """
    if not cols:
        return {}
    best = F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best")
    rows = all_value_counts(df, cols).groupBy("column").agg(best).collect()  # one row per column
    return {r["column"]: r["best"]["value"] for r in rows}


# ── digests in place of values ──


def _digest(value: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(f"d{i}") for i in (1, 2)]


def _tall(df: DataFrame, cells: Sequence[tuple[Column, Sequence[Column]]]) -> DataFrame:
    """One row per non-null value: ``ord``, the place of its column, and the columns given for it."""
    marked = [F.when(v.isNotNull(), F.struct(F.lit(i).alias("ord"), *parts)) for i, (v, parts) in enumerate(cells)]
    return df.select(F.inline(F.array(*marked))).where(F.col("ord").isNotNull())


def _leads(text: Column) -> list[Column]:
    """The first bytes of a text as two whole numbers that compare like the text."""
    part = lambda at: F.rpad(F.hex(F.substring(text.cast("binary"), at, LEAD)), 2 * LEAD, "0")
    return [F.conv(part(1 + i * LEAD), 16, 10).cast("long").alias(f"p{i + 1}") for i in (0, 1)]


def value_digests(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``ord, d1, d2, p1, p2, n``: how often each value of each column occurs, written once.

    Values as text, by 128-bit digest and leading bytes: what is shuffled and kept
    has a fixed width, however long the texts are.
    """
    texts = [quoted(c).cast("string") for c in cols]
    tall = _tall(df, [(t, [*_digest(t), *_leads(t)]) for t in texts])
    return stage(tall.groupBy("ord", "d1", "d2", "p1", "p2").agg(F.count(F.lit(1)).alias("n")), "values")


def top_of(df: DataFrame, cols: Sequence[str], digests: DataFrame, k: int) -> DataFrame:
    """``column, value, n, rank``: the ``k`` most frequent values, equal counts in value order.

    The ``k``-th row by count and leading bytes is the cut; what lies before it or is
    equal to it are the candidates, and only their texts are read, in a second scan.
    More than ``BROADCAST_ROWS`` candidates, all alike in count and leading bytes, are
    joined by digest.
    """
    order = [F.desc("n"), "p1", "p2"]
    first = digests.withColumn("k", F.row_number().over(Window.partitionBy("ord").orderBy(*order))).where(F.col("k") <= k)
    cuts = {}
    for r in first.orderBy("ord", "k").collect():  # k rows per column
        cuts[r["ord"]] = (r["n"], r["p1"], r["p2"])
    cut = small_frame(df, [(i, *c) for i, c in cuts.items()], "ord int, cn bigint, c1 bigint, c2 bigint")
    n, p1, p2 = F.col("n"), F.col("p1"), F.col("p2")
    inside = (p1 < F.col("c1")) | ((p1 == F.col("c1")) & (p2 <= F.col("c2")))
    candidates = digests.join(F.broadcast(cut), "ord").where((n > F.col("cn")) | ((n == F.col("cn")) & inside))
    candidates = candidates.select("ord", "d1", "d2", "n")
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    texts = [quoted(c).cast("string") for c in cols]
    named = _tall(df, [(t, [*_digest(t), t.alias("value")]) for t in texts])
    found = named.join(candidates, ["ord", "d1", "d2"]).groupBy("ord", "value").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("n"), "value"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(named_by(cols), "value", "n", "rank")


def named_by(cols: Sequence[str]) -> Column:
    """``column``: the name of the column at place ``ord``."""
    return F.get(F.array(*[F.lit(c) for c in cols]), F.col("ord")).alias("column")


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column, with their rank."""
    return top_of(df, cols, value_digests(df, cols), k)


def top_with_other(df: DataFrame, col: str, k: int = 12) -> DataFrame:
    """The ``k`` most frequent values and one row for the rest, with shares in percent.

    Ranking all values would put them in one task; the top rows are few and are
    broadcast instead, and everything else falls into the rest.
    """
    counts = value_counts(df, col).withColumn("value", F.col("value").cast("string"))
    top = counts.orderBy(F.desc("n"), "value").limit(k).select("value", F.lit(False).alias("is_other"))
    named = counts.join(F.broadcast(top), "value", "left").select(
        F.when(F.col("is_other").isNotNull(), F.col("value")).otherwise("Other").alias("value"),
        F.coalesce("is_other", F.lit(True)).alias("is_other"),
        "n",
    )
    return (
        named.groupBy("value", "is_other")
        .agg(F.sum("n").alias("n"))
        .withColumn("share_pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy()))
    )


# ── distinct values ──


def distinct_estimates(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """About how many distinct non-null values each column has; sketches travel, no values."""
    out: dict[str, int] = {}
    for some in batches(list(cols), 32):
        out.update(zip(some, df.agg(*[F.approx_count_distinct(quoted(c)) for c in some]).first()))
    return out


def _comparable(df: DataFrame, col: str) -> Column:
    """A value whose digest is the same for equal values and for no others."""
    kind, value = df.schema[col].dataType, quoted(col)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0)  # minus zero is zero
    if isinstance(kind, (T.ArrayType, T.StructType)):  # a NULL inside leaves a digest as it is
        return F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
    return value


def distinct_frame(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``ord, n_distinct`` of columns with values: 128-bit digests of all columns in one tall shuffle."""
    values = [_comparable(df, c) for c in cols]
    return _tall(df, [(v, _digest(v)) for v in values]).distinct().groupBy("ord").agg(F.count(F.lit(1)).alias("n_distinct"))


def distinct_counts(df: DataFrame, cols: Sequence[str], upto: int | None = None) -> dict[str, int]:
    """Distinct non-null values per column.

    With ``upto`` the count is exact wherever it matters for a threshold of
    that size: a sketch is taken of all columns and only those it puts near or
    below the threshold are counted, which shuffles next to nothing. Columns far
    above keep the estimate.
    """
    out: dict[str, int] = {}
    cols = list(cols)
    if upto is not None:
        out = distinct_estimates(df, cols)
        cols = near(out, upto)
    for some in batches(cols, TALL):
        found = {r["ord"]: r["n_distinct"] for r in distinct_frame(df, some).collect()}  # one row per column
        out.update({c: found.get(i, 0) for i, c in enumerate(some)})
    return out


def near(estimates: dict[str, int], upto: int) -> list[str]:
    """The columns whose exact count may lie at or below a threshold."""
    return [c for c, n in estimates.items() if n <= DISTINCT_MARGIN * upto]
