"""Pearson correlation of column pairs, pairwise complete, from one scan.

Every task multiplies the matrix of its rows with itself, a batch at a time, and
with the mask of the known values; the sums of all pairs are then added up. So the
number of scans does not depend on the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.columns import batches, number, numeric_columns
from scrubline.operators.profile import Moments
from scrubline.staging import stage

HEAD = 1000  # rows whose means the columns are shifted by, against cancellation
FLAT = 1e-9  # share of the sum of squares below which a spread may be rounding
FLAT_PAIRS = 32  # such pairs looked at again per scan
SUMS = ("n", "p", "x", "y", "xx", "yy")


def pair_sums(df: DataFrame, cols: Sequence[str], shift: Sequence[float]) -> DataFrame:
    """``a, b`` (places in ``cols``, a < b) with sums over the rows in which both are known.

    ``n`` counts them; ``p`` sums the products, ``x, y`` the values and ``xx, yy`` their
    squares, all of values less ``shift``. Each task sends one row per pair.
    """
    d = len(cols)
    upper = np.triu_indices(d, 1)

    def multiply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for part in parts:
            values = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in part.columns])
            known = ~np.isnan(values)
            x, mask = np.where(known, values, 0.0), known.astype(float)
            total += np.stack([mask.T @ mask, x.T @ x, x.T @ mask, (x * x).T @ mask])
        n, p, s, q = total
        columns = [n[upper], p[upper], s[upper], s.T[upper], q[upper], q.T[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)) for i in upper] + [pa.array(c) for c in columns], ["a", "b", *SUMS])

    shifted = df.select(*[(number(c) - F.lit(float(s))).alias(f"c{i}") for i, (c, s) in enumerate(zip(cols, shift))])
    sums = shifted.mapInArrow(multiply, "a int, b int, " + ", ".join(f"{s} double" for s in SUMS))
    a = F.col("id").cast("int")
    none = df.sparkSession.range(d - 1).select(a.alias("a"), F.explode(F.sequence(a + 1, F.lit(d - 1))).alias("b"), *[F.lit(0.0).alias(s) for s in SUMS])
    return sums.unionByName(none).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def _spread(square: str, total: str):
    return F.col(square) - F.col(total) * F.col(total) / F.col("n")


def _constant(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``pairs`` in which either column is constant where both are known."""
    used = sorted({i for pair in pairs for i in pair})
    alone: set[int] = set()
    for some in batches(used, 4 * FLAT_PAIRS):
        row = df.agg(*[F.coalesce(F.min(number(cols[i])) == F.max(number(cols[i])), F.lit(True)) for i in some]).first()
        alone |= {i for i, flat in zip(some, row) if flat}
    out = [p for p in pairs if alone & set(p)]
    for some in batches([p for p in pairs if not alone & set(p)], FLAT_PAIRS):
        cells = []
        for i, j in some:
            a, b = number(cols[i]), number(cols[j])
            x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
            cells.append(F.coalesce((F.min(x) == F.max(x)) | (F.min(y) == F.max(y)), F.lit(True)))
        out += [p for p, flat in zip(some, df.agg(*cells).first()) if flat]
    return out


def correlation_pairs(
    df: DataFrame, cols: Sequence[str] | None = None, m: dict[str, Moments] | None = None, rows: int | None = None
) -> DataFrame:
    """``ord, a, b, r`` for every pair of columns, in column order.

    ``r`` is NULL where either column is constant in the rows that have both.
    Known moments spare the look at the table's head.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    d = len(cols)
    if d < 2:
        return df.sparkSession.createDataFrame([], "ord int, a string, b string, r double")
    if m is None:
        head = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(cols)]).limit(HEAD)
        shift = [x if x is not None and np.isfinite(x) else 0.0 for x in head.agg(*[F.avg(f"c{i}") for i in range(d)]).first()]
    else:
        shift = [m[c].mean if m[c].n and np.isfinite(m[c].mean) else 0.0 for c in cols]
    sums = stage(pair_sums(df, cols, shift), "pair-sums")
    flat = (_spread("xx", "x") <= FLAT * F.col("xx")) | (_spread("yy", "y") <= FLAT * F.col("yy"))
    doubtful = [(r.a, r.b) for r in sums.where((F.col("n") > 0) & flat).select("a", "b").collect()]
    constant = _constant(df, cols, doubtful) if doubtful else []
    names = F.array(*[F.lit(c) for c in cols])
    a, b = F.col("a"), F.col("b")
    keys = F.array(*[F.lit(i * d + j) for i, j in constant]) if constant else F.array().cast("array<int>")
    known = (F.col("n") > 0) & ~F.array_contains(keys, a * d + b)
    r = F.try_divide(F.col("p") - F.col("x") * F.col("y") / F.col("n"), F.sqrt(_spread("xx", "x") * _spread("yy", "y")))
    place = (a * d - F.expr("a * (a + 1) div 2") + b - a - 1).cast("int")
    return sums.select(place.alias("ord"), F.element_at(names, a + 1).alias("a"), F.element_at(names, b + 1).alias("b"), F.when(known, r).alias("r"))
