"""Shape of a numeric column: histogram, density curve, box statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, factorial, log2, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.functions.numbers import z_score
from scrubline.operators.columns import batches, number, numeric_columns, small_frame
from scrubline.operators.profile import Moments, moments
from scrubline.operators.quantiles import exact_quantiles

GRID = 300  # points of a density curve
CELL = 0.5  # width of a cell in bandwidths
TERMS = 16  # moments kept of each cell
REACH = 9.0  # bandwidths beyond which a kernel is zero in double precision


@dataclass(frozen=True)
class Bins:
    low: float
    high: float
    count: int

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.count


def automatic_bins(m: Moments, iqr: float) -> Bins:
    """Bin count from the narrower of the Freedman-Diaconis and Sturges widths."""
    spread = m.max - m.min
    if spread == 0:
        return Bins(m.min - 0.5, m.max + 0.5, 1)
    widths = [spread / (log2(m.n) + 1)]
    if iqr > 0:
        widths.append(2 * iqr / m.n ** (1 / 3))
    return Bins(m.min, m.max, ceil(spread / min(widths)))


def plan_bins(df: DataFrame, col: str) -> tuple[Moments, Bins]:
    m = moments(df, [col])[col]
    q = exact_quantiles(df, [col], [0.25, 0.75], {col: m.n})[col]
    return m, automatic_bins(m, q[0.75] - q[0.25])


def histogram(df: DataFrame, col: str, bins: Bins | None = None) -> DataFrame:
    """``bin, low, high, n`` of the bins that hold values; the last bin is closed.

    A far tail asks for many more bins than there are values. Empty bins are
    never made, so their number costs nothing.
    """
    bins = bins or plan_bins(df, col)[1]
    x, last = F.col("x"), bins.count - 1
    guess = F.least(F.floor((x - bins.low) / (bins.high - bins.low) * bins.count), F.lit(last)).cast("bigint")
    # the division may land one bin off the edge; the edges decide
    place = F.when(x < F.col("bin") * bins.width + bins.low, F.col("bin") - 1).when(
        (F.col("bin") < last) & (x >= (F.col("bin") + 1) * bins.width + bins.low), F.col("bin") + 1
    ).otherwise(F.col("bin"))
    return (
        df.select(number(col).alias("x"))
        .where(x.isNotNull())
        .withColumn("bin", guess)
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.col("bin") * bins.width + bins.low).alias("low"),
            ((F.col("bin") + 1) * bins.width + bins.low).alias("high"),
            "n",
        )
    )


def density_curve(
    df: DataFrame, col: str, scale: float | None = None, grid: int = GRID, m: Moments | None = None
) -> DataFrame:
    """``point, x, density`` of a Gaussian kernel estimate with Scott's bandwidth.

    Values are gathered in cells of half a bandwidth, by ``TERMS`` moments about the
    cell's middle; a kernel is the kernel of the middle times a power series in the
    distance from it, whose rest is below 1e-14 of the kernel's height. So rows are
    only added up, and cells, of which there are few, reach for the grid points.
    ``scale`` (rows times bin width) lays the curve over a histogram.
    """
    spark = df.sparkSession
    m = m or moments(df, [col])[col]
    if not m.n or not m.std:
        return small_frame(df, [], "point int, x double, density double")
    h = m.std * m.n ** (-1 / 5)
    step = (m.max - m.min) / (grid - 1)
    factor = (scale if scale is not None else 1.0) / (m.n * h * sqrt(2 * pi))
    point, cell, w, near = (F.col(c) for c in ("point", "cell", "w", "near"))
    width = h * CELL
    middle = (cell + 0.5) * width + m.min
    values = df.select(number(col).alias("v")).where("v is not null").withColumn("cell", F.floor((F.col("v") - m.min) / width))
    placed = values.select("cell", ((F.col("v") - middle) / h).alias("w")).withColumn("near", F.exp(w * w * -0.5))
    powers = [near]
    for _ in range(1, TERMS):
        powers.append(powers[-1] * w)
    cells = placed.groupBy("cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    reach = (REACH + CELL) * h
    first = F.greatest(F.lit(0), F.ceil((middle - reach - m.min) / step).cast("int"))
    last = F.least(F.lit(grid - 1), F.floor((middle + reach - m.min) / step).cast("int"))
    series = F.lit(0.0)
    for k in range(TERMS - 1, -1, -1):
        series = series * F.col("far") + F.col(f"m{k}") / factorial(k)
    sums = (
        cells.withColumns({"first": first, "last": last})
        .where("first <= last")
        .withColumn("point", F.explode(F.sequence("first", "last")))
        .withColumn("far", (point * step + m.min - middle) / h)
        .groupBy("point")
        .agg(F.sum(F.exp(F.col("far") * F.col("far") * -0.5) * series).alias("s"))
    )
    points = spark.range(grid).select(F.col("id").cast("int").alias("point"))
    return points.join(F.broadcast(sums), "point", "left").select(
        "point", (point * step + m.min).alias("x"), (F.coalesce("s", F.lit(0.0)) * factor).alias("density")
    )


def box_stats(
    df: DataFrame, cols: Sequence[str] | None = None, normalise: bool = True,
    stats: dict[str, Moments] | None = None, quartiles: dict[str, dict[float, float]] | None = None,
) -> DataFrame:
    """Quartiles, whiskers and fliers per column, on z-scores unless told otherwise.

    A z-score keeps the order of the values, so quartiles and whiskers are
    found on the column as it is and only then moved to the new scale.
    """
    cols = list(cols if cols is not None else numeric_columns(df))
    stats = stats or moments(df, cols)
    cols = [c for c in cols if stats[c].n]
    q = quartiles or exact_quantiles(df, cols, [0.25, 0.5, 0.75], {c: stats[c].n for c in cols})
    rows = []
    for some in batches(cols, 8):
        aggs = []
        for i, c in enumerate(some):
            x, reach = number(c), 1.5 * (q[c][0.75] - q[c][0.25])
            low, high = q[c][0.25] - reach, q[c][0.75] + reach
            aggs += [
                F.min(F.when(x >= low, x)).alias(f"lo{i}"),
                F.max(F.when(x <= high, x)).alias(f"hi{i}"),
                F.count_if((x < low) | (x > high)).alias(f"out{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, c in enumerate(some):
            m, quart = stats[c], q[c]
            low, high = min(row[f"lo{i}"], quart[0.25]), max(row[f"hi{i}"], quart[0.75])
            # the scale of a column that does not vary stays as it is
            shift, unit = (m.mean, m.std) if normalise and m.std else (0.0, 1.0)
            rows.append(
                (cols.index(c), c, m.n, shift, unit, low, quart[0.25], quart[0.5], quart[0.75], high, row[f"out{i}"])
            )
    names = ("whisker_low", "q1", "median", "q3", "whisker_high")
    schema = "ord int, column string, n bigint, _shift double, _unit double, " + ", ".join(
        f"{x} double" for x in names
    ) + ", fliers bigint"
    scaled = {x: z_score(F.col(x), F.col("_shift"), F.col("_unit")) for x in names}
    return small_frame(df, rows, schema).withColumns(scaled).drop("_shift", "_unit")
