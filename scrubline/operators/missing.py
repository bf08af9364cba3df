"""Missing values: sparse columns, fills per column, fills along the row order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.config import CURRENT, CleanConfig
from scrubline.functions import numbers as N
from scrubline.jobs import together
from scrubline.operators.columns import ROW_ID, quoted, small_frame
from scrubline.operators.exact import exact_decimal_quantiles, exact_means, filled_type, fitted
from scrubline.operators.frequencies import modes
from scrubline.operators.ordering import RANGE_BITS, numbered
from scrubline.operators.profile import Moments, moments
from scrubline.operators.quantiles import medians
from scrubline.operators.roles import NUMERIC_ROLES, Role

# Names of the fill strategies.
ZERO = "constant (0)"
MEAN = "mean (near-normal dist.)"
MEDIAN = "median (skewed dist.)"
IN_ORDER = "forward-fill / backward-fill"
UNKNOWN = "constant (Unknown)"
MODE = "mode"


@dataclass(frozen=True)
class Fill:
    column: str
    strategy: str
    value: float | Decimal | str | None
    count: int
    share: float


def sparse_columns(
    roles: Sequence[Role], rows: int, nulls: dict[str, int], config: CleanConfig = CURRENT
) -> list[str]:
    """Unprotected columns with too many missing values to keep."""
    return [
        r.column
        for r in roles
        if not r.protected and rows and nulls[r.column] / rows > config.drop_null_share
    ]


def decide_fills(
    df: DataFrame, roles: Sequence[Role], rows: int, nulls: dict[str, int], config: CleanConfig = CURRENT,
    known: dict[str, Moments] | None = None,
) -> list[Fill]:
    """Strategy and value for every unprotected column with missing values.

    Moments, medians and modes of all columns concerned are each found in one
    go; the median only where the spread asks for it. ``known`` moments are
    not computed again.
    """
    todo = [r for r in roles if nulls[r.column] and not r.protected and r.role != "other"]
    numeric = [r.column for r in todo if r.role in NUMERIC_ROLES]
    decimals = {c: filled_type(df.schema[c].dataType) for c in numeric if isinstance(df.schema[c].dataType, T.DecimalType)}

    def wants_median(m: Moments) -> bool:
        if m.n < config.min_numeric_values:
            return False
        limit = config.mean_skew_limit
        return limit is None or m.skew is None or abs(m.skew) >= limit

    def centres() -> tuple[dict[str, Moments], dict[str, float]]:
        stats = dict(known or {})
        stats.update(moments(df, [c for c in numeric if c not in stats]))
        skewed = [c for c in numeric if wants_median(stats[c])]
        counts = {c: stats[c].n for c in skewed}
        halves = medians(df, [c for c in skewed if c not in decimals], counts)
        exact = exact_decimal_quantiles(df, [c for c in skewed if c in decimals], [0.5], counts)
        return stats, halves | {c: q[0.5] for c, q in exact.items()}, exact_means(df, [c for c in numeric if c in decimals and c not in skewed])

    share = {r.column: nulls[r.column] / rows for r in todo}
    labels = [
        r.column for r in todo
        if r.role in ("categorical", "text")
        and (config.unknown_share is None or share[r.column] <= config.unknown_share)
    ]
    (stats, halves, means), mode = together(centres, lambda: modes(df, labels))

    fills = []
    for r in todo:
        c = r.column
        if r.role == "date":
            strategy, value = IN_ORDER, None
        elif r.role in NUMERIC_ROLES:
            if c in halves:
                strategy, value = MEDIAN, halves[c]
            elif stats[c].n < config.min_numeric_values:
                strategy, value = ZERO, 0.0
            else:
                strategy, value = MEAN, means.get(c) if means.get(c) is not None else stats[c].mean
            if isinstance(value, Decimal):
                value = fitted(value, decimals[c])
            value = None if value is None else round(value, 4)
        elif c in mode:
            strategy, value = MODE, mode[c]
        else:
            strategy, value = UNKNOWN, config.unknown_text
        fills.append(Fill(c, strategy, value, nulls[c], share[c]))
    return fills


def apply_fills(df: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """Put in the constant fills.

    Numbers become double, but for 64-bit whole numbers and decimals: they keep
    every digit, the former as they are or as decimals where the fill has a fraction.
    """
    types = dict(df.dtypes)
    new = {}
    for f in fills:
        if f.value is None:
            continue
        c = quoted(f.column)
        if isinstance(f.value, Decimal) and types[f.column].startswith("decimal"):
            kind = filled_type(df.schema[f.column].dataType)
            new[f.column] = F.coalesce(c.cast(kind), F.lit(fitted(f.value, kind)).cast(kind))
        elif isinstance(f.value, (float, Decimal)):
            new[f.column] = _with_number(c, types[f.column], float(f.value))
        elif types[f.column] == "boolean" and f.strategy == UNKNOWN:
            new[f.column] = F.coalesce(c.cast("string"), F.lit(f.value))
        else:
            new[f.column] = F.coalesce(c, F.lit(f.value).cast(types[f.column]))
    return df.withColumns(new) if new else df


def _with_number(c: Column, kind: str, value: float) -> Column:
    if kind == "bigint" and value == int(value):
        return F.coalesce(c, F.lit(int(value)))
    if kind == "bigint" or kind.startswith("decimal"):
        wide = "decimal(24,4)" if kind == "bigint" else "decimal(38,10)"
        return F.coalesce(c.cast(wide), F.lit(value).cast(wide))
    return F.coalesce(N.to_number(c) if kind == "string" else c.cast("double"), F.lit(value))


def fill_in_order(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Forward then backward fill along the row order.

    One window over the whole table would be one task. The rows are numbered
    in ranges of their order instead; inside a range a window fills forward,
    and the last and first known value of the neighbouring ranges come from a
    table with one row per range. A numbered table is shuffled once, for the window.
    """
    if not cols:
        return df
    rows = numbered(df, order_by).withColumn("_range", F.shiftright(ROW_ID, RANGE_BITS))
    known = {c: F.when(quoted(c).isNotNull(), F.col(ROW_ID)) for c in cols}
    ends = rows.groupBy("_range").agg(
        *[F.max_by(quoted(c), known[c]).alias(f"_last{i}") for i, c in enumerate(cols)],
        *[F.min_by(quoted(c), known[c]).alias(f"_first{i}") for i, c in enumerate(cols)],
    )
    ahead = Window.orderBy("_range")  # one row per range
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)
    after = ahead.rowsBetween(1, Window.unboundedFollowing)
    carry = ends.select(
        "_range",
        *[F.last(f"_last{i}", True).over(before).alias(f"_before{i}") for i in range(len(cols))],
        *[
            F.coalesce(f"_first{i}", F.first(f"_first{i}", True).over(after)).alias(f"_after{i}")
            for i in range(len(cols))
        ],
    )
    so_far = Window.partitionBy("_range").orderBy(ROW_ID).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(carry, "_range").withColumns(
        {
            c: F.coalesce(F.last(quoted(c), True).over(so_far), F.col(f"_before{i}"), F.col(f"_after{i}"))
            for i, c in enumerate(cols)
        }
    )
    return filled.select(*[quoted(c) for c in df.columns])


def fill_log(df: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """``ord, column, strategy, fill_value, count, pct`` of each fill."""
    rows = [
        (i, f.column, f.strategy, None if f.value is None else str(f.value)[:40], f.count, round(f.share * 100, 1))
        for i, f in enumerate(fills)
    ]
    schema = "ord int, column string, strategy string, fill_value string, count bigint, pct double"
    return small_frame(df, rows, schema)
