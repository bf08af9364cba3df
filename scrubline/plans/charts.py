"""Chart datasets: the numbers behind each chart, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.jobs import together
from scrubline.operators.columns import date_columns, numeric_columns, small_frame, text_columns
from scrubline.operators.correlation import correlation_pairs
from scrubline.operators.distribution import automatic_bins, box_stats, density_curve, histogram
from scrubline.operators.frequencies import distinct_counts, top_with_other
from scrubline.operators.profile import Moments, moments
from scrubline.operators.quantiles import exact_quantiles
from scrubline.operators.roles import PROTECTED, Role
from scrubline.operators.summaries import category_summary, key_figures, monthly_trend

# The order in which a report prefers chart types.
REPORT_ORDER = ("histogram", "bar", "line", "grouped", "heatmap", "box")

KPI_COLUMNS, HISTOGRAM_COLUMNS, BAR_COLUMNS, LINE_COLUMNS, HEATMAP_COLUMNS, BOX_COLUMNS = 5, 4, 4, 2, 10, 7
MIN_HISTOGRAM_ROWS, MIN_BAR_VALUES, MIN_LINE_MONTHS = 5, 2, 3


@dataclass
class Chart:
    """One chart: its type, what it shows, and its tables."""

    type: str
    column: str
    title: str
    data: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class ChartColumns:
    numbers: list[str]
    texts: list[str]
    dates: list[str]


def label(name: str) -> str:
    return name.replace("_", " ").title()


def chart_columns(df: DataFrame, roles: Sequence[Role] = ()) -> ChartColumns:
    """Columns worth charting: no ids among the numbers, nothing protected among the texts."""
    by_role = {r.column: r.role for r in roles}
    return ChartColumns(
        [c for c in numeric_columns(df) if by_role.get(c) != "id"],
        [c for c in text_columns(df) if by_role.get(c) not in PROTECTED],
        date_columns(df),
    )


def histogram_chart(df: DataFrame, col: str, m: Moments, quartiles: dict[float, float]) -> Chart:
    """Bins, density curve and the marked figures of one column."""
    bins = automatic_bins(m, quartiles[0.75] - quartiles[0.25])
    marks = small_frame(
        df, [(m.n, m.mean, quartiles[0.5], m.std, m.skew)],
        "n bigint, mean double, median double, std double, skew double",
    )
    curve = density_curve(df, col, scale=m.n * bins.width, m=m)
    return Chart("histogram", col, f"Distribution of {label(col)}", histogram(df, col, bins),
                 {"density": curve, "marks": marks})


def bar_chart(df: DataFrame, col: str) -> Chart:
    data = top_with_other(df, col).orderBy("n", F.desc("value"))
    return Chart("bar", col, f"Breakdown of {label(col)}", data)


def line_chart(df: DataFrame, date: str, value: str) -> Chart:
    data = monthly_trend(df, date, value).where(F.col("months") >= MIN_LINE_MONTHS).orderBy("month")
    return Chart("line", f"{date}_{value}", f"{label(value)} over time", data)


def heatmap_chart(df: DataFrame, cols: Sequence[str], m: dict[str, Moments] | None = None,
                  rows: int | None = None) -> Chart:
    data = correlation_pairs(df, cols[:HEATMAP_COLUMNS], m, rows)
    return Chart("heatmap", "correlation", "Correlation matrix", data)


def chart_datasets(df: DataFrame, roles: Sequence[Role] = ()) -> list[Chart]:
    """Every chart that applies to the table, in display order.

    One profile of the leading numeric columns serves histograms, heat map and boxes.
    """
    cols = chart_columns(df, roles)
    texts = cols.texts[:BAR_COLUMNS]
    m, rows, distinct = together(
        lambda: moments(df, cols.numbers[:HEATMAP_COLUMNS]),
        df.count,
        lambda: distinct_counts(df, texts, MIN_BAR_VALUES),
    )
    boxed = cols.numbers[:BOX_COLUMNS]
    q = exact_quantiles(df, boxed, [0.25, 0.5, 0.75], {c: m[c].n for c in boxed}) if boxed else {}
    charts = []
    if cols.numbers:
        charts.append(Chart("kpi", "kpi_summary", "Key figures", key_figures(df, cols.numbers[:KPI_COLUMNS])))
    charts += [
        histogram_chart(df, c, m[c], q[c]) for c in cols.numbers[:HISTOGRAM_COLUMNS] if m[c].n >= MIN_HISTOGRAM_ROWS
    ]
    charts += [bar_chart(df, c) for c in texts if distinct[c] >= MIN_BAR_VALUES]
    for date in cols.dates[:1]:
        charts += [line_chart(df, date, v) for v in cols.numbers[:LINE_COLUMNS]]
    if len(cols.numbers) >= 2:
        charts.append(heatmap_chart(df, cols.numbers, m, rows))
        charts.append(
            Chart("box", "boxplot", "Distributions compared", box_stats(df, boxed, stats=m, quartiles=q))
        )
    if cols.texts and cols.numbers:
        text, num = cols.texts[0], cols.numbers[0]
        charts.append(
            Chart("grouped", f"{text}_{num}", f"{label(num)} by {label(text)}", category_summary(df, text, num))
        )
    return charts


def chart_list(df: DataFrame, charts: Sequence[Chart]) -> DataFrame:
    """``ord, type, column, title`` of each chart."""
    rows = [(i, c.type, c.column, c.title) for i, c in enumerate(charts)]
    return small_frame(df, rows, "ord int, type string, column string, title string")


def report_charts(chart_list: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` charts by type preference; types without one come last."""
    types = F.array(*[F.lit(t) for t in REPORT_ORDER])
    place = F.coalesce(F.nullif(F.array_position(types, F.col("type")), F.lit(0)), F.lit(99))
    return chart_list.withColumn("place", place).orderBy("place", "ord").limit(k).drop("place")
