"""Findings: rules over small profile frames.

A profile is computed once. Every rule is one entry in a list: a condition and
the figures it reports, as column expressions over a frame with one row per
table, per column or per set of pairs. All rules of a frame fire in one select.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.config import INSIGHTS, LEGACY_INSIGHTS, InsightConfig
from scrubline.functions.dates import day_label, span_days
from scrubline.functions.numbers import compact, round_even
from scrubline.functions.text import humanise
from scrubline.jobs import together
from scrubline.operators.columns import (
    data_columns, date_columns, numeric_columns, quoted, small_frame, text_columns,
)
from scrubline.operators.correlation import correlation_pairs
from scrubline.operators.frequencies import named_by, top_of, value_digests
from scrubline.operators.normality import jarque_bera, shapiro_sample
from scrubline.operators.profile import Moments, moments, null_counts
from scrubline.operators.quantiles import medians
from scrubline.plans.cleaning import Report

# The categories findings are filed under.
OVERVIEW = "Executive Overview"
QUALITY = "Data Quality"
STATISTICS = "Statistical Highlights"
DISTRIBUTION = "Distribution Analysis"
CORRELATION = "Correlation Analysis"
FIELDS = "Field Analysis"
TIME = "Time Analysis"
ADVICE = "Recommendation"

LEGACY_OVERVIEW, LEGACY_STATISTICS, LEGACY_PATTERNS = "Dataset Overview", "Statistics", "Patterns"


@dataclass(frozen=True)
class Rule:
    """When it fires, and what it then says."""

    id: str
    category: str
    when: Column
    metric: Column
    title: Column
    detail: Column
    severity: Column | str = "info"
    subject: Column | None = None

    def finding(self, place: int) -> Column:
        severity = F.lit(self.severity) if isinstance(self.severity, str) else self.severity
        subject = F.lit(None).cast("string") if self.subject is None else self.subject
        row = F.struct(
            F.lit(place).alias("place"),
            F.lit(self.id).alias("rule"),
            F.lit(self.category).alias("category"),
            severity.alias("severity"),
            subject.alias("subject"),
            self.metric.cast("double").alias("metric"),
            self.title.alias("title"),
            self.detail.alias("detail"),
        )
        return F.when(self.when, row)


def fire(frame: DataFrame, chapter: int, rules: Sequence[Rule]) -> DataFrame:
    """All findings of one frame. A condition on an unknown figure does not fire."""
    found = F.array_compact(F.array(*[r.finding(i) for i, r in enumerate(rules)]))
    ord_ = F.col("ord") if "ord" in frame.columns else F.lit(0)
    return frame.select(F.lit(chapter).alias("chapter"), ord_.cast("int").alias("ord"), F.inline(found))


def say(template: str, *parts) -> Column:
    return F.format_string(template, *parts)


def whole(c: Column | str) -> Column:
    """A count with thousands separators."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def listed(c: str, k: int) -> Column:
    return F.array_join(F.slice(c, 1, k), ", ")


# ── profile frames ──


def table_frame(df: DataFrame, report: Report, rows: int, nulls: dict[str, int]) -> DataFrame:
    """One row: the size of the table and what cleaning did to it."""
    cells = rows * len(nulls)
    worst = max(report.fences, key=lambda f: f.outside, default=None)
    row = (
        rows, len(nulls), len(numeric_columns(df)), len(text_columns(df)), len(date_columns(df)),
        (1 - sum(nulls.values()) / max(cells, 1)) * 100, report.quality_before, report.quality_after,
        sum(f.count for f in report.fills), [f.column for f in report.fills],
        sorted({f.strategy for f in report.fills}), report.exact_removed, report.key_removed,
        sum(f.outside for f in report.fences), [f.column for f in report.fences],
        worst and worst.column, worst and worst.outside, worst and worst.pct,
        report.currency, report.date_features,
    )
    schema = (
        "rows bigint, columns int, numerics int, texts int, dates int, completeness double, "
        "quality_before double, quality_after double, filled bigint, filled_columns array<string>, "
        "strategies array<string>, exact_removed bigint, key_removed bigint, capped bigint, "
        "capped_columns array<string>, worst string, worst_count bigint, worst_pct double, "
        "currency array<string>, features array<string>"
    )
    return small_frame(df, [row], schema)


def numeric_frame(df: DataFrame, config: InsightConfig, normality: str, m: dict[str, Moments]) -> DataFrame:
    """One row per leading numeric column: moments, median and normality."""
    cols = numeric_columns(df)[: max(config.stat_columns, config.normality_columns)]
    schema = (
        "ord int, column string, n bigint, mean double, median double, std double, min double, "
        "max double, skew double"
    )
    med = medians(df, cols, {c: m[c].n for c in cols}) if cols else {}
    rows = [(i, c, m[c].n, m[c].mean, med[c], m[c].std, m[c].min, m[c].max, m[c].skew) for i, c in enumerate(cols)]
    variation = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide("std", "mean") * 100)
    frame = small_frame(df, rows, schema).withColumn("variation", variation)
    tested = cols[: config.normality_columns] if normality != "none" else []
    if not tested:
        return frame.withColumn("p", F.lit(None).cast("double"))
    p = jarque_bera(df, tested) if normality == "jarque_bera" else shapiro_sample(df, tested)
    return frame.join(F.broadcast(p.select("column", "p")), "column", "left")


def text_frame(df: DataFrame, config: InsightConfig, rows: int) -> DataFrame:
    """One row per leading text column: distinct values and the three most frequent, from one table of digests."""
    cols = text_columns(df)[: config.text_columns]
    schema = "ord int, column string, rows bigint"
    frame = small_frame(df, [(i, c, rows) for i, c in enumerate(cols)], schema)
    if not cols:
        return frame.select("*", F.lit(0).alias("n_distinct"), F.lit(None).cast(_TOP).alias("top"))
    digests = value_digests(df, cols)
    top = (
        top_of(df, cols, digests, 3)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    )
    distinct = digests.groupBy("ord").agg(F.count(F.lit(1)).alias("n_distinct")).select(named_by(cols), "n_distinct")
    return frame.join(F.broadcast(distinct), "column", "left").join(F.broadcast(top), "column", "left")


_TOP = "array<struct<rank:int,value:string,n:bigint>>"


def date_frame(df: DataFrame, config: InsightConfig) -> DataFrame:
    """One row per leading date column: first and last day."""
    cols = date_columns(df)[: config.date_columns]
    if not cols:
        return small_frame(df, [], "ord int, column string, first timestamp_ntz, last timestamp_ntz")
    wide = df.agg(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(c).alias("column"),
                F.min(quoted(c)).cast("timestamp_ntz").alias("first"),
                F.max(quoted(c)).cast("timestamp_ntz").alias("last"),
            ).alias(f"d{i}")
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(F.inline(F.array(*[f"d{i}" for i in range(len(cols))])))


def pair_frame(df: DataFrame, config: InsightConfig, m: dict[str, Moments], rows: int) -> DataFrame:
    """One row: how many pairs are strongly or moderately correlated, and which come first."""
    pairs = correlation_pairs(df, None, m, rows)
    size = F.abs("r")
    strong = size >= config.strong_r
    moderate = (size >= config.moderate_r) & ~strong
    pair = F.struct("ord", "a", "b", "r")
    first = lambda hit: F.slice(F.sort_array(F.collect_list(F.when(hit, pair))), 1, 3)
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(strong).alias("strong"),
        F.count_if(moderate).alias("moderate"),
        first(strong).alias("strong_pairs"),  # pairs of columns, not of rows
        first(moderate).alias("moderate_pairs"),
    )


# ── rules ──


def overview_rules() -> list[Rule]:
    c = F.col
    return [
        Rule(
            "I1", OVERVIEW, F.lit(True), c("rows"),
            say("%s records in %s fields", whole("rows"), c("columns")),
            say(
                "%s numeric, %s text and %s date field(s); %.1f%% complete; quality score %s before, %s after cleaning.",
                c("numerics"), c("texts"), c("dates"), c("completeness"), c("quality_before"), c("quality_after"),
            ),
        )
    ]


def quality_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    delta = c("quality_after") - c("quality_before")
    removed = c("exact_removed") + c("key_removed")
    return [
        Rule(
            "I2", QUALITY, delta > 0, round_even(delta, 1),
            say("Quality score up by %.1f points", delta),
            say("From %s to %s out of 100.", c("quality_before"), c("quality_after")),
            "success",
        ),
        Rule(
            "I3", QUALITY, F.size("filled_columns") > 0, c("filled"),
            say("%s missing values filled in %s field(s)", whole("filled"), F.size("filled_columns")),
            say("Fields: %s. Strategies: %s.", listed("filled_columns", 3), F.array_join("strategies", ", ")),
            "warning",
        ),
        Rule(
            "I4", QUALITY, removed > 0, removed,
            say("%s duplicate record(s) removed", whole(removed)),
            say("%s exact copies, %s repeats of the business key.", c("exact_removed"), c("key_removed")),
            F.when(removed < config.many_duplicates, "warning").otherwise("error"),
        ),
        Rule(
            "I5", QUALITY, F.size("capped_columns") > 0, c("capped"),
            say("%s outlier(s) capped in %s field(s)", whole("capped"), F.size("capped_columns")),
            say("%s has the most: %s, %.1f%% of rows.", humanise(c("worst")), c("worst_count"), c("worst_pct")),
            "warning", c("worst"),
        ),
        Rule(
            "I6", QUALITY, F.size("currency") > 0, F.size("currency"),
            say("%s money field(s) read as numbers", F.size("currency")),
            say("Fields: %s.", listed("currency", 3)),
        ),
        Rule(
            "I7", QUALITY, F.size("features") > 0, F.size("features"),
            say("%s time feature(s) added", F.size("features")),
            say("Fields: %s.", listed("features", 5)),
            "success",
        ),
        Rule(
            "I8", QUALITY,
            (F.size("filled_columns") == 0) & (c("exact_removed") == 0) & (F.size("capped_columns") == 0), F.lit(0),
            F.lit("The table came in excellent condition"),
            F.lit("Nothing was missing, copied or out of range."),
            "success",
        ),
    ]


def statistic_rules(config: InsightConfig, category: str = STATISTICS) -> list[Rule]:
    c = F.col
    measured = (c("ord") < config.stat_columns) & (c("n") >= config.min_stat_rows)
    label = humanise(c("column"))
    return [
        Rule(
            "I9", category, measured & (F.abs("skew") > config.skew_limit), round_even(F.col("skew"), 2),
            say("%s is skewed to the %s", label, F.when(c("skew") > 0, "right").otherwise("left")),
            say("Skewness %.2f, mean %s, median %s.", c("skew"), compact(c("mean")), compact(c("median"))),
            subject=c("column"),
        ),
        Rule(
            "I10", category, measured & (c("variation") > config.variation_limit), round_even(F.col("variation"), 2),
            say("%s varies widely", label),
            say("Variation %.0f%%, from %s to %s.", c("variation"), compact(c("min")), compact(c("max"))),
            subject=c("column"),
        ),
    ]


def normality_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    normal = c("p") > config.normal_p
    return [
        Rule(
            "I11", DISTRIBUTION,
            (c("ord") < config.normality_columns) & (c("n") >= config.min_normality_rows) & c("p").isNotNull(),
            round_even(F.col("p"), 4),
            say("%s looks %s", humanise(c("column")), F.when(normal, "normally distributed").otherwise("not normal")),
            say("p = %.4f; prefer the %s.", c("p"), F.when(normal, "mean").otherwise("median")),
            subject=c("column"),
        )
    ]


def _pair_list(name: str) -> Column:
    return F.array_join(
        F.transform(name, lambda p: F.format_string("%s & %s (r = %.2f)", p["a"], p["b"], p["r"])), "; "
    )


def correlation_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    first = F.get("strong_pairs", F.lit(0))
    return [
        Rule(
            "I12", CORRELATION, c("strong") > 0, round_even(first["r"], 2),
            say("%s and %s are strongly correlated", humanise(first["a"]), humanise(first["b"])),
            say("r = %.2f; %s more strong pair(s).", first["r"], c("strong") - 1),
            F.when(F.abs(first["r"]) > config.very_strong_r, "warning").otherwise("info"),
            F.concat_ws(",", first["a"], first["b"]),
        ),
        Rule(
            "I13", CORRELATION, c("moderate") > 0, c("moderate"),
            say("%s moderate correlation(s)", c("moderate")), _pair_list("moderate_pairs"),
        ),
        Rule(
            "I14", CORRELATION, (c("pairs") > 0) & (c("strong") + c("moderate") == 0), F.lit(0),
            F.lit("No correlated numeric fields"), F.lit("The numeric fields vary independently."), "success",
        ),
    ]


def field_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    label, top = humanise(c("column")), F.get("top", F.lit(0))
    share = F.try_divide(top["n"], c("rows"))
    unique = c("n_distinct") == c("rows")
    binary = ~unique & (c("n_distinct") <= config.binary_distinct)
    tops = F.array_join(F.transform("top", lambda t: F.format_string("%s (%s)", t["value"], t["n"])), ", ")
    return [
        Rule(
            "I15", FIELDS, unique, c("n_distinct"),
            say("%s identifies every record", label), F.lit("All values differ: leave it out of groupings."),
            subject=c("column"),
        ),
        Rule(
            "I16", FIELDS, binary, round_even(share * 100, 2),
            say("%s is mostly %s", label, top["value"]), say("%.0f%% of records share one value.", share * 100),
            F.when(share > config.binary_share, "warning").otherwise("info"), c("column"),
        ),
        Rule(
            "I17", FIELDS, ~unique & ~binary & (share > config.dominant_share), round_even(share * 100, 2),
            say("%s has a dominant value: %s", label, top["value"]), say("Most frequent: %s.", tops),
            subject=c("column"),
        ),
    ]


def time_rules(category: str = TIME) -> list[Rule]:
    c = F.col
    span = span_days(c("first"), c("last"))
    return [
        Rule(
            "I18", category, c("first").isNotNull(), span,
            say("%s covers %s days", humanise(c("column")), whole(span)),
            say("From %s to %s.", day_label(c("first")), day_label(c("last"))),
            subject=c("column"),
        )
    ]


def advice_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    model, series, large = (c("numerics") >= 2) & (c("texts") > 0), c("dates") > 0, c("rows") > config.large_rows
    return [
        Rule(
            "I19", ADVICE, model, c("numerics"), F.lit("Ready for classification or regression"),
            say("%s numeric and %s text fields.", c("numerics"), c("texts")), "success",
        ),
        Rule(
            "I20", ADVICE, series, c("dates"), F.lit("Trend and time-series analysis are possible"),
            say("%s date field(s).", c("dates")), "success",
        ),
        Rule(
            "I21", ADVICE, large, c("rows"), F.lit("Large table: explore a stratified sample first"),
            say("%s rows.", whole("rows")),
        ),
        Rule(
            "I22", ADVICE, ~model & ~series & ~large, F.lit(0), F.lit("Explore the cleaned table in a dashboard"),
            F.lit("No modelling advice applies."),
        ),
    ]


def chapters(frames: Sequence[DataFrame]) -> DataFrame:
    """Findings of all frames, to be read in the order of chapter, ord and place."""
    return reduce(DataFrame.unionByName, frames)


def insights(
    df: DataFrame, report: Report | None = None, config: InsightConfig = INSIGHTS, normality: str = "shapiro"
) -> DataFrame:
    """All findings about a cleaned table, in order of ``chapter, ord, place``."""
    report = report or Report()
    df = df.select(*[quoted(c) for c in data_columns(df)])
    (rows, nulls), m = together(lambda: null_counts(df), lambda: moments(df, numeric_columns(df)))
    table = table_frame(df, report, rows, nulls)
    numbers = numeric_frame(df, config, normality, m)
    return chapters(
        [
            fire(table, 0, overview_rules()),
            fire(table, 1, quality_rules(config)),
            fire(numbers, 2, statistic_rules(config)),
            fire(numbers, 3, normality_rules(config)),
            fire(pair_frame(df, config, m, rows), 4, correlation_rules(config)),
            fire(text_frame(df, config, rows), 5, field_rules(config)),
            fire(date_frame(df, config), 6, time_rules()),
            fire(table, 7, advice_rules(config)),
        ]
    )


# ── the older variant ──


def legacy_quality_rules() -> list[Rule]:
    c = F.col
    return [
        Rule(
            "L1", LEGACY_OVERVIEW, F.lit(True), c("rows"), say("%s rows in %s columns", whole("rows"), c("columns")),
            say(
                "%s numeric, %s text and %s date column(s); %.1f%% complete.",
                c("numerics"), c("texts"), c("dates"), c("completeness"),
            ),
        ),
        Rule(
            "L2", QUALITY, F.size("filled_columns") > 0, c("filled"),
            say("%s missing value(s) filled", whole("filled")), say("Columns: %s.", listed("filled_columns", 4)),
            "warning",
        ),
        Rule(
            "L3", QUALITY, F.size("filled_columns") == 0, F.lit(0),
            F.lit("No missing values"), F.lit("Nothing had to be filled."), "success",
        ),
        Rule(
            "L4", QUALITY, c("exact_removed") > 0, c("exact_removed"),
            say("%s duplicate row(s) removed", whole("exact_removed")), F.lit("Exact copies only."), "warning",
        ),
        Rule(
            "L5", QUALITY, F.size("capped_columns") > 0, c("capped"),
            say("%s outlier(s) capped", whole("capped")), say("Columns: %s.", listed("capped_columns", 3)), "warning",
        ),
    ]


def legacy_correlation_rules() -> list[Rule]:
    return [
        Rule(
            "L6", LEGACY_STATISTICS, F.col("strong") > 0, F.col("strong"),
            say("%s strongly correlated pair(s)", F.col("strong")), _pair_list("strong_pairs"),
        )
    ]


def legacy_field_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    unique = c("n_distinct") == c("rows")
    tops = F.array_join(F.transform("top", lambda t: F.format_string("%s (%s)", t["value"], t["n"])), ", ")
    return [
        Rule(
            "L7", LEGACY_PATTERNS, unique, c("n_distinct"),
            say("%s identifies every row", c("column")), F.lit("All values differ."), subject=c("column"),
        ),
        Rule(
            "L8", LEGACY_PATTERNS, ~unique & (c("n_distinct") <= config.few_distinct), c("n_distinct"),
            say("%s has %s values", c("column"), c("n_distinct")), say("Most frequent: %s.", tops), "success",
            c("column"),
        ),
    ]


def legacy_advice_rules(config: InsightConfig) -> list[Rule]:
    c = F.col
    return [
        Rule("L10", ADVICE, c("numerics") >= 2, c("numerics"), F.lit("Ready for regression"),
             say("%s numeric columns.", c("numerics")), "success"),
        Rule("L11", ADVICE, (c("texts") > 0) & (c("numerics") > 0), c("texts"),
             F.lit("Suited to classification and segmentation"), F.lit("Text and numeric columns."), "success"),
        Rule("L12", ADVICE, c("rows") > config.large_rows, c("rows"),
             F.lit("Large table: sample it first"), say("%s rows.", whole("rows"))),
    ]


def legacy_insights(
    df: DataFrame, report: Report | None = None, config: InsightConfig = LEGACY_INSIGHTS
) -> DataFrame:
    """Findings by the older variant's rules."""
    report = report or Report()
    (rows, nulls), m = together(lambda: null_counts(df), lambda: moments(df, numeric_columns(df)))
    table = table_frame(df, report, rows, nulls)
    return chapters(
        [
            fire(table, 0, legacy_quality_rules()),
            fire(numeric_frame(df, config, "none", m), 1, statistic_rules(config, LEGACY_STATISTICS)),
            fire(pair_frame(df, config, m, rows), 2, legacy_correlation_rules()),
            fire(text_frame(df, config, rows), 3, legacy_field_rules(config)),
            fire(date_frame(df, config), 4, time_rules(LEGACY_PATTERNS)),
            fire(table, 5, legacy_advice_rules(config)),
        ]
    )
