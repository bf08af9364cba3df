"""One callable per operator: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import table
from scrubline.config import INSIGHTS, LEGACY, CleanConfig
from scrubline.functions import dates as D
from scrubline.functions import numbers as N
from scrubline.functions import text as X
from scrubline.functions.names import normalise_names
from scrubline.operators import correlation, distribution, duplicates, frequencies, missing, normality
from scrubline.operators import outliers, profile, quality, roles, summaries
from scrubline.operators.columns import ROW_ID, row_order
from scrubline.operators.ordering import numbered
from scrubline.plans import charts, cleaning, insights, report
from scrubline.sources import runs, sinks, tables
from scrubline.staging import new_path
from scrubline.streaming.frozen import apply_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: N.round_even(F.col(c).cast("double"), digits) for c in cols})


# ── flagship ──


@query
def capped_value_stats(spark, sf):
    """Cap the outliers of event values, then summarise per event type."""
    df = table(spark, sf, "events").select("event_type", "value")
    capped = outliers.cap(df, outliers.tukey_fences(df, ["value"]))
    v = F.col("value")
    return rounded(
        capped.groupBy("event_type").agg(
            F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"),
        ),
        4, "total", "mean", "std", "low", "high",
    )


# ── sources and sinks ──


@query
def csv_round_trip(spark, sf):
    """Written as CSV and read back: whole numbers of 19 and 22 digits keep every digit."""
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "long_ids"), path)
    return tables.read_table(spark, path, "csv")


@query
def csv_round_trip_cleaned(spark, sf):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf, "long_ids"), path)
    return cleaning.clean(tables.read_table(spark, path, "csv", row_id=True)).table.select("id_19", "id_22")


@query
def run_append(spark, sf):
    """Runs appended to the history in two writes, with more rows than 32 bits count."""
    path = new_path(spark, "runs")
    rows = table(spark, sf, "event_runs").withColumn("original_rows", F.col("original_rows") + F.lit(3_000_000_000))
    blank = {c: F.lit(None).cast("string") for c in ("columns", "insights_json", "charts_json", "cleaning_json")}
    full = rows.withColumns(blank).withColumn("cleaned_rows", F.col("cleaned_rows").cast("bigint"))
    for part in (0, 1):
        runs.append_runs(full.where(F.col("id") % 2 == part), path)
    return runs.read_runs(spark, path).select("id", "user_id", "original_rows", "cleaned_rows")


@query
def run_append_twice(spark, sf):
    """Both halves of the history appended twice, as after a failed job; then one owner's runs."""
    path, compacted = new_path(spark, "runs"), new_path(spark, "runs")
    rows = table(spark, sf, "event_runs")
    blank = {c: F.lit(None).cast("string") for c in ("columns", "insights_json", "charts_json", "cleaning_json")}
    full = rows.withColumns(blank).withColumns({c: F.col(c).cast("bigint") for c in ("original_rows", "cleaned_rows")})
    for part in (0, 1, 1, 0):
        runs.append_runs(full.where(F.col("id") % 2 == part), path)
    runs.compact_runs(spark, path, compacted)
    owner = rows.agg(F.max("user_id")).first()[0]
    every = runs.run_counts(runs.read_runs(spark, path)).select("user_id", "runs", F.lit(False).alias("compacted"))
    own = runs.run_counts(runs.read_runs(spark, compacted, owner)).select("user_id", "runs", F.lit(True).alias("compacted"))
    return every.union(own)


@query
def owner_history(spark, sf):
    df = table(spark, sf, "event_runs")
    return runs.history(df, owner=df.agg(F.min("user_id")).first()[0]).select("id", "user_id", "removed_rows")


@query
def fetch_run(spark, sf):
    """A run asked for by its owner, and the same run asked for by another."""
    df = table(spark, sf, "event_runs")
    run, owner = df.select("id", "user_id").orderBy("id").first()
    return runs.fetch_run(df, run, owner).union(runs.fetch_run(df, run, owner + 1)).select("id", "user_id", "filename")


@query
def load_summary(spark, sf):
    return rounded(tables.load_summary(table(spark, sf, "dirty_events")), 4, "null_pct")


@query
def preview(spark, sf):
    return tables.preview(table(spark, sf, "orders"), 6, ["o_orderkey"])


@query
def table_shape(spark, sf):
    return rounded(profile.table_shape(table(spark, sf, "dirty_orders")), 4, "completeness_pct")


@query
def clean_export(spark, sf):
    return sinks.export_layout(table(spark, sf, "orders"))


@query
def json_rows(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    text = df.select("c_custkey", sinks.to_json(df).alias("json"))
    back = sinks.from_json(F.col("json"), df.schema)
    return text.select("c_custkey", "json", back["c_mktsegment"].alias("segment"))


@query
def run_history(spark, sf):
    return runs.history(table(spark, sf, "event_runs"))


@query
def run_counts(spark, sf):
    return runs.run_counts(table(spark, sf, "event_runs"))


# ── names and roles ──


@query
def rename_columns(spark, sf):
    """Priorities become columns, and the columns get clean names."""
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority").agg(F.sum("o_totalprice"))
    named, _ = normalise_names(wide)
    return rounded(named, 2, *[c for c in named.columns if c != "o_orderstatus"])


_ROLE_TABLES = {
    "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"],
    "dirty_orders": ["o_orderkey"], "dirty_lineitem": ["l_orderkey", "l_linenumber"], "lineitem": ["l_orderkey"],
}


@query
def role_profile(spark, sf):
    out = None
    for name, order in _ROLE_TABLES.items():
        df = table(spark, sf, name)
        part = roles.role_frame(df, roles.infer_roles(df, order)).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def role_counts(spark, sf):
    df = table(spark, sf, "lineitem")
    return roles.role_counts(roles.role_frame(df, roles.infer_roles(df, ["l_orderkey"])))


@query
def first_values(spark, sf):
    df = table(spark, sf, "dirty_orders")
    cols = ["o_orderpriority", "sparse_status", "o_orderdate_txt"]
    return roles.first_values(df, cols, ["o_orderkey"], 50)


@query
def role_evidence(spark, sf):
    df = table(spark, sf, "dirty_lineitem")
    order = row_order(df, ["l_orderkey", "l_linenumber"])
    shares = roles.sample_shares(roles.first_values(df, ["price_txt", "disc_txt", "qty_txt"], order, 50))
    return rounded(shares, 4, "email", "currency", "percent", "date")


# ── values ──


@query
def fake_nulls(spark, sf):
    return table(spark, sf, "dirty_events").select("event_id", X.null_fakes(F.col("event_type")).alias("event_type"))


@query
def currency_parse(spark, sf):
    return table(spark, sf, "dirty_lineitem").select(
        "l_orderkey", "l_linenumber", N.parse_currency(F.col("price_txt")).alias("price")
    )


@query
def percent_parse(spark, sf):
    df = table(spark, sf, "dirty_lineitem")
    share = N.parse_percent(X.null_fakes(F.col("disc_txt")))
    return df.select("l_orderkey", "l_linenumber", N.round_even(share, 4).alias("discount"))


@query
def text_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalise_text(F.col("text")).alias("text"))


@query
def title_case(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", X.title_case(F.col("p_name")).alias("name"), X.title_case(F.col("p_brand")).alias("brand"),
        X.title_case(F.concat_ws("'", "p_type", "p_brand")).alias("type_brand"),
    )


@query
def numeric_coerce_gate(spark, sf):
    df = table(spark, sf, "dirty_lineitem").select("l_orderkey", "l_linenumber", "price_txt", "qty_txt")
    return cleaning.coerce_numbers(df, ["price_txt", "qty_txt"])[0]


@query
def parse_dates(spark, sf):
    df = table(spark, sf, "dirty_orders").select("o_orderkey", "o_orderdate_txt")
    fmt = cleaning.guess_format(df, "o_orderdate_txt", ["o_orderkey"])
    return df.select("o_orderkey", cleaning.parsed_date("o_orderdate_txt", fmt).alias("day"))


@query
def parse_mixed_dates(spark, sf):
    return table(spark, sf, "mixed_dates").select("o_orderkey", D.parse_mixed_date(F.col("day_txt")).alias("day"))


@query
def date_parts(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", *D.date_parts(F.col("o_orderdate"), D.feature_base("o_order_date")))


@query
def z_scores(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    m = profile.moments(df, ["value"])["value"]
    v = F.col("value")
    return rounded(
        df.select("event_id", N.z_score(v, m.mean, m.std_pop).alias("z"), N.z_score(v, m.mean, m.std).alias("z_sample")),
        4, "z", "z_sample",
    )


@query
def display_texts(spark, sf):
    df = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    return df.select(
        "o_orderkey",
        X.humanise(F.lower(F.concat_ws("_", "o_orderpriority", "o_orderstatus"))).alias("label"),
        X.truncate(F.col("o_orderpriority"), 8).alias("short"),
        N.compact(price).alias("compact"),
        N.compact(price / 1000, 2).alias("compact_small"),
        N.compact_axis(price / 1e6).alias("axis"),
        N.compact_dashboard(price / 1000).alias("dashboard"),
        N.quality_band(price / 5000).alias("band"),
        N.clamp_pct(price / 5000).alias("clamped"),
    )


@query
def date_labels(spark, sf):
    df = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return df.select(
        "o_orderkey", D.iso_day(d).alias("iso"), D.day_label(d).alias("day_label"), D.month_label(d).alias("month_label"),
        D.month_end(d).alias("month_end"),
    )


# ── missing values ──


@query
def null_profile(spark, sf):
    return rounded(profile.null_profile(table(spark, sf, "dirty_lineitem")), 4, "null_pct")


@query
def drop_sparse(spark, sf):
    df = table(spark, sf, "dirty_orders")
    rows, nulls = profile.null_counts(df)
    found = roles.infer_roles(df, ["o_orderkey"], counted=(rows, nulls))
    return df.drop(*missing.sparse_columns(found, rows, nulls))


def _filled(df, name, role, kind):
    rows, nulls = profile.null_counts(df, [name])
    return missing.apply_fills(df, missing.decide_fills(df, [roles.Role(name, role, kind)], rows, nulls))


@query
def impute_numeric(spark, sf):
    df = table(spark, sf, "dirty_lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _filled(df, "l_quantity", "numeric", "numeric")


@query
def impute_skewed(spark, sf):
    return _filled(table(spark, sf, "dirty_events").select("event_id", "value"), "value", "numeric", "numeric")


@query
def impute_mode(spark, sf):
    df = table(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    return _filled(df, "o_orderpriority", "categorical", "text")


@query
def impute_unknown(spark, sf):
    df = table(spark, sf, "dirty_orders").select("o_orderkey", "sparse_status")
    return _filled(df, "sparse_status", "categorical", "text")


@query
def fill_in_order(spark, sf):
    df = table(spark, sf, "dirty_events").select("event_id", "day_txt")
    return missing.fill_in_order(df, ["day_txt"], ["event_id"])


# ── duplicates ──


@query
def duplicate_count(spark, sf):
    return duplicates.duplicate_count(table(spark, sf, "dup_orders"))


@query
def exact_dedup(spark, sf):
    return duplicates.drop_exact(table(spark, sf, "dup_orders"))


@query
def business_key_dedup(spark, sf):
    return duplicates.drop_key_repeats(table(spark, sf, "lineitem"), ["l_orderkey", "l_shipdate"])


# ── outliers ──


@query
def clip_outliers(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(outliers.cap(df, outliers.tukey_fences(df, ["value"])), 4, "value")


@query
def outlier_counts(spark, sf):
    df = table(spark, sf, "events")
    found = outliers.count_outside(df, outliers.tukey_fences(df, ["value"]))
    return outliers.outlier_report(df, found)


# ── statistics ──


@query
def numeric_stats(spark, sf):
    return profile.numeric_stats(table(spark, sf, "lineitem"))


@query
def describe(spark, sf):
    return profile.describe(table(spark, sf, "lineitem"))


@query
def variation(spark, sf):
    return rounded(profile.variation(table(spark, sf, "lineitem")), 4, "variation_pct")


@query
def quantiles(spark, sf):
    """Order statistics of money columns, down to the far tails."""
    df = table(spark, sf, "lineitem")
    q = profile.exact_quantiles(df, ["l_extendedprice", "l_quantity"], [0.01, 0.25, 0.5, 0.75, 0.99])
    rows = [(c, p, v) for c, per in q.items() for p, v in per.items()]
    return rounded(spark.createDataFrame(rows, "column string, p double, value double"), 4, "value")


@query
def value_counts(spark, sf):
    return frequencies.value_counts(table(spark, sf, "part"), "p_name")


@query
def topn_other(spark, sf):
    return rounded(frequencies.top_with_other(table(spark, sf, "part"), "p_name"), 4, "share_pct")


@query
def distinct_counts(spark, sf):
    df = table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    found = frequencies.distinct_counts(df, df.columns)
    return spark.createDataFrame(list(found.items()), "column string, n_distinct bigint")


@query
def distinct_counts_wide(spark, sf):
    """Every column of lineitem, of all types, by digests in one tall shuffle."""
    df = table(spark, sf, "lineitem")
    found = frequencies.distinct_counts(df, df.columns)
    return spark.createDataFrame(list(found.items()), "column string, n_distinct bigint")


@query
def top_values(spark, sf):
    return frequencies.top_values(table(spark, sf, "events"), ["event_type", "props"], 3)


@query
def top_values_long_text(spark, sf):
    """Whole texts that are copied most often; the winners' texts alone are shuffled."""
    found = frequencies.top_values(table(spark, sf, "documents"), ["text", "source", "lang"], 5)
    return found.withColumn("value", F.md5("value"))


@query
def first_values_sparse(spark, sf):
    """The first values of columns that are mostly missing, in one scan of the numbered table."""
    df = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    cells = [F.when(key % (k + 40) == k, F.concat_ws("-", F.lit(f"c{k}"), key.cast("string"))).alias(f"c{k}") for k in range(12)]
    rows = numbered(df.select("o_orderkey", *cells), ["o_orderkey"])
    return roles.first_values(rows, [f"c{k}" for k in range(12)], [ROW_ID], 50)


@query
def correlation_pairs(spark, sf):
    return rounded(correlation.correlation_pairs(table(spark, sf, "lineitem")), 4, "r")


@query
def correlation_with_gaps(spark, sf):
    df = table(spark, sf, "dirty_events").select("event_id", "user_id", "value", F.lit(1).alias("constant"))
    return rounded(correlation.correlation_pairs(df), 4, "r")


@query
def correlation_wide(spark, sf):
    """Three hundred columns, every other one with gaps."""
    x, y, z = (F.col(c) for c in ("o_totalprice", "o_custkey", "o_orderkey"))
    wave = lambda k: (z * (2 * k + 1) + y * (k % 7)) % 101 + (x % 97) * (k % 5)
    cells = [F.when((z % (k + 3) != 0) | F.lit(k % 2 == 0), wave(k)).alias(f"c{k}") for k in range(300)]
    found = correlation.correlation_pairs(table(spark, sf, "orders").select(*cells))
    return rounded(found.where(F.abs("r") > 0.2), 4, "r")


@query
def normality_jb(spark, sf):
    return rounded(normality.jarque_bera(table(spark, sf, "events"), ["value"]), 3, "statistic", "p")


@query
def shapiro_sample(spark, sf):
    found = normality.shapiro_sample(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rounded(rounded(found, 6, "w"), 4, "p")


@query
def shapiro_keyed(spark, sf):
    """The same test on values drawn by the rows' keys, all columns in one scan."""
    found = normality.shapiro_sample(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return rounded(rounded(found, 6, "w"), 4, "p")


@query
def histogram_far_tail(spark, sf):
    """One value far away from the others: most bins are empty."""
    df = table(spark, sf, "events").select(F.when(F.col("event_id") == 0, 1e15).otherwise(F.col("value")).alias("value"))
    return distribution.histogram(df, "value", distribution.Bins(0.0, 1e15, 10**13)).select("bin", "n")


@query
def histogram_auto(spark, sf):
    return rounded(distribution.histogram(table(spark, sf, "events"), "value"), 4, "low", "high")


@query
def kde_grid(spark, sf):
    df = table(spark, sf, "customer")
    m, bins = distribution.plan_bins(df, "c_acctbal")
    return rounded(distribution.density_curve(df, "c_acctbal", m.n * bins.width, m=m), 4, "x", "density")


@query
def box_stats(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(distribution.box_stats(df), 4, "whisker_low", "q1", "median", "q3", "whisker_high")


@query
def box_stats_skewed(spark, sf):
    df = table(spark, sf, "events")
    return rounded(distribution.box_stats(df, ["value"]), 4, "whisker_low", "q1", "median", "q3", "whisker_high")


@query
def monthly_trend(spark, sf):
    df = summaries.monthly_trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(
        df.select("month", "mean", "idx", "rolling", "slope", "intercept", "r", "trend", "direction"),
        4, "mean", "rolling", "slope", "intercept", "r", "trend",
    )


@query
def category_summary(spark, sf):
    df = summaries.category_summary(table(spark, sf, "part"), "p_name", "p_retailprice")
    return rounded(df, 4, "mean", "sum", "share_pct")


@query
def members_of_top(spark, sf):
    return summaries.members_of_top(table(spark, sf, "part"), "p_name").select("p_partkey", "p_name")


@query
def kpi_strip(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(summaries.key_figures(df), 2, "value")


@query
def quality_score(spark, sf):
    return quality.quality_score(table(spark, sf, "dirty_orders"))


# ── whole runs ──


def _cleaned_orders(spark, sf, config: CleanConfig = CleanConfig()):
    return cleaning.clean(table(spark, sf, "dirty_orders"), ["o_orderkey"], config)


@query
def clean_orders(spark, sf):
    return rounded(_cleaned_orders(spark, sf).table, 4, "o_totalprice")


@query
def clean_exact_money(spark, sf):
    """Gaps filled and outliers capped in decimals, to the last digit."""
    out = cleaning.clean(table(spark, sf, "exact_money"), ["o_orderkey"]).table
    return out.select("o_orderkey", F.col("amount").cast("string").alias("amount"), F.lit(dict(out.dtypes)["amount"]).alias("kind"))


@query
def clean_by_dropped_order(spark, sf):
    """Rows ordered by a column that the cleaning drops."""
    out = cleaning.clean(table(spark, sf, "dirty_orders"), ["sparse_status"]).table
    return rounded(out, 4, "o_totalprice")


@query
def clean_orders_legacy(spark, sf):
    return rounded(_cleaned_orders(spark, sf, LEGACY).table, 4, "o_totalprice")


@query
def clean_lineitem(spark, sf):
    df = table(spark, sf, "dirty_lineitem")
    out = cleaning.clean(df, ["l_orderkey", "l_linenumber"]).table
    return rounded(out, 4, "price_txt", "disc_txt", "l_quantity")


@query
def frozen_rules(spark, sf):
    """Decisions taken on the table, then applied row by row as a stream would."""
    df = table(spark, sf, "dirty_orders")
    done = cleaning.clean(df, ["o_orderkey"])
    return rounded(apply_report(df, done.report), 4, "o_totalprice")


@query
def legacy_stats(spark, sf):
    return report.legacy_stats(table(spark, sf, "lineitem"))


@query
def cleaning_log(spark, sf):
    """How many lines of each kind the cleaning log holds."""
    return _cleaned_orders(spark, sf).log().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def fill_detail(spark, sf):
    return report.fill_detail(_cleaned_orders(spark, sf)).drop("fill_value")


@query
def compare_before_after(spark, sf):
    return report.comparison(_cleaned_orders(spark, sf))


@query
def schema_table(spark, sf):
    df = table(spark, sf, "orders")
    return report.schema_table(df, roles.infer_roles(df, ["o_orderkey"]), ["o_orderkey"])


@query
def key_facts(spark, sf):
    return report.key_facts(table(spark, sf, "dirty_events"))


def _findings(df: DataFrame) -> DataFrame:
    return df.select("rule", "category", "severity", "subject", "metric")


@query
def insight_rules(spark, sf):
    return _findings(insights.insights(table(spark, sf, "lineitem"), normality="jarque_bera"))


@query
def insight_rules_skewed(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "event_type", "ts")
    return _findings(insights.insights(df, normality="jarque_bera"))


@query
def insight_rules_cleaned(spark, sf):
    done = _cleaned_orders(spark, sf)
    return _findings(report.findings(insights.insights(done.table, done.report, INSIGHTS, "none")))


@query
def insight_rules_legacy(spark, sf):
    return _findings(insights.legacy_insights(table(spark, sf, "lineitem")))


@query
def report_charts(spark, sf):
    df = table(spark, sf, "orders")
    found = charts.chart_datasets(df, roles.infer_roles(df, ["o_orderkey"]))
    return charts.report_charts(charts.chart_list(df, found)).select("ord", "type", "column")


@query
def chart_columns(spark, sf):
    df = table(spark, sf, "lineitem")
    heat = charts.chart_columns(df, roles.infer_roles(df, ["l_orderkey"])).numbers
    return rounded(charts.heatmap_chart(df, heat).data, 4, "r")
