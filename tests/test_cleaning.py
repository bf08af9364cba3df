import json
from datetime import date, datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.config import LEGACY, CleanConfig
from scrubline.operators import missing, roles
from scrubline.plans import charts, cleaning, insights, report
from scrubline.plans.analysis import analyse, run_record
from scrubline.sources import runs, sinks, tables
from scrubline.streaming.frozen import apply_report

HEADER = "Sale ID,Buyer,Zone,Units,Unit Price ($),Discount,Sold On,Notes"


def sale(i: int) -> str:
    zone = ["north", "SOUTH ", " east", "n/a"][i % 4]
    units = 900 if i == 7 else (-400 if i == 11 else i % 9 + 1)
    price = "" if i % 10 == 3 else f'"$1,{i % 90 + 100}.50"'
    rate = "-" if i % 12 == 5 else f"{i % 30}%"
    day = "" if i % 6 == 1 else f"2024-{i % 12 + 1:02}-{i % 27 + 1:02}"
    note = f"note  {i}" if i % 5 == 0 else ""
    return f"{i},Buyer {i},{zone},{units},{price},{rate},{day},{note}"


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sales") / "sales.csv"
    lines = [sale(i) for i in range(120)]
    path.write_text("\n".join([HEADER, *lines, lines[5], lines[9]]) + "\n", encoding="utf-8")
    return tables.read_table(spark, str(path), row_id=True)


@pytest.fixture(scope="module")
def cleaned(sales):
    return cleaning.clean(sales)


def test_csv_types(sales):
    kinds = dict(sales.dtypes)
    assert kinds["Sale ID"] == kinds["Units"] == "bigint"
    assert kinds["Unit Price ($)"] == kinds["Sold On"] == "string"
    assert sales.where(F.col("`Zone`").isNull()).count() > 0


def test_names_and_roles(cleaned):
    r = cleaned.report
    assert r.renames["Unit Price ($)"] == "unit_price" and r.renames["Sale ID"] == "sale_id"
    assert {x.column: x.role for x in r.roles} == {
        "sale_id": "id", "buyer": "text", "zone": "categorical", "units": "numeric", "unit_price": "currency",
        "discount": "pct", "sold_on": "date", "notes": "categorical",
    }


def test_values_and_fills(cleaned):
    t, r = cleaned.table, cleaned.report
    fills = {f.column: f for f in r.fills}
    assert r.dropped == ["notes"]
    assert set(fills) == {"zone", "unit_price", "discount", "sold_on"}
    assert fills["sold_on"].strategy == missing.IN_ORDER
    assert [x[0] for x in t.select("zone").distinct().orderBy("zone").collect()] == ["East", "North", "South"]
    assert t.agg(*[F.count_if(F.col(c).isNull()) for c in t.columns]).first() == tuple([0] * len(t.columns))


def test_duplicates_dates_outliers(cleaned):
    t, r = cleaned.table, cleaned.report
    assert (r.rows_before, r.exact_removed, r.rows_after, r.key) == (122, 2, 120, ["sale_id", "sold_on"])
    assert r.dates_parsed == ["sold_on"] and r.date_features == ["sold_on_year", "sold_on_month", "sold_on_quarter"]
    fence = {f.column: f for f in r.fences}["units"]
    ends = t.agg(F.min("units"), F.max("units")).first()
    assert fence.outside == 2 and tuple(ends) == (fence.lower, fence.upper)
    assert r.nulls_after == {c: 0 for c in t.columns}


def test_fill_along_the_file(cleaned):
    """Missing days take the day of the row above."""
    got = {r[0]: r[1] for r in cleaned.table.select("sale_id", "sold_on").collect()}
    assert got[1] == got[0] and got[7] == got[6] and got[13] == got[12]


def test_scores_and_log(cleaned):
    r = cleaned.report
    assert 10 <= r.quality_before < r.quality_after <= 100
    kinds = [x[0] for x in cleaned.log().select("type").distinct().collect()]
    assert set(kinds) == {"section", "detail", "step"}
    assert len(r.steps) == cleaned.log().where("type = 'step'").count()
    assert json.loads(json.dumps(r.as_dict()))["rows_after"] == 120


def test_nothing_to_do(spark):
    rows = [(i, f"Name {i}", ["Red", "Blue"][i % 2], i % 13) for i in range(60)]
    done = cleaning.clean(spark.createDataFrame(rows, "id int, name string, colour string, size int"), ["id"])
    r = done.report
    assert (r.renames, r.fills, r.dropped, r.fences, r.exact_removed, r.key_removed) == ({}, [], [], [], 0, 0)
    assert sorted(tuple(x) for x in done.table.collect()) == sorted(rows)
    assert r.quality_after == 100.0
    assert report.actions(done).first()["step"].startswith("Casing")


def test_partition_invariance(sales):
    base = None
    for parts in (1, 5, 40):
        done = cleaning.clean(sales.repartition(parts))
        got = sorted(map(str, done.table.collect()))
        base = base or got
        assert got == base


def test_properties_on_orders(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    done = cleaning.clean(df, ["o_orderkey"])
    assert done.table.count() <= df.count()
    assert done.table.select("o_orderkey").exceptAll(df.select("o_orderkey")).count() == 0
    assert 10 <= done.report.quality_after <= 100


def test_names_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(30)], "a int, b int, c string").toDF("Key", "KEY", "key")
    done = cleaning.clean(df)
    assert done.table.columns == ["key", "key_2", "key_3"] and done.report.rows_after == 30
    assert len(done.report.nulls_before) == 3


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None, None, None, None, None)],
    [(i, None, i % 2 == 0 if i < 3 else None, None, None, None, [i]) for i in range(8)],
    [(i, Decimal(i) / 4, i % 2 == 0, date(2024, 1, 1 + i % 20) if i % 3 else None, float("nan"), "  ", None) for i in range(40)],
])
def test_unusual_tables(spark, rows):
    """Empty, single-row, all-missing, NaN, decimal, boolean, date and array columns."""
    schema = "id int, amount decimal(10,2), flag boolean, day date, ratio double, note string, list array<int>"
    df = spark.createDataFrame(rows, schema)
    for config in (CleanConfig(), LEGACY):
        done = cleaning.clean(df, ["id"], config)
        assert done.table.count() == len(rows)
        assert insights.insights(done.table, done.report).count() > 0
        assert insights.legacy_insights(done.table, done.report).count() > 0
        for c in charts.chart_datasets(done.table, done.report.roles):
            c.data.collect()
    assert sorted(map(str, sinks.export_layout(df).columns)) == sorted(df.columns)


def test_date_only_key(spark):
    rows = [(f"2024-01-{i % 20 + 1:02}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "day string, v double")
    assert cleaning.clean(df, ["v"]).report.rows_after == 20
    assert cleaning.clean(df, ["v"], CleanConfig(require_both_keys=True)).report.rows_after == 60


def test_ambiguous_days_stay_text(spark):
    rows = [(i, f"{i % 28 + 1:02}-{i % 12 + 1:02}-2024") for i in range(4, 100)]
    df = spark.createDataFrame(rows, "id int, sold string")
    strict = cleaning.clean(df, ["id"])
    assert strict.report.date_formats == {} and dict(strict.table.dtypes)["sold"] == "string"
    mixed = cleaning.clean(df, ["id"], CleanConfig(date_mode="mixed"))
    assert mixed.report.dates_parsed == ["sold"] and mixed.table.where("sold is null").count() == 0


def test_coerce_numeric_option(spark):
    rows = [(i, "bad" if i % 4 == 0 else str(i * 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v string")
    assert dict(cleaning.clean(df, ["id"]).table.dtypes)["v"] == "string"
    done = cleaning.clean(df, ["id"], CleanConfig(coerce_numeric=True))
    assert done.report.coercions == {"v": "text to number"}
    assert dict(done.table.dtypes)["v"] == "double" and done.table.where("v is null").count() == 0


def test_legacy(spark):
    rows = [
        (1, "  ann LEE ", 1.0, "2024-01-05"), (1, "  ann LEE ", 1.0, "2024-01-05"), (2, None, None, "2024-02-06"),
        (3, "bob@x.org", 3.0, None), (4, "none", 900.0, "2024-03-07"),
    ]
    done = cleaning.clean(spark.createDataFrame(rows, "k int, who string, v double, day string"), ["k", "who"], LEGACY)
    got = {r["k"]: r for r in done.table.collect()}
    assert done.report.exact_removed == 1 and len(got) == 4
    assert got[2]["v"] == 2.0 and got[1]["who"] == "ann LEE"  # an e-mail among the first values keeps the case
    assert got[4]["who"] is None and got[3]["day"] == datetime(2024, 1, 5)


def test_empty_table_stops(spark):
    with pytest.raises(tables.EmptyTable):
        analyse(spark.createDataFrame([], "a int"))


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "book.xlsx")


def test_export_round_trip(spark, cleaned, tmp_path):
    sinks.write_csv(cleaned.table, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 120 and back.columns == cleaned.table.columns
    day = back.where("sale_id = 0").first()["sold_on"]
    assert day == "2024-01-01"
    sinks.write_parquet(cleaned.table, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).exceptAll(cleaned.table).count() == 0


def test_preview_and_summary(sales):
    head = tables.preview(sales)
    assert head.count() == 6 and "_rid" not in head.columns
    assert head.where("`Unit Price ($)` = ''").count() == 1
    summary = {r["column"]: r["nulls"] for r in tables.load_summary(sales).collect()}
    assert summary["Sale ID"] == 0 and summary["Notes"] > 90


def test_analysis_and_history(spark, sales, tmp_path):
    done = analyse(sales)
    kinds = [c.type for c in done.charts]
    assert kinds[0] == "kpi" and {"histogram", "bar", "line", "heatmap", "box", "grouped"} <= set(kinds)
    for c in done.charts:
        assert c.data.count() > 0
    path = str(tmp_path / "runs")
    for i in range(3):
        runs.append_runs(run_record(done, i, 1 + i % 2, "sales.csv", datetime(2024, 1, 1 + i)), path)
    table = runs.read_runs(spark, path)
    newest = runs.history(table, 1).collect()
    assert [r["id"] for r in newest] == [2, 0] and newest[0]["removed_rows"] == 2
    assert newest[0]["created_at"] == "03 Jan 2024, 00:00"
    assert {r["user_id"]: r["runs"] for r in runs.run_counts(table).collect()} == {1: 2, 2: 1}
    assert runs.fetch_run(table, 1, 1).count() == 0 and runs.fetch_run(table, 1, 2).count() == 1
    assert len(json.loads(newest and runs.fetch_run(table, 0, 1).first()["insights_json"])) == done.insights.count()


def test_findings(cleaned):
    found = insights.insights(cleaned.table, cleaned.report)
    by_rule = {r["rule"]: r for r in found.collect()}
    assert {"I1", "I2", "I3", "I4", "I5", "I6", "I7", "I15", "I18", "I19", "I20"} <= set(by_rule)
    assert "I8" not in by_rule and "I22" not in by_rule
    assert by_rule["I4"]["metric"] == 2 and by_rule["I4"]["severity"] == "warning"
    assert by_rule["I5"]["subject"] == "units"
    assert by_rule["I15"]["subject"] == "buyer"
    assert report.findings(found).where("rule = 'I1'").count() == 0
    assert all(r["title"] and r["detail"] for r in by_rule.values())


def test_finding_edge_cases(spark):
    rows = [(None, "a" if i else "b", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "blank string, mostly string, same double")
    found = {(r["rule"], r["subject"]): r for r in insights.insights(df).collect()}
    assert found[("I16", "mostly")]["severity"] == "warning" and found[("I16", "mostly")]["metric"] == 95.0
    assert not any(subject == "blank" for _, subject in found)
    assert ("I14", None) not in found  # a single numeric column has no pairs
    assert ("I22", None) in found and ("I8", None) in found


def test_correlation_findings(spark):
    rows = [(float(i), float(i * 2), float(-i), float((i * 7) % 11)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    r = insights.insights(df).where("rule = 'I12'").first()
    assert (r["subject"], r["severity"], r["metric"]) == ("a,b", "warning", 1.0) and "2 more" in r["detail"]
    legacy = {r["rule"]: r for r in insights.legacy_insights(df).collect()}
    assert legacy["L6"]["metric"] == 3 and "L3" in legacy and "L10" in legacy


def test_report_tables(cleaned):
    c = cleaned
    table = report.schema_table(c.table, c.report.roles, ["sale_id"]).orderBy("ord").collect()
    assert [r["field"] for r in table] == c.table.columns
    assert table[0]["unique"] == 120 and table[0]["role"] == "id" and table[1]["sample"] == "Buyer 0"
    rows = {r["metric"]: r for r in report.comparison(c).collect()}
    assert rows["rows"]["improvement"] == 2 and rows["missing"]["after"] == 0
    assert report.fill_detail(c).count() == 4 and report.rename_log(c).count() == 8
    assert report.methods(c.table).count() == 7 and report.actions(c).count() <= 8
    assert report.key_facts(c.table).first()["completeness_pct"] == 100.0
    assert "skew" not in report.legacy_stats(c.table).columns
    assert json.loads(report.report_row(c.table, c.report).first()["dropped"]) == ["notes"]


def test_chart_choice(spark, cleaned):
    listed = charts.chart_list(cleaned.table, charts.chart_datasets(cleaned.table, cleaned.report.roles))
    types = [r["type"] for r in report_types(listed)]
    assert len(types) == 8 and types == sorted(types, key=lambda t: charts.REPORT_ORDER.index(t))
    words = spark.createDataFrame([("a",), ("b",)], "w string")
    assert [c.type for c in charts.chart_datasets(words)] == ["bar"]


def report_types(listed):
    return charts.report_charts(listed).collect()


def test_frozen_report_on_a_stream(spark, sales, cleaned, tmp_path):
    raw = sales.drop("_rid")
    source = str(tmp_path / "in")
    raw.write.parquet(source)
    stream = apply_report(spark.readStream.schema(raw.schema).parquet(source), cleaned.report)
    q = stream.writeStream.format("memory").queryName("frozen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("frozen")
    assert got.columns == cleaned.table.columns and got.count() == 122
    known = got.where("sold_on is not null").select("sale_id", "zone", "units", "unit_price").distinct()
    assert known.exceptAll(cleaned.table.select("sale_id", "zone", "units", "unit_price")).count() == 0


def test_pandas_agrees_on_fills(spark):
    """Fill values against pandas on a table with missing numbers."""
    pdf = pd.DataFrame({"a": [i % 17 if i % 5 else None for i in range(200)], "b": [i**3 if i % 7 else None for i in range(200)]})
    rows = [(i, *(None if pd.isna(v) else float(v) for v in r)) for i, r in enumerate(pdf.values)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    fills = {f.column: f for f in cleaning.clean(df, ["id"]).report.fills}
    assert fills["a"].value == round(pdf["a"].mean(), 4) and fills["a"].strategy == missing.MEAN
    assert fills["b"].value == round(pdf["b"].median(), 4) and fills["b"].strategy == missing.MEDIAN


def test_role_frame(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    frame = roles.role_frame(df, roles.infer_roles(df))
    assert [tuple(r) for r in frame.orderBy("ord").collect()] == [(0, "id", "id", True), (1, "t", "text", False)]


def test_order_column_that_is_dropped_or_retyped(spark):
    """The rows' order is settled on the raw table, whatever becomes of its columns."""
    n = 60
    rows = [(str(n - i), None if i else "rare", f"k{i // 2}", float(i), f"2024-01-{i % 28 + 1:02}" if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "turn string, rare string, label string, amount double, day string")
    results = []
    for parts in (1, 7, 40):
        for order in (["rare"], ["turn"]):
            table = cleaning.clean(df.repartition(parts), order, CleanConfig(coerce_numeric=True)).table
            results.append((order[0], sorted(map(str, table.collect()))))
    assert len({(o, tuple(r)) for o, r in results}) == 2


def test_frozen_rules_of_coerced_and_legacy_reports(spark):
    df = spark.createDataFrame([(i, str(i) if i % 9 else "bad", "x") for i in range(40)], "n int, amount string, tag string")
    done = cleaning.clean(df, ["n"], CleanConfig(coerce_numeric=True))
    assert done.report.coercions
    frozen = apply_report(df, done.report)
    assert dict(frozen.dtypes) == dict(done.table.dtypes)
    assert sorted(map(str, frozen.collect())) == sorted(map(str, done.table.collect()))
    with pytest.raises(ValueError):
        apply_report(df, cleaning.clean(df, ["n"], LEGACY).report)


def test_colliding_names(spark):
    done = cleaning.clean(spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a int, b int, a_2 int").toDF("a", "A ", "a_2"), None)
    assert len(done.report.nulls_before) == 3
