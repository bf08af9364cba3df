"""Operators that serve any number of columns from one scan, and the history of runs."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.operators import correlation, distribution, frequencies, normality, roles
from scrubline.operators.columns import ROW_ID
from scrubline.operators.ordering import numbered
from scrubline.sources import runs


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_correlation_with_gaps_and_constants(spark):
    r = np.random.default_rng(4)
    data = pd.DataFrame(r.normal(1e6, 1, (400, 6)), columns=list("abcdef"))
    data["b"] = data["a"] * 2 + r.normal(0, 1, 400)
    data.loc[::3, "c"] = None
    data["d"] = np.where(data["c"].isna(), data["d"], 7.25)  # constant where c is known
    data["e"] = 5.5
    data["f"] = None
    df = spark.createDataFrame([tuple(None if x is None or np.isnan(x) else float(x) for x in row) for row in data.to_numpy(dtype=float)], ", ".join(f"{c} double" for c in data)).repartition(5)
    got = {(x.a, x.b): x.r for x in correlation.correlation_pairs(df).collect()}
    want = data.astype(float).corr()
    assert len(got) == 15
    for (a, b), r_ in got.items():
        flat = "e" in (a, b) or "f" in (a, b) or (a, b) == ("c", "d")
        assert r_ is None if flat else r_ == pytest.approx(want.loc[a, b], abs=1e-7)


def test_correlation_reads_once(spark, tmp_path):
    wide = spark.range(200).select(*[((F.col("id") * (k + 3)) % 17).alias(f"c{k}") for k in range(120)])
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    assert scans(correlation.pair_sums(df, df.columns, [0.0] * 120)) == 1
    assert correlation.correlation_pairs(df).count() == 120 * 119 // 2


def test_density_like_the_sum_of_kernels(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, 500), r.normal(40, 0.1, 300), [900.0], np.repeat(3.0, 200)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(4)
    got = np.array([d.density for d in distribution.density_curve(df, "v").orderBy("point").collect()])
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 300)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(got - want).max() < 1e-12 * want.max()


def test_first_values_of_sparse_columns(spark, tmp_path):
    rows = [(i, f"v{i}" if i % 50 == 3 else None, None, float(i) if i == 1999 else None) for i in range(2000)]
    df = numbered(spark.createDataFrame(rows, "i long, a string, b string, c double").repartition(6), ["i"])
    got = roles.first_values(df, ["a", "b", "c"], [ROW_ID], 10).collect()
    assert sorted((x.column, x.k, x.value) for x in got) == sorted([("a", k + 1, f"v{50 * k + 3}") for k in range(10)] + [("c", 1, "1999.0")])
    texts = {c: F.col(c).cast("string") for c in ("a", "b", "c")}
    assert scans(roles.ranked_by_number(df, texts, 10)) == 1


def test_history_prunes_and_repeats(spark, tmp_path):
    path = str(tmp_path / "runs")
    kinds = runs.RUN_SCHEMA
    rows = [(i, i % 40, "f", 10, 9, None, None, None, None, 1.0, 2.0, None) for i in range(200)]
    for part in (rows[:100], rows[100:], rows[:100], rows[:1], rows[:1]):
        runs.append_runs(spark.createDataFrame(part, kinds), path)
    # run 0 is in two batches, as it was appended with others and alone
    assert runs.read_runs(spark, path).count() == 201
    runs.compact_runs(spark, path, str(tmp_path / "compact"))
    assert runs.read_runs(spark, str(tmp_path / "compact")).count() == 200
    own = runs.read_runs(spark, path, owner=7)
    assert own.count() == 5 and own.columns == runs.read_runs(spark, path).columns
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner_bucket" in plan


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts_of_all_kinds(spark):
    rows = [(0.0, "a", [None], (None, 1)), (-0.0, "a", [], (1, None)), (float("nan"), "", [1], (1, None)), (float("nan"), None, None, None), (None, "A", [None], (None, 1))]
    df = spark.createDataFrame(rows, "x double, t string, l array<int>, s struct<a:int,b:int>")
    assert frequencies.distinct_counts(df, df.columns) == {"x": 2, "t": 3, "l": 3, "s": 2}
    assert frequencies.distinct_counts(df.limit(0), df.columns) == dict.fromkeys(df.columns, 0)


def test_distinct_counts_shuffle_digests_once(spark, tmp_path):
    spark.range(300).select(F.col("id"), F.repeat(F.lit("long "), 200).alias("t"), (F.col("id") % 3).alias("m")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = plan(frequencies.distinct_frame(df, df.columns))
    assert "Expand" not in found and "SortAggregate" not in found
    assert scans(frequencies.distinct_frame(df, df.columns)) == 1


def top_by_hand(values, k):
    counts = Counter(v for v in values if v is not None)
    return [(v, n, i + 1) for i, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k])]


@pytest.mark.parametrize("most", [0, 100_000])
def test_top_values_of_long_texts(spark, monkeypatch, most):
    """Ties beyond the leading bytes, zero bytes, empty and missing values; candidates broadcast and joined."""
    monkeypatch.setattr(frequencies, "BROADCAST_ROWS", most)
    alike = [f"https://www.example.com/{i:03}" for i in range(40)]
    texts = alike * 2 + ["é" * 9, "é" * 9, "", "", "a", "a\0", "a\0b", None, None, None] + ["x" * 5000 + str(i) for i in range(30)]
    df = spark.createDataFrame([(t, i % 4, None) for i, t in enumerate(texts)], "t string, m int, none string").repartition(7)
    for k in (1, 3, 7, 50):
        got = frequencies.top_values(df, df.columns, k).orderBy("column", "rank").collect()
        assert [tuple(r)[1:] for r in got if r["column"] == "t"] == top_by_hand(texts, k)
        assert [tuple(r)[1:] for r in got if r["column"] == "m"] == top_by_hand([str(i % 4) for i in range(len(texts))], k)
        assert {r["column"] for r in got} == {"t", "m"}
    assert frequencies.top_values(df.limit(0), df.columns, 3).count() == 0


def test_keyed_sample_reads_once(spark, tmp_path):
    spark.range(0, 4000, 1, 9).select("id", *[((F.col("id") * (k + 3)) % 97).cast("double").alias(f"c{k}") for k in range(6)]).withColumn(
        "c5", F.when(F.col("id") % 200 == 0, F.col("c5"))).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cols = [f"c{k}" for k in range(6)]
    sample = normality.keyed_sample(df, cols, ["id"])
    assert scans(sample) == 1
    got = {c: sorted(r["value"] for r in sample.where(F.col("column") == c).collect()) for c in cols}
    rows = sorted((int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:15], 16), r) for r in df.collect())
    assert got == {c: sorted([r[c] for _, r in rows if r[c] is not None][:50]) for c in cols}
    assert len(got["c5"]) == 20
    a = normality.shapiro_sample(df.repartition(11), cols, order_by=["id"]).collect()
    assert a == normality.shapiro_sample(df, cols, order_by=["id"]).collect()


def test_numbered_tables_are_sampled_by_number(spark):
    df = numbered(spark.range(500).select((F.col("id") % 7).cast("double").alias("x")), ["x"])
    assert ROW_ID in df.columns
    drawn = [r["value"] for r in normality.keyed_sample(df, ["x"], [ROW_ID]).collect()]
    assert len(drawn) == 50 and len(set(drawn)) == 7
    assert normality.shapiro_sample(df, ["x"]).first()["n"] == 50


def test_approximate_schema_table_keeps_estimates_apart(spark):
    from scrubline.plans import report

    df = spark.range(30_000).select(F.col("id").alias("many"), (F.col("id") % 9).alias("few"))
    t = {r["field"]: r for r in report.schema_table(df, [], ["many"], approx=True).collect()}
    assert t["few"]["unique"] == 9 and t["many"]["unique"] is None and abs(t["many"]["unique_about"] / 30_000 - 1) < 0.2
    assert "unique_about" not in report.schema_table(df, [], ["many"]).columns
