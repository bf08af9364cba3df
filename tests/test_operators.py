import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrubline.config import CleanConfig
from scrubline.operators import correlation, distribution, duplicates, frequencies, missing, normality, ordering
from scrubline.operators import outliers, profile, quality, quantiles, roles, sketches, summaries

RNG = np.random.default_rng(7)
HEAVY = np.concatenate([RNG.normal(size=900), np.full(700, 3.0), RNG.exponential(size=500) * 1e9])


@pytest.fixture(scope="module")
def heavy(spark):
    return spark.createDataFrame([(float(x),) for x in HEAVY], "x double").repartition(7).cache()


@pytest.mark.parametrize("size,slack,listed", [(8000, 0.0012, 10_000), (50, 0.02, 40), (20, 0.001, 1)])
def test_exact_quantiles(heavy, monkeypatch, size, slack, listed):
    """A third of the rows share one value, the rest spans nine magnitudes, and a poor sketch may miss."""
    monkeypatch.setattr(sketches, "SIZE", size)
    monkeypatch.setattr(sketches, "SLACK", slack)
    monkeypatch.setattr(sketches, "GROUPS", 2)
    monkeypatch.setattr(quantiles, "MAX_LISTED", listed)
    probs = [0.0, 0.01, 0.25, 0.4321, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(heavy, ["x"], probs)["x"]
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(HEAVY, p), rel=1e-12)


def test_exact_quantiles_edge_cases(spark):
    df = spark.createDataFrame(
        [(None, 1.0, float(i % 2), float("nan"), i) for i in range(9)], "a double, b double, c double, d double, e int"
    )
    for counts in (None, {"a": 0, "b": 9, "c": 9, "d": 0, "e": 9}):
        got = quantiles.exact_quantiles(df, list("abcde"), [0.25, 0.5], counts)
        assert got["a"] == got["d"] == {0.25: None, 0.5: None}
        assert got["b"] == {0.25: 1.0, 0.5: 1.0}
        assert got["e"] == {0.25: 2.0, 0.5: 4.0}


def test_moments_match_pandas(heavy):
    m = profile.moments(heavy, ["x"])["x"]
    s = pd.Series(HEAVY)
    assert m.n == len(s)
    for got, want in ((m.mean, s.mean()), (m.std, s.std()), (m.skew, s.skew()), (m.std_pop, s.std(ddof=0))):
        assert got == pytest.approx(want, rel=1e-9)


def test_moments_edge_cases(spark):
    df = spark.createDataFrame([(None, 5.0, 1.0), (None, 5.0, 2.0), (None, 5.0, None)], "a double, b double, c double")
    m = profile.moments(df, ["a", "b", "c"])
    assert m["a"].n == 0 and m["a"].mean is None and m["a"].skew is None
    assert m["b"].skew == 0.0 and m["b"].std == 0.0
    assert m["c"].skew is None


def test_numeric_stats_match_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 10.0], "b": [3, 3, 4, 9], "t": list("wxyz")})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b long, t string")
    got = {r["column"]: r for r in profile.numeric_stats(df).collect()}
    assert set(got) == {"a", "b"}
    for c in "ab":
        s = pdf[c].dropna()
        assert got[c]["mean"] == round(s.mean(), 2) and got[c]["median"] == round(s.median(), 2)
        assert got[c]["skew"] == round(s.skew(), 2) and got[c]["missing"] == pdf[c].isna().sum()


def test_describe_matches_pandas(heavy):
    row = profile.describe(heavy).first()
    d = pd.Series(HEAVY).describe().round(2)
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert row[ours] == pytest.approx(d[theirs], abs=0.011)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_fill_in_order_matches_pandas(spark, parts):
    n = 400
    texts = [None if (i % 5 or i < 12 or 100 < i < 290) else f"d{i}" for i in range(n)]
    other = [None if i % 3 else i for i in range(n)]
    df = spark.createDataFrame(list(zip(range(n), texts, other)), "i int, t string, o int").repartition(parts, "t")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = missing.fill_in_order(df, ["t", "o"], ["i"]).orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want_t = pd.Series(texts).ffill().bfill().tolist()
    want_o = pd.Series(other, dtype="float").ffill().bfill().astype(int).tolist()
    assert [r["t"] for r in got] == want_t
    assert [r["o"] for r in got] == want_o


def test_fill_in_order_all_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "i int, t string")
    assert [r["t"] for r in missing.fill_in_order(df, ["t"], ["i"]).collect()] == [None, None]


def test_fill_in_order_hot_order_key(spark):
    """A third of the rows share the leading order value; the other columns break the tie."""
    rows = [(0 if i % 3 else i, i, None if i % 4 else f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = missing.fill_in_order(df, ["t"], ["k", "i"]).orderBy("k", "i").collect()
    pdf = pd.DataFrame(rows, columns=["k", "i", "t"]).sort_values(["k", "i"])
    assert [r["t"] for r in got] == pdf["t"].ffill().bfill().tolist()


def _fills(df, kinds, config=CleanConfig()):
    found = [roles.Role(c, r, k) for c, r, k in kinds]
    rows, nulls = profile.null_counts(df)
    fills = missing.decide_fills(df, found, rows, nulls, config)
    return missing.apply_fills(df, fills), {f.column: f for f in fills}


def test_numeric_fills(spark):
    rows = [(1.0, 1, None, 1.0), (2.0, 1, None, 1.0), (3.0, None, 5.0, None), (None, 50, 6.0, 1.0), (None, 2, None, 1.0)]
    df = spark.createDataFrame(rows, "even double, skewed int, few double, const double")
    kinds = [(c, "numeric", "numeric") for c in df.columns]
    out, fills = _fills(df, kinds)
    assert fills["even"].strategy == missing.MEAN and fills["even"].value == 2.0
    assert fills["skewed"].strategy == missing.MEDIAN and fills["skewed"].value == 1.5
    assert fills["few"].strategy == missing.ZERO and fills["few"].value == 0.0
    assert fills["const"].strategy == missing.MEAN
    assert out.where("skewed = 1.5").count() == 1
    assert dict(out.dtypes)["skewed"] == "double"


def test_label_fills(spark):
    rows = [("b", None), ("a", None), ("b", None), ("a", "z"), (None, None)]
    df = spark.createDataFrame(rows, "tie string, sparse string")
    out, fills = _fills(df, [("tie", "categorical", "text"), ("sparse", "text", "text")])
    assert (fills["tie"].strategy, fills["tie"].value) == (missing.MODE, "a")
    assert (fills["sparse"].strategy, fills["sparse"].value) == (missing.UNKNOWN, "Unknown")
    assert out.where("sparse = 'Unknown'").count() == 4


def test_sparse_columns():
    found = [roles.Role("a", "text", "text"), roles.Role("b", "id", "text"), roles.Role("c", "text", "text")]
    assert missing.sparse_columns(found, 10, {"a": 7, "b": 9, "c": 6}) == ["a"]


def test_duplicates_with_nulls(spark):
    rows = [(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    assert tuple(duplicates.duplicate_count(df).first()) == (6, 3)
    assert duplicates.drop_exact(df).count() == 3
    once = duplicates.drop_exact(df)
    assert duplicates.drop_exact(once).count() == once.count()


def test_hot_copies_travel_once_per_task(spark):
    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    row = duplicates.duplicate_count(df).first()
    assert (row["rows"], row["duplicates"]) == (30_000, 9_999)
    plan = duplicates.copy_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") == 1


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_key_repeats_keep_first(spark, parts):
    rows = [(i % 40 if i % 3 else 0, i, f"v{i * 7 % 13}") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int, v string").repartition(parts, "v")
    got = duplicates.drop_key_repeats(df, ["k"], ["i"]).orderBy("k").collect()
    want = pd.DataFrame(rows, columns=["k", "i", "v"]).drop_duplicates("k", keep="first").sort_values("k")
    assert [tuple(r) for r in got] == [tuple(r) for r in want.itertuples(index=False)]


def test_key_repeats_null_keys_are_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, i int")
    assert duplicates.drop_key_repeats(df, ["k"], ["i"]).count() == 2


def test_business_key_choices():
    found = [roles.Role("n", "numeric", "numeric"), roles.Role("d", "date", "date")]
    assert duplicates.business_key(found) == ["d"]
    assert duplicates.business_key(found, CleanConfig(require_both_keys=True)) == []
    assert duplicates.business_key([*found, roles.Role("id", "id", "numeric")]) == ["id", "d"]


def test_fences_match_pandas(heavy):
    fences = outliers.tukey_fences(heavy)
    s = pd.Series(HEAVY)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert fences[0].lower == pytest.approx(q1 - 1.5 * (q3 - q1))
    counted = outliers.count_outside(heavy, fences)[0]
    z = (s - s.mean()) / s.std(ddof=0)
    assert counted.outside == ((s < fences[0].lower) | (s > fences[0].upper)).sum()
    assert counted.far == (z.abs() > 3).sum()
    capped = outliers.cap(heavy, fences).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert capped[0] >= fences[0].lower and capped[1] <= fences[0].upper and capped[2] == len(s)


def test_fences_skip_unfit_columns(spark):
    rows = [(float(i % 5), float(i), 1.0, None if i else 1.0, float(i // 99)) for i in range(100)]
    df = spark.createDataFrame(rows, "few double, ok double, const double, empty double, flat double")
    assert [f.column for f in outliers.tukey_fences(df)] == ["ok"]


def test_correlation_matches_pandas(spark):
    n = 200
    a = RNG.normal(size=n)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + RNG.normal(size=n), "c": RNG.normal(size=n), "k": 1.0})
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::3, "c"] = np.nan
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.values]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double").repartition(5)
    want = pdf.corr()
    for r in correlation.correlation_pairs(df).collect():
        w = want.loc[r["a"], r["b"]]
        assert r["r"] is None if pd.isna(w) else r["r"] == pytest.approx(w, abs=1e-9)
    assert [r["ord"] for r in correlation.correlation_pairs(df).orderBy("ord").collect()] == list(range(6))


def test_correlation_of_nothing(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert correlation.correlation_pairs(df).count() == 0


def test_shapiro_wilk_known_values():
    w, p = normality.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)
    assert normality.shapiro_wilk(np.full(10, 3.0)) == (None, None)


def test_shapiro_sample_is_stable(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.expr("sin(id) + cos(id * 3)").alias("x"))
    a = normality.shapiro_sample(df.repartition(3), ["x"]).first()
    b = normality.shapiro_sample(df.repartition(11), ["x"]).first()
    assert a == b and a["n"] == 50


def test_histogram_matches_numpy(spark):
    data = np.concatenate([RNG.normal(size=800), RNG.exponential(size=400) * 3]).round(2)
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    rules = [len(np.histogram_bin_edges(data, rule)) - 1 for rule in ("fd", "sturges")]
    counts, _ = np.histogram(data, bins=max(rules))
    got = {r["bin"]: r["n"] for r in distribution.histogram(df, "x").collect()}
    assert [got.get(i, 0) for i in range(len(counts))] == counts.tolist()
    assert sum(got.values()) == len(data)


def test_density_curve_matches_direct_sum(spark):
    data = RNG.normal(size=300).round(1)
    df = spark.createDataFrame([(float(x),) for x in data], "x double")
    got = distribution.density_curve(df, "x").orderBy("point").collect()
    h = data.std(ddof=1) * len(data) ** -0.2
    grid = np.linspace(data.min(), data.max(), 300)
    want = np.exp(-0.5 * ((grid[:, None] - data[None, :]) / h) ** 2).sum(axis=1) / (len(data) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["density"] for r in got], want, rtol=1e-9, atol=1e-15)
    assert len(got) == 300


def test_density_curve_with_empty_stretches(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (1000.0,)] * 500, "x double")
    got = distribution.density_curve(df, "x")
    assert got.count() == 300 and got.where("density < 0 or density is null").count() == 0


def test_box_stats(heavy):
    row = distribution.box_stats(heavy).first()
    s = pd.Series(HEAVY)
    z = (s - s.mean()) / s.std()
    q1, q3 = z.quantile(0.25), z.quantile(0.75)
    inside = z[(z >= q1 - 1.5 * (q3 - q1)) & (z <= q3 + 1.5 * (q3 - q1))]
    assert row["whisker_low"] == pytest.approx(min(inside.min(), q1))
    assert row["whisker_high"] == pytest.approx(max(inside.max(), q3))
    assert row["fliers"] == len(z) - len(inside)


def test_box_stats_constant_column(spark):
    row = distribution.box_stats(spark.createDataFrame([(5.0,)] * 4, "x double")).first()
    assert row["median"] == 5.0 and row["fliers"] == 0


def test_top_with_other(spark):
    rows = [(f"c{i:02}",) for i in range(20) for _ in range(i + 1)] + [(None,)] * 9
    df = spark.createDataFrame(rows, "v string").repartition(4)
    got = frequencies.top_with_other(df, "v", 12)
    assert got.count() == 13
    assert got.agg(F.sum("n")).first()[0] == sum(range(1, 21))
    assert got.where("is_other").first()["n"] == sum(range(1, 9))
    assert got.agg(F.sum("share_pct")).first()[0] == pytest.approx(100)
    assert frequencies.top_with_other(df.where("v < 'c03'"), "v", 12).where("is_other").count() == 0


def test_modes_and_top_values(spark):
    rows = [("b", 1), ("a", 1), ("b", 2), ("a", None), (None, 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert frequencies.modes(df, ["t", "n"]) == {"t": "a", "n": "1"}
    assert frequencies.modes(df, []) == {}
    assert frequencies.modes(df.where("t is null"), ["t"]) == {}
    top = frequencies.top_values(df, ["t"], 1).first()
    assert (top["value"], top["n"], top["rank"]) == ("a", 2, 1)


def test_distinct_counts(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("few"), F.col("id").alias("many"), F.lit(None).cast("int").alias("none"))
    assert frequencies.distinct_counts(df, df.columns) == {"few": 7, "many": 5000, "none": 0}
    near = frequencies.distinct_counts(df, df.columns, 50)
    assert near["few"] == 7 and near["none"] == 0 and near["many"] > 200


def test_first_rows(spark):
    df = spark.range(0, 5000, 1, 9).select((4999 - F.col("id")).alias("i"), F.col("id").alias("v")).repartition(5)
    assert [r["i"] for r in ordering.first_rows(df, ["i"], 30).collect()] == list(range(30))
    named = df.withColumn("s", F.lpad(F.col("i").cast("string"), 5, "0"))
    assert [r["i"] for r in ordering.first_rows(named, ["s", "i"], 30).collect()] == list(range(30))
    hot = df.withColumn("k", F.when(F.col("i") % 3 == 0, 0).otherwise(F.col("i")))
    assert [r["i"] for r in ordering.first_rows(hot, ["k", "i"], 30).collect()] == list(range(0, 90, 3))


def test_roles(spark):
    n = 60
    rows = [
        (i, f"u{i}@x.org", f"${i}.50", f"{i}%", float(i), i * 1.25 + 0.01, f"2024-01-{i % 28 + 1:02}", "xyz"[i % 3],
         f"note {i}", f"+1 {i}", i % 2 == 0, [i], None)
        for i in range(n)
    ]
    schema = (
        "order_id int, contact string, cost string, rate string, weight double, amount double, day string, kind string, "
        "remark string, hotel string, flag boolean, list array<int>, blank string"
    )
    found = {r.column: r.role for r in roles.infer_roles(spark.createDataFrame(rows, schema), ["order_id"])}
    assert found == {
        "order_id": "id", "contact": "email", "cost": "currency", "rate": "pct", "weight": "numeric", "amount": "currency",
        "day": "date", "kind": "categorical", "remark": "text", "hotel": "phone", "flag": "categorical", "list": "other",
        "blank": "categorical",
    }


def test_first_rows_are_cut_in_the_tasks(spark):
    df = spark.range(0, 5000, 1, 9).withColumnRenamed("id", "i")
    plan = ordering.first_rows(df, ["i"], ordering.LIMITED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert ordering.first_rows(df, ["i"], 2000).count() == 2000


def test_many_first_values(spark):
    df = spark.range(0, 5000, 1, 9).select("id", F.concat(F.lit("v"), F.col("id")).alias("v"))
    assert roles.first_values(df, ["v"], ["id"], 2000).count() == 2000


def test_numbered_rows_keep_their_order(spark):
    df = spark.range(0, 900, 1, 7).select((F.col("id") % 3).alias("same"), (899 - F.col("id")).alias("i"))
    rows = ordering.numbered(df, ["i"]).orderBy("_rid").collect()
    assert [r["i"] for r in rows] == list(range(900))
    hot = ordering.numbered(df.select(F.lit(1).alias("one")))
    assert hot.select("_rid").distinct().count() == 900 and hot.select(F.shiftright("_rid", ordering.RANGE_BITS)).distinct().count() > 1


def test_fill_of_a_numbered_table_shuffles_it_once(spark):
    df = ordering.numbered(spark.range(100).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("t")), ["id"])
    plan = missing.fill_in_order(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Exchange hashpartitioning(_range") <= 2


def test_duplicates_of_a_numbered_table_are_hash_aggregated(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None), (None, "2")]
    df = ordering.numbered(spark.createDataFrame(rows, "k int, v string"), ["k"])
    once = duplicates.first_of_each(df)
    keyed = duplicates.first_of_each(df, ["k"])
    assert once.count() == 4 and sorted(tuple(r) for r in keyed.select("k", "v", "_repeats").collect() if r["k"]) == [(1, "a", 2), (2, None, 1)]
    for found in (once, keyed):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_first_values_beyond_the_prefix(spark):
    rows = [(i, f"a{i}", f"s{i}" if i % 40 == 39 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, dense string, sparse string").repartition(6)
    got = roles.first_values(df, ["dense", "sparse"], ["i"], 20)
    by = {c: [r["value"] for r in got.where(F.col("column") == c).orderBy("k").collect()] for c in ("dense", "sparse")}
    assert by["dense"] == [f"a{i}" for i in range(20)]
    assert by["sparse"] == [f"s{i}" for i in range(39, 1000, 40)][:20]


def test_monthly_trend(spark):
    days = pd.date_range("2024-01-15", periods=200, freq="D")
    values = RNG.normal(size=200).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"d": days, "v": values}))
    got = summaries.monthly_trend(df, "d", "v").orderBy("month").collect()
    monthly = pd.Series(values, index=days).resample("ME").mean()
    slope, intercept = np.polyfit(np.arange(len(monthly)), monthly.values, 1)
    assert [r["mean"] for r in got] == pytest.approx(monthly.tolist())
    assert [r["rolling"] for r in got] == pytest.approx(monthly.rolling(3, min_periods=1).mean().tolist())
    assert got[0]["slope"] == pytest.approx(slope) and got[0]["intercept"] == pytest.approx(intercept)


def test_category_summary(spark):
    rows = [(f"c{i % 10}", float(i)) for i in range(95)] + [(None, 5.0)]
    got = summaries.category_summary(spark.createDataFrame(rows, "c string, v double"), "c", "v").collect()
    assert len(got) == 8 and got[0]["sum"] >= got[-1]["sum"]
    assert sum(r["share_pct"] for r in got) == pytest.approx(100)


def test_quality_score_bounds(spark):
    df = spark.createDataFrame([(None, None)] * 5, "a double, t string")
    assert quality.quality_score(df).first()["score"] == 14.0
    assert quality.score(10, 2, 0, 0, 1.0) == 100.0
    assert quality.consistency([]) == 0.8 and quality.consistency([None, 0.0]) == 0.5


def test_copies_are_drawn_apart(spark):
    """Five values with equal shares: never one of them alone, and never normal."""
    df = spark.range(10_000).select((F.col("id") % 5).cast("double").alias("x"))
    drawn = [r["value"] for r in normality.hashed_sample(df, "x").collect()]
    assert len(drawn) == 50 and len(set(drawn)) == 5
    assert normality.shapiro_sample(df).first()["p"] < 0.05
    constant = spark.range(100).select(F.lit(4.0).alias("x"))
    assert normality.shapiro_sample(constant).first()["p"] is None


def test_large_whole_numbers_keep_their_digits(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big + 2 * i,) for i in range(19)] + [(None,)], "n bigint")
    for value in (3.0, 2.5):
        out = missing.apply_fills(df, [missing.Fill("n", missing.MEAN, value, 1, 0.05)])
        assert out.distinct().count() == 20
