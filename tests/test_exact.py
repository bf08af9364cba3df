"""Decimals keep every digit in quantiles, fills and fences."""

import json
import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from scrubline.operators import exact, outliers
from scrubline.operators.missing import apply_fills, decide_fills
from scrubline.operators.roles import Role
from scrubline.plans.cleaning import clean

getcontext().prec = 80


def decimals(spark, values, kind):
    return spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(values)], "i long, t string").select("i", F.col("t").cast(kind).alias("x"))


@pytest.mark.parametrize("kind, base", [("decimal(22,2)", 9 * 10**16), ("decimal(38,2)", 7 * 10**35), ("decimal(38,0)", -(10**37)), ("decimal(10,2)", 5)])
def test_order_statistics_to_the_last_digit(spark, kind, base):
    r = random.Random(3)
    cents = "" if kind.endswith(",0)") else "." + "{:02d}"
    values = [f"{base + r.choice([0, 1, r.randrange(10**4), r.randrange(10**7)])}{cents.format(r.randrange(100))}" for _ in range(700)]
    values += [values[0]] * 300 + [None] * 5
    known = sorted(Decimal(v) for v in values if v is not None)
    df = decimals(spark, values, kind)
    ranks = [0, 1, 250, 499, 500, 731, 998, 999]
    assert exact.nth_values(df, {"x": ranks}, {"x": 1000})["x"] == {k: known[k] for k in ranks}
    q = exact.exact_decimal_quantiles(df, ["x"], [0.0, 0.25, 1.0], {"x": 1000})["x"]
    assert q == {0.0: known[0], 0.25: known[249] + (known[250] - known[249]) * Decimal("0.75"), 1.0: known[-1]}


def test_column_without_values(spark):
    assert exact.exact_decimal_quantiles(decimals(spark, [None, None], "decimal(22,2)"), ["x"], [0.5], {"x": 0}) == {"x": {0.5: None}}


def test_mean_fill(spark):
    values = [f"{10**17 + k}.25" for k in range(40)] + [None]
    df = decimals(spark, values, "decimal(22,2)")
    fills = decide_fills(df, [Role("x", "numeric", "numeric")], 41, {"x": 1})
    assert fills[0].value == Decimal(10**17) + Decimal("19.75")
    out = apply_fills(df, fills)
    assert dict(out.dtypes)["x"] == "decimal(24,4)"
    assert {r.x for r in out.collect()} == {Decimal(v) for v in values if v} | {fills[0].value}


def test_cap_keeps_type_and_digits(spark):
    values = [f"{9 * 10**16 + k}.07" for k in range(60)] + ["99999999999999999999.99", "-5.00"]
    df = decimals(spark, values, "decimal(22,2)")
    fences = outliers.count_outside(df, outliers.tukey_fences(df, ["x"]))
    out = outliers.cap(df, fences)
    assert fences[0].outside == 2 and dict(out.dtypes)["x"] == "decimal(22,2)"
    assert {r.x for r in out.collect()} >= {Decimal(v) for v in values[:60]}
    assert out.agg(F.count_distinct("x")).first()[0] == 62


def test_long_whole_numbers(spark):
    df = spark.createDataFrame([(2**60 + k,) for k in range(60)] + [(5,)], "n long")
    out = outliers.cap(df, outliers.count_outside(df, outliers.tukey_fences(df, ["n"])))
    got = sorted(r.n for r in out.collect())
    assert got[1:] == [Decimal(2**60 + k) for k in range(60)] and dict(out.dtypes)["n"] == "decimal(24,4)"


def test_bounds_beyond_the_type(spark):
    values = [str(10**37 * k) for k in range(-9, 10)] * 3 + ["1"]
    df = decimals(spark, values, "decimal(38,0)")
    fences = outliers.count_outside(df, outliers.tukey_fences(df, ["x"]))
    assert outliers.cap(df, fences).count() == len(values)


def test_report_of_decimals_is_json(spark):
    values = [f"{10**17 + k}.25" for k in range(60)] + ["5.00", None]
    report = clean(decimals(spark, values, "decimal(22,2)").withColumnRenamed("x", "amount"), ["i"]).report
    told = json.loads(json.dumps(report.as_dict()))
    assert Decimal(told["fills"][0]["value"]) == report.fills[0].value
    assert Decimal(told["fences"][0]["lower"]) == report.fences[0].lower


def test_amounts_stay_apart(spark):
    """Forty amounts beyond the whole numbers of a double are forty amounts after cleaning."""
    values = [f"{9007199254740993 + k}.{k:02d}" for k in range(40)]
    out = clean(decimals(spark, values, "decimal(22,2)").withColumnRenamed("x", "amount"), ["i"]).table
    assert dict(out.dtypes)["amount"] == "decimal(22,2)"
    assert {str(r.amount) for r in out.collect()} == set(values)
