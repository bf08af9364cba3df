import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scrubline.functions import dates as D
from scrubline.functions import names
from scrubline.functions import numbers as N
from scrubline.functions import text as X

TEXTS = [
    "  Foo   bar ", "t-SHIRT", "don't STOP", "a​b", "a b", "x\ry", "", "N/A", "Unknown", "--", "#N/A",
    "not available", None, "  ", "ÉCOLE d'été", "3rd floor", " nan ",
]


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_fake_nulls(spark):
    got = apply(spark, TEXTS, X.null_fakes)
    gone = {"", "N/A", "Unknown", "--", "#N/A", "not available", "  ", " nan ", None}
    assert got == [None if t in gone else t for t in TEXTS]


def test_normalise_text(spark):
    got = apply(spark, TEXTS, X.normalise_text)
    assert got[0] == "Foo bar"
    assert got[3] == "ab" and got[4] == "a b" and got[5] == "xy"
    assert got[6] is None and got[13] is None
    again = apply(spark, got, X.normalise_text)
    assert again == got


def test_title_case_matches_python(spark):
    words = [t for t in TEXTS if t] + ["hello wORLD", "o'neil-smith", "x2y zz", "中a b"]
    assert apply(spark, words, X.title_case) == [w.title() for w in words]


def test_humanise_and_truncate(spark):
    assert apply(spark, ["unit_price", "id"], X.humanise) == ["Unit Price", "Id"]
    assert apply(spark, ["abcdef", "abc"], lambda c: X.truncate(c, 4)) == ["abc…", "abc"]


def test_numbers_from_text(spark):
    texts = ["$1,234.50", "€ 7", "12 000", "abc", "1d", "2f", "nan", "inf", "1e3", "-5", "+.5", "", None, "1e", "."]
    got = apply(spark, texts, N.parse_currency)
    assert got == [1234.5, 7.0, 12000.0, None, None, None, None, None, 1000.0, -5.0, 0.5, None, None, None, None]
    assert apply(spark, ["25%", " 7.5 %%", "50", "x%", None], N.parse_percent) == [0.25, 0.075, 0.5, None, None]


def test_clip_keeps_null(spark):
    assert apply(spark, [1.0, None, 99.0, -9.0], lambda c: N.clip(c, 0, 10), "double") == [1.0, None, 10.0, 0.0]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_round_even_matches_numpy(spark, digits):
    import numpy as np

    values = [2.5, 3.5, 0.125, -67.32125, 1e9 + 0.05, -0.00001, None]
    got = apply(spark, values, lambda c: N.round_even(c, digits), "double")
    assert got == [None if v is None else float(np.round(v, digits)) for v in values]


def test_labels(spark):
    values = [1_500_000.0, 2500.0, 12.345, -3_000_000.0, 0.5]
    assert apply(spark, values, N.compact, "double") == ["1.5M", "2.5K", f"{12.345:,.2f}", "-3.0M", "0.50"]
    assert apply(spark, values, N.compact_axis, "double") == ["1.5M", "2.5K", "12.3", "-3.0M", "0.500"]
    got = apply(spark, [None, float("nan"), 1234.0, 5.0, 5.25, 5.5, 0.0], N.compact_dashboard, "double")
    assert got == ["—", "—", "1.2K", "5", "5.25", "5.5", "0"]
    assert apply(spark, [80.0, 60.0, 59.9], N.quality_band, "double") == ["green", "amber", "red"]
    assert apply(spark, [-1.0, 50.0, 101.0], N.clamp_pct, "double") == [0.0, 50.0, 100.0]


def test_as_written(spark):
    values = [901.12, 33.0, 12345678.91, 1e7, 0.5]
    assert apply(spark, values, lambda c: N.as_written(c, "double"), "double") == [repr(v) for v in values]


def test_variation(spark):
    df = spark.createDataFrame([(2.0, 4.0), (1.0, 0.0), (None, 1.0)], "s double, m double")
    assert [r[0] for r in df.select(N.variation_pct(F.col("s"), F.col("m"))).collect()] == [50.0, 0.0, None]


def test_parse_date(spark):
    texts = ["2024-02-30", "2024-2-3", "05-01-2024", "x", None, " 2024-12-31 "]
    iso = apply(spark, texts, lambda c: D.parse_date(c, "yyyy-M-d"))
    assert iso == [None, datetime(2024, 2, 3), None, None, None, datetime(2024, 12, 31)]
    assert apply(spark, ["13-01-2024", "12-31-2024"], lambda c: D.parse_date(c, "M-d-yyyy"))[0] is None


def test_parse_mixed_dates(spark):
    texts = ["2024-01-05", "05/01/2024", "3 Feb 2024", "February 3, 2024", "20240131", "3-Mar-2024", "soon", "2024/7/9"]
    got = apply(spark, texts, D.parse_mixed_date)
    assert got == [
        datetime(2024, 1, 5), datetime(2024, 1, 5), datetime(2024, 2, 3), datetime(2024, 2, 3), datetime(2024, 1, 31),
        datetime(2024, 3, 3), None, datetime(2024, 7, 9),
    ]


def test_looks_like_date(spark):
    texts = ["2024-02-30", "on 01/02/2024", "12 Jan 2024", "hello", "123456", "202400", "1-URGENT", "2024"]
    assert apply(spark, texts, D.looks_like_date) == [True, True, True, False, True, False, False, False]


def test_feature_base():
    assert [D.feature_base(n) for n in ("order_date", "date_of_birth", "ship_dates", "o_orderdate_txt")] == [
        "order", "of_birth", "ships", "o_ordertxt",
    ]


def test_span_days(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 12:00:00' a, timestamp_ntz'2024-01-03 11:00:00' b")
    assert df.select(D.span_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_names():
    raw = [" Order ID ", "Unit Price ($)", "Café–Name", "a  b", "A_B", "***", "Col"]
    assert names.plan_names(raw) == ["order_id", "unit_price", "cafename", "a_b", "a_b_2", "col", "col_2"]
    assert names.plan_names(names.plan_names(raw)) == names.plan_names(raw)


def test_variation_is_not_nan(spark):
    got = apply(spark, [1.0, 1.0], lambda c: N.z_score(c, 1.0, 0.0), "double")
    assert got == [None, None] and not any(isinstance(g, float) and math.isnan(g) for g in got)
