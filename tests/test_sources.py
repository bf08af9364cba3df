import pytest

from scrubline.plans.cleaning import clean
from scrubline.sources import runs
from scrubline.sources.tables import RaggedRows, read_table
from scrubline.staging import new_path


def csv(tmp_path, *lines):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_long_whole_numbers(spark, tmp_path):
    rows = [f"{1234567890123456700 + i},{9999999999999999999900 + i},{i}.5,{2**53 + 1}" for i in range(100)]
    df = read_table(spark, csv(tmp_path, "long_no,longer_no,part,mixed", *rows, "1,2,3,0.5"), row_id=True)
    kinds = dict(df.dtypes)
    assert (kinds["long_no"], kinds["longer_no"], kinds["part"], kinds["mixed"]) == ("bigint", "string", "double", "string")
    assert df.select("long_no").distinct().count() == 101 and df.select("longer_no").distinct().count() == 101
    assert clean(df).table.count() == 101


def test_surplus_cells_stop_the_read(spark, tmp_path):
    with pytest.raises(RaggedRows, match="1 line"):
        read_table(spark, csv(tmp_path, "a,b", "1,2", "3,4,5,6", '"x,y",2', "7,8,", "9"))


def test_missing_cells_are_null(spark, tmp_path):
    df = read_table(spark, csv(tmp_path, "a,b", "1,x", "2", '"3","y, z"', '4,"line"'))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x"), (2, None), (3, "y, z"), (4, "line")]


def test_history_counts_beyond_32_bits(spark):
    path = new_path(spark, "runs")
    row = (1, 2, "f", 3_000_000_000, 2_999_999_999, "", "", "", "", 1.0, 2.0, None)
    runs.append_runs(spark.createDataFrame([row], runs.RUN_SCHEMA), path)
    assert runs.history(runs.read_runs(spark, path)).first()["removed_rows"] == 1
