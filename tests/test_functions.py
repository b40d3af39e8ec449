from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketlens.functions.buckets import bucketize, case_labels
from marketlens.functions.dates import day_diff, days_late, iso_weekday, mysql_week, weekday_mon0, weekday_sun1, year_week
from marketlens.functions.numeric import qround, rnd


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()[0]


def test_day_diff_calendar_vs_elapsed(spark):
    # 47 hours across two midnights
    row = (datetime(2017, 1, 1, 12), datetime(2017, 1, 3, 11))
    s = "a timestamp_ntz, b timestamp_ntz"
    assert _one(spark, day_diff("b", "a", "calendar"), s, row) == 2
    assert _one(spark, day_diff("b", "a", "elapsed"), s, row) == 1


def test_fractional_day_diff(spark):
    row = (datetime(2017, 1, 1, 12), datetime(2017, 1, 3, 0))
    assert _one(spark, day_diff("b", "a", "fractional"), "a timestamp_ntz, b timestamp_ntz", row) == 1.5


def test_elapsed_floor_of_negative(spark):
    row = (datetime(2017, 1, 1, 12), datetime(2017, 1, 1, 11))
    assert _one(spark, day_diff("b", "a", "elapsed"), "a timestamp_ntz, b timestamp_ntz", row) == -1


def test_days_late_null_and_floor(spark):
    s = "a timestamp_ntz, b timestamp_ntz"
    assert _one(spark, days_late("b", "a"), s, (datetime(2017, 1, 10), None)) is None  # N2
    assert _one(spark, days_late("b", "a"), s, (datetime(2017, 1, 10), datetime(2017, 1, 5))) == 0
    assert _one(spark, days_late("b", "a"), s, (datetime(2017, 1, 10), datetime(2017, 1, 15))) == 5


def test_weekday_numberings(spark):
    # 2017-01-01 is a Sunday
    s = "d date"
    row = (date(2017, 1, 1),)
    assert _one(spark, weekday_sun1("d"), s, row) == 1
    assert _one(spark, weekday_mon0("d"), s, row) == 6
    assert _one(spark, iso_weekday("d"), s, row) == 7


def _mysql_week_mode1(d: date) -> int:
    """Day-by-day reading of MySQL WEEK(d, 1): Monday start, week 1 is the first
    week with 4+ days in the year, days before it are week 0."""
    jan1 = date(d.year, 1, 1)
    wd = jan1.weekday()
    start = jan1 - timedelta(days=wd) if wd <= 3 else jan1 + timedelta(days=7 - wd)
    return 0 if d < start else (d - start).days // 7 + 1


def test_mysql_week_matches_rule(spark):
    days = [date(2014, 12, 25) + timedelta(days=i) for i in range(0, 365 * 6, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", mysql_week("d").alias("w"))
    got = {r.d: r.w for r in df.collect()}
    assert all(got[d] == _mysql_week_mode1(d) for d in days)


def test_year_week_label(spark):
    assert _one(spark, year_week("d"), "d date", (date(2017, 1, 1),)) == "2017-W00"
    assert _one(spark, year_week("d"), "d date", (date(2018, 12, 31),)) == "2018-W53"


def test_qround_exact_ties(spark):
    df = spark.createDataFrame([("9888426.09", 6), ("-0.25", 2), ("1", 8), ("1", 0)], "v string, n int") \
        .withColumn("v", F.col("v").cast("decimal(12,2)"))
    got = [r[0] for r in df.select(qround("v", "n", 2, num_scale=2)).collect()]
    assert got == [1648071.02, -0.13, 0.13, None]


def test_rnd_half_up_on_doubles(spark):
    df = spark.createDataFrame([(1.005,), (14.45,), (2.5,)], "x double")
    assert [r[0] for r in df.select(rnd("x", 2)).collect()][0] == 1.01
    assert [r[0] for r in df.select(rnd("x", 1)).collect()][1] == 14.5
    assert [r[0] for r in df.select(rnd("x", 0)).collect()][2] == 3.0


@pytest.mark.parametrize("x,label", [(0, None), (5, "a"), (6, "b"), (200, "c"), (201, None), (None, None)])
def test_bucketize_pd_cut_edges(spark, x, label):
    # Pd.cut right-closed, 0 and > 200 fall outside
    expr = bucketize("x", [0, 5, 10, 200], ["a", "b", "c"])
    assert _one(spark, expr, "x int", (x,)) == label


def test_case_labels_null_to_else(spark):
    expr = case_labels("x", [5, 10], ["lo", "mid"], "else")
    assert _one(spark, expr, "x int", (None,)) == "else"
    assert _one(spark, expr, "x int", (7,)) == "mid"
