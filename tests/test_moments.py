"""Moments of groups, merged, against those of all rows."""

import math

import numpy as np
import pytest

from marketlens.operators.moments import corr_from_moments, linreg_from_moments, merge_moments, moments
from marketlens.operators.stats import corr_matrix, linreg
from marketlens.plans import py_reports
from marketlens.plans.model import Warehouse
from tests.conftest import SF001

COLS = ["a", "b", "c"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "m string, a double, b double, c double")


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_merged_groups_equal_all_rows(spark, shift):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 3)) @ np.array([[1, .5, 0], [0, 1, .3], [0, 0, 1]]) + shift
    rows = [(None if i % 11 == 0 else f"m{i % 7}", *map(float, v)) for i, v in enumerate(x)]
    rows += [("m1", None, 1.0, 2.0), ("m9", 3.0, None, None), ("m10", *map(float, x[0]))]  # NULLs, a group of one row
    df = frame(spark, rows)
    parts = moments(df, ["m"], COLS)
    assert {r.m for r in parts.collect()} == {None, "m10", *[f"m{i}" for i in range(7)]}
    total = merge_moments(parts, COLS)
    got = {(r.var1, r.var2): r.r for r in corr_from_moments(total, COLS).collect()}
    want = {(r.var1, r.var2): r.r for r in corr_matrix(df, COLS).collect()}
    assert got == pytest.approx(want, abs=1e-9 if not shift else 1e-6)
    pair = merge_moments(moments(df.drop("c"), ["m"], ["a", "b"]), ["a", "b"])
    one, other = linreg_from_moments(pair, "b", "a").first(), linreg(df, "b", "a").first()
    for c in ("n", "slope", "r", "x_min", "x_max", "stderr"):
        assert one[c] == pytest.approx(other[c], rel=1e-6)
    assert one.intercept == pytest.approx(other.intercept, rel=1e-6, abs=1e-6)


def test_constant_columns_and_no_rows(spark):
    df = frame(spark, [("x", 1.1, float(i), float(i * i)) for i in range(5)] + [("y", 1.1, 7.0, 2.0)])
    got = {(r.var1, r.var2): r.r for r in corr_from_moments(merge_moments(moments(df, ["m"], COLS), COLS), COLS).collect()}
    assert all(math.isnan(r) == ("a" in k) for k, r in got.items()) and got["b", "b"] == 1.0
    flat = linreg_from_moments(merge_moments(moments(df, ["m"], COLS), COLS), "b", "a").first()
    assert flat.n == 6 and flat.slope is None and flat.r is None and flat.stderr is None
    none = merge_moments(moments(df.limit(0), ["m"], COLS), COLS)
    assert none.first().n == 0 and {r.r for r in corr_from_moments(none, COLS).collect()} == {None}
    assert linreg_from_moments(none, "b", "a").first().slope is None


def test_reports_read_one_row_a_month(spark, tmpdir_path):
    raw = Warehouse.from_testdata(spark, SF001)
    stored = raw.materialize(tmpdir_path)
    for report in (py_reports.r20_regression, py_reports.r20_trend_line, py_reports.r23_correlation_matrix):
        df = report(stored)
        assert df.inputFiles() and all("/base_moments_" in f for f in df.inputFiles())
        assert sorted(map(str, df.collect())) == sorted(map(str, report(raw).collect()))
    months = stored.stored["moments_matrix"]
    assert months.count() == stored.report_frame.select("purchase_year_month").distinct().count()


def test_dashboard_mode_takes_no_frame_of_the_csv_population(spark, tmpdir_path):
    wh = Warehouse.from_testdata(spark, SF001).materialize(tmpdir_path)
    assert wh.report_frame is wh.csv_delivered
    wh.for_dashboard()
    assert "review_score" in wh.report_frame.columns and "product_category_name" not in wh.report_frame.columns
    assert not any("/base_moments_" in f for f in wh.month_moments("moments_matrix").inputFiles())


def test_both_passes_read_one_shuffle(spark):
    rows = spark.range(400).selectExpr("id % 3 AS g", "id % 40 AS k", "double(id) AS a", "double(id * id % 7) AS b")
    got = moments(rows.repartition(4, "k"), ["g"], ["a", "b"])
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
