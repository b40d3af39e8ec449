import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlens.operators.stats import (
    box_stats, cohort_profile, corr_matrix, histogram, linreg, repeatable_sample, t_two_sided_p, with_p_value,
)


def _p(spark, t, dof):
    return spark.range(1).select(t_two_sided_p(F.lit(float(t)), F.lit(float(dof))).alias("p")).first().p


@pytest.mark.parametrize("t, dof, p", [
    (2.228139, 10, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (12.706205, 1, 0.05), (4.302653, 2, 0.05), (1.959964, 1e7, 0.05),
    (0.5, 1e12, 0.617075), (-2.0, 10, 0.073388), (5.0, 100, 2.4502e-6)])
def test_t_p_values_known(spark, t, dof, p):
    assert _p(spark, t, dof) == pytest.approx(p, rel=2e-4)


def _xy(spark, n=300, slope=-0.05, seed=1):
    rnd = random.Random(seed)
    rows = [(float(x), 4.5 + slope * x + rnd.gauss(0, 0.5)) for x in (rnd.randint(0, 60) for _ in range(n))]
    return spark.createDataFrame(rows, "x double, y double"), np.array(rows)


def test_linreg_matches_numpy(spark):
    df, a = _xy(spark)
    m = linreg(df, "y", "x").first()
    slope, icpt = np.polyfit(a[:, 0], a[:, 1], 1)
    r = np.corrcoef(a[:, 0], a[:, 1])[0, 1]
    n = len(a)
    se = math.sqrt((1 - r * r) * np.var(a[:, 1], ddof=1) / np.var(a[:, 0], ddof=1) / (n - 2))
    assert m.n == n
    assert m.slope == pytest.approx(slope, rel=1e-9)
    assert m.intercept == pytest.approx(icpt, rel=1e-9)
    assert m.r == pytest.approx(r, rel=1e-9)
    assert m.stderr == pytest.approx(se, rel=1e-9)


def test_p_value_of_a_model(spark):
    df, a = _xy(spark)
    p = with_p_value(linreg(df, "y", "x")).first().p_value
    r = np.corrcoef(a[:, 0], a[:, 1])[0, 1]
    dof = len(a) - 2
    assert p == pytest.approx(_p(spark, r * math.sqrt(dof / (1 - r * r)), dof), rel=1e-6)
    assert p < 1e-6  # the fixture has a real slope
    two = with_p_value(linreg(df.limit(2), "y", "x")).first().p_value
    assert math.isnan(two)
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "x double, y double")
    assert with_p_value(linreg(line, "y", "x")).first().p_value == pytest.approx(0.0, abs=1e-12)


def test_corr_matrix_of_a_constant_column(spark):
    rows = [(1.0, float(i), float(i * i)) for i in range(9)]
    ref = pd.DataFrame(rows, columns=["a", "b", "c"]).corr()
    for r in corr_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(ref.loc[r.var1, r.var2], rel=1e-9, nan_ok=True)


def test_corr_matrix_matches_pandas(spark):
    rnd = random.Random(5)
    rows = [(rnd.random(), rnd.random(), None if i % 11 == 0 else rnd.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    ref = pd.DataFrame(rows, columns=["a", "b", "c"]).dropna().corr()
    got = {(r.var1, r.var2): r.r for r in corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    for (v1, v2), r in got.items():
        assert r == pytest.approx(ref.loc[v1, v2], rel=1e-9)


def test_box_stats_quartiles(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    b = box_stats(df, None, "x").first()
    assert (b.q1, b.median, b.q3) == tuple(np.percentile(vals, [25, 50, 75]))
    assert b.sd == pytest.approx(np.std(vals, ddof=1))


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 1.5, 59.9, 60, 61]], "x double")
    got = {r.bin: r.n for r in histogram(df, "x", 1.5, 0.0, 60.0).collect()}
    assert got == {0: 2, 1: 1, 39: 2}


def test_repeatable_sample_is_stable_and_sized(spark):
    df = spark.range(1000).withColumn("k2", F.col("id") % 7)
    a = [r.id for r in repeatable_sample(df, ["id", "k2"], 50).collect()]
    b = [r.id for r in repeatable_sample(df.repartition(5), ["id", "k2"], 50).collect()]
    assert len(a) == 50 and sorted(a) == sorted(b)
    assert len(repeatable_sample(df, ["id"], 5000).collect()) == 1000


def test_cohort_profile_keeps_empty_cohort(spark):
    df = spark.createDataFrame([(1,), (5,), (5,)], "s int")
    out = cohort_profile(df, {"neg": F.col("s") <= 2, "pos": F.col("s") == 5, "none": F.col("s") > 9},
                         {"n": F.count(F.lit(1))}).collect()
    assert [(r.group_type, r.n) for r in out] == [("neg", 1), ("pos", 2), ("none", None)]


def test_sample_spreads_over_a_large_range(spark):
    n = 5_000_000
    ids = sorted(r.id for r in repeatable_sample(spark.range(n), ["id"], 200).collect())
    assert len(ids) == 200
    quarters = np.bincount(np.array(ids) * 4 // n, minlength=4)
    assert quarters.min() > 25  # 50 expected in each
    assert len(set(np.diff(ids).tolist())) > 150  # no fixed step


def test_sample_of_text_and_null_keys(spark):
    df = spark.createDataFrame([(f"o{i}" if i else None, i % 3) for i in range(100)], "k string, j int")
    assert len(repeatable_sample(df, ["k", "j"], 10).collect()) == 10
    assert repeatable_sample(df, ["k", "j"], 10, seed=1).collect() != repeatable_sample(df, ["k", "j"], 10, seed=2).collect()
