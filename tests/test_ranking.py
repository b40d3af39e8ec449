import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.ranking import global_ntile, global_row_number, pareto, rank_qcut, value_qcut


def _data(spark, n, seed=7, distinct=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, distinct)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v int"), rows


@pytest.mark.parametrize("n", [1, 6, 37, 500])
def test_global_row_number_equals_window(spark, n):
    df, _ = _data(spark, n)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r.id: r.rn for r in global_row_number(df, order, "rn", num_partitions=4).collect()}
    ref = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn")).collect()}
    assert got == ref


@pytest.mark.parametrize("n,k", [(6, 4), (7, 4), (13, 7), (3, 4), (400, 4)])
def test_global_ntile_equals_window(spark, n, k):
    df, _ = _data(spark, n)
    order = [F.col("v").asc(), F.col("id").asc()]
    got = {r.id: r.t for r in global_ntile(df, order, k, "t", num_partitions=3).collect()}
    ref = {r.id: r.t for r in df.select("id", F.ntile(k).over(Window.orderBy(*order)).alias("t")).collect()}
    assert got == ref
    sizes = pd.Series(list(got.values())).value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_ntile_vs_rank_qcut_sizes(spark):
    # n = 6 splits 2,2,1,1 with NTILE and 2,1,1,2 with rank-qcut
    df = spark.createDataFrame([(i, 1) for i in range(6)], "id long, v int")
    order = [F.col("v").asc(), F.col("id").asc()]
    nt = pd.Series([r.t for r in global_ntile(df, order, 4, "t").collect()]).value_counts().sort_index()
    qc = pd.Series([r.t for r in rank_qcut(df, order, 4, "t").collect()]).value_counts().sort_index()
    assert list(nt) == [2, 2, 1, 1]
    assert list(qc) == [2, 1, 1, 2]


@pytest.mark.parametrize("n", [4, 9, 50, 333])
def test_rank_qcut_matches_pandas(spark, n):
    df, rows = _data(spark, n, distinct=3)
    pdf = pd.DataFrame(rows, columns=["id", "v"]).sort_values("id")
    expect = pd.qcut(pdf["v"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    ref = dict(zip(pdf["id"], expect))
    got = {r.id: r.t for r in rank_qcut(df, [F.col("v").asc(), F.col("id").asc()], 4, "t").collect()}
    assert got == ref


def test_value_qcut_matches_pandas(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.uniform(0, 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v double")
    pdf = pd.DataFrame(rows, columns=["id", "v"])
    ref = dict(zip(pdf["id"], pd.qcut(pdf["v"], 4, labels=[4, 3, 2, 1]).astype(int)))
    got = {r.id: r.s for r in value_qcut(df, "v", 4, "s", labels=[4, 3, 2, 1]).collect()}
    assert got == ref


def test_pareto_range_vs_rows_ties(spark):
    # Equal revenues share one running total with RANGE, not with ROWS
    df = spark.createDataFrame([("a", 50), ("b", 25), ("c", 25)], "k string, v long")
    rng = {r.k: r.cum_share for r in pareto(df, "k", "v", frame="range").collect()}
    rows = {r.k: r.cum_share for r in pareto(df, "k", "v", frame="rows").collect()}
    assert rng == {"a": 50.0, "b": 100.0, "c": 100.0}
    assert rows == {"a": 50.0, "b": 75.0, "c": 100.0}


@pytest.mark.parametrize("n,p", [(1, 0.5), (2, 0.5), (101, 0.95), (400, 0.5), (37, 0.25)])
def test_exact_percentile_matches_numpy(spark, n, p):
    import numpy as np

    from marketlens.operators.ranking import exact_percentile
    rnd = random.Random(n)
    vals = [round(rnd.uniform(0, 1000), 2) for _ in range(n)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.limit(1).select(exact_percentile(df, "x", p).alias("q")).first().q
    assert got == pytest.approx(float(np.percentile([v for v in vals if v is not None], p * 100)), rel=1e-12)


def test_stable_input_chain_equals_window(spark):
    # a checkpointed input, then chained rankings without their own checkpoints
    df, _ = _data(spark, 300, distinct=4)
    df = df.withColumn("w", (F.col("id") * 7) % 5).checkpoint(eager=True)
    s = global_ntile(df, [F.col("v").asc(), F.col("id").asc()], 4, "t1", num_partitions=5, stable_input=True)
    s = global_ntile(s, [F.col("w").desc(), F.col("id").asc()], 4, "t2", num_partitions=5, stable_input=True)
    got = {r.id: (r.t1, r.t2) for r in s.collect()}
    ref = df.select("id", F.ntile(4).over(Window.orderBy("v", "id")).alias("t1"),
                    F.ntile(4).over(Window.orderBy(F.col("w").desc(), "id")).alias("t2"))
    assert got == {r.id: (r.t1, r.t2) for r in ref.collect()}
