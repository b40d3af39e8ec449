"""Cuts and percentiles by counting against windows, pandas and numpy."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators import selection
from marketlens.operators.ranking import exact_percentile
from marketlens.operators.rfm import rfm_score
from marketlens.operators.selection import Order, Selection, rank_bin_ends, tile_ends, tiles, written


def rows(n, seed, key=str):
    rnd = random.Random(seed)
    ids = [key(i) for i in rnd.sample(range(10 * n + 10), n)]
    return [(i, rnd.choice([0, 0, 0, 1, 2, rnd.randint(-10**6, 10**6)]), rnd.choice([1, 1, 1, 1, 2]),
             rnd.choice([None, Decimal("1.00"), Decimal(rnd.randint(0, 10**9)) / 100])) for i in ids]


@pytest.mark.parametrize("n,few,bins", [(1, 1000, 4096), (3, 1000, 4096), (37, 2, 4), (400, 5, 8), (2000, 20, 64)])
def test_tiles_equal_windows(spark, monkeypatch, n, few, bins):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", bins)
    df = written(spark.createDataFrame(rows(n, n, lambda i: f"cust-é-{i:x}"), "id string, a long, b int, c decimal(22,2)"), "t")
    ends = tile_ends(n, 4)
    got = tiles(df, {"x": (Order("a", "id", desc=True, nulls_first=False), ends), "y": (Order("b", "id"), ends), "z": (Order("c", "id"), ends)})
    ref = df.select("id", *[F.ntile(4).over(Window.orderBy(*o)).alias(c) for c, o in (
        ("x", [F.desc("a"), F.asc("id")]), ("y", [F.asc("b"), F.asc("id")]), ("z", [F.asc_nulls_first("c"), F.asc("id")]))])
    assert {r.id: (r.x, r.y, r.z) for r in got.collect()} == {r.id: (r.x, r.y, r.z) for r in ref.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_numeric_keys_and_nulls_last(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    df = written(spark.createDataFrame(rows(300, 4, int), "id long, a long, b int, c decimal(22,2)"), "t")
    for k in (2, 7):
        ends = tile_ends(300, k)
        got = tiles(df, {"y": (Order("b", "id"), ends), "z": (Order("c", "id", nulls_first=False), ends)})
        ref = df.select("id", F.ntile(k).over(Window.orderBy("b", "id")).alias("y"), F.ntile(k).over(Window.orderBy(F.asc_nulls_last("c"), "id")).alias("z"))
        assert {r.id: (r.y, r.z) for r in got.collect()} == {r.id: (r.y, r.z) for r in ref.collect()}


def test_positions(spark):
    for n in range(1, 40):
        for k in (2, 4, 7):
            q, r = divmod(n, k)
            tile = [t for t in range(1, k + 1) for _ in range(q + (t <= r))]
            assert [sum(x <= i for x in tile) for i in range(1, k)] == tile_ends(n, k)
            ranks = [max(1, -(-k * i // (n - 1))) if n > 1 else 1 for i in range(n)]
            assert [sum(x <= i for x in ranks) for i in range(1, k)] == rank_bin_ends(n, k)


@pytest.mark.parametrize("values", [[5.0], [1.5, 1.5, 1.5], [0.1 * i for i in range(999)], [1e-300, 1e300, -1e300, 0.0], [float(i % 3) for i in range(100)]])
def test_percentiles_equal_numpy(spark, monkeypatch, values):
    monkeypatch.setattr(selection, "BINS", 16)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for p in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = spark.range(1).select(exact_percentile(df, "v", p).alias("q")).first().q
        assert got == pytest.approx(float(np.percentile(values, 100 * p)), rel=1e-12)
    assert spark.range(1).select(exact_percentile(df.where("v is null"), "v", 0.5).alias("q")).first().q is None


def test_selection_counts_weights(spark):
    df = written(spark.createDataFrame([(1.0, 10), (2.0, 1), (3.0, 5)], "x double, n long"), "t")
    assert [c.value for c in Selection(df, "n").find([(Order("x"), p) for p in (1, 10, 11, 12, 16)])] == ["1.0", "1.0", "2.0", "3.0", "3.0"]


def test_rfm_scores_have_no_sort(spark):
    df = spark.createDataFrame([(f"c{i}", i % 9, 1, Decimal(i * 7 % 50)) for i in range(200)], "c string, recency int, frequency long, monetary decimal(22,2)")
    for how in ("ntile", "qcut"):
        plan = rfm_score(df, "c", how)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "ExistingRDD" not in plan
    assert rfm_score(df.limit(0), "c", "ntile").count() == 0


@pytest.mark.parametrize("typ,few", [("string", 1000), ("string", 1), ("long", 1000), ("long", 1)])
def test_a_null_key_comes_first_in_its_tie(spark, monkeypatch, typ, few):
    monkeypatch.setattr(selection, "FEW", few)
    for n in (2, 5, 8):
        data = [(None, 1, 1)] + [(str(i) if typ == "string" else i, 1, i % 2) for i in range(n - 1)]
        df = written(spark.createDataFrame(data, f"id {typ}, a long, b int"), "t")
        for ends in ([1], tile_ends(n, 4)):
            got = tiles(df, {"x": (Order("a", "id", desc=True, nulls_first=False), ends), "y": (Order("b", "id"), ends)})
            line = {c: [r.id for r in df.orderBy(*o).collect()] for c, o in (("x", [F.desc("a"), F.asc("id")]), ("y", [F.asc("b"), F.asc("id")]))}
            assert {r.id: (r.x, r.y) for r in got.collect()} == {i: tuple(1 + sum(line[c].index(i) >= e for e in ends) for c in "xy") for i, *_ in data}
