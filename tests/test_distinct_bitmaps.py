"""Distinct counts from merged bitmaps against counted rows."""

from pyspark.sql import functions as F

from marketlens.operators.distinct_bitmaps import bitmaps, count_values, number_values, roll_up
from marketlens.plans import marts
from marketlens.plans.model import Warehouse
from tests.fixtures import mini_sources


def test_merged_bitmaps_count_as_rows_do(spark):
    # 70,000 values fill three buckets; a third of all rows share one group, some groups or values are NULL
    df = spark.range(140_000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 31 == 0, None).otherwise(F.col("id") % 40).alias("day"),
        F.when(F.col("id") % 17 != 0, F.concat(F.lit("v"), F.col("id") % 70_000)).alias("value"))
    numbers = number_values(df.select("value", F.lit("x").alias("state")).distinct(), "value", ["state"])
    seen = numbers.agg(F.min("number"), F.max("number"), F.count("*"), F.countDistinct("number")).first()
    assert seen[0] == 1 and seen[1] == seen[2] == seen[3] == df.select("value").dropna().distinct().count()
    parts = bitmaps(df.join(numbers, "value", "left"), ["day"])
    assert {r.n for r in parts.select(F.length("bitmap").alias("n")).distinct().collect()} == {4096}
    for by in (["day"], [(F.col("day") % 7).alias("weekday")], []):
        got = {tuple(r) for r in count_values(parts, by, "n").collect()}
        want = {tuple(r) for r in df.groupBy(*by).agg(F.countDistinct("value").alias("n")).collect()}
        assert got == want
    twice = roll_up(parts.unionByName(parts), ["day"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, parts.select("day", "bucket", "bitmap").collect()))
    assert count_values(parts.limit(0), ["day"], "n").count() == 0


def test_stored_bitmaps_serve_months_weeks_and_states(spark, tmpdir_path):
    raw = Warehouse(spark, mini_sources(spark), etl_date="2024-01-01")
    stored = raw.materialize(tmpdir_path)
    for report in (marts.distinct_by_month, marts.distinct_by_week, marts.distinct_by_state):
        df = report(stored)
        assert df.inputFiles() and all("/base_distinct_" in f for f in df.inputFiles())
        assert df.count() and sorted(map(str, df.collect())) == sorted(map(str, report(raw).collect()))
