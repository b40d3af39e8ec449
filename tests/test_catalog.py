from pyspark.sql import functions as F

from marketlens.operators.stats import heatmap
from marketlens.plans import sql_reports
from marketlens.plans.catalog import run_reports, run_sql
from marketlens.plans.model import Warehouse
from tests.fixtures import mini_sources


def test_sql_over_published_views(spark):
    wh = Warehouse(spark, mini_sources(spark), etl_date="2024-01-01")
    df = run_sql(wh, """-- delivered orders per month
        SELECT purchase_year_month, COUNT(DISTINCT order_id) AS n
        FROM v_order_full WHERE order_status = 'delivered' GROUP BY purchase_year_month""")
    assert [(r.purchase_year_month, r.n) for r in df.collect()] == [("2017-01", 5)]


def test_run_reports_prefix_and_error_frame(spark):
    wh = Warehouse(spark, mini_sources(spark), etl_date="2024-01-01")

    def broken(w):
        raise RuntimeError("boom")
    out = run_reports(wh, {**sql_reports.QUERIES, "q99_broken": broken}, prefix="q0")
    assert set(out) == {f"q0{i}_" + n.split("_", 1)[1] for i, n in
                        [(int(k[1:3]), k) for k in sql_reports.QUERIES if k.startswith("q0")]}
    err = run_reports(wh, {"q99_broken": broken})["q99_broken"].first()
    assert "boom" in err.error


def test_heatmap_wide_matches_long(spark):
    df = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 3.0), ("b", "m1", 5.0)], "c string, m string, v double")
    long = {(r.c, r.m): r.value for r in heatmap(df, "c", "m", F.avg("v")).collect()}
    wide = {r.c: r for r in heatmap(df, "c", "m", F.avg("v"), wide=True, columns=["m1", "m2"]).collect()}
    assert wide["a"]["m1"] == long[("a", "m1")] and wide["b"]["m2"] is None
