
import pytest
from pyspark.sql import functions as F

from marketlens.plans import ads_reports, marts, sql_reports
from marketlens.plans.model import Warehouse
from tests.conftest import SF001


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.from_testdata(spark, SF001, etl_date="2024-01-01")


def test_shares_sum_to_100(wh):
    pct = sum(r.pct for r in sql_reports.q10_seller_coverage(wh).collect())
    assert pct == pytest.approx(100.0, abs=0.3)
    q9 = sql_reports.q09_top5_category_share(wh).groupBy("purchase_year_month").agg(F.sum("revenue_share_pct"))
    assert all(abs(r[1] - 100.0) <= 0.3 for r in q9.collect())


def test_cumulative_share_ends_at_one(wh):
    m5 = marts.category_summary(wh).orderBy(F.col("total_revenue").desc()).collect()
    assert float(m5[-1].cumulative_pct) == 1.0
    assert all(float(a.cumulative_pct) <= float(b.cumulative_pct) for a, b in zip(m5, m5[1:]))


def test_mart_totals_equal_fact_totals(wh):
    f = wh.fact.agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("rev")).first()
    m = marts.daily_metrics(wh).agg(F.sum("total_items").alias("n"), F.sum("total_revenue").alias("rev")).first()
    assert m.n == f.n and m.rev == f.rev


def test_item_weighted_gmv_not_below_order_level(wh):
    item = wh.fact.agg(F.sum("payment_value")).first()[0]
    order = wh.fact.dropDuplicates(["order_id"]).agg(F.sum("payment_value")).first()[0]
    assert item >= order


def test_keys_unique(wh):
    assert wh.fact.groupBy("order_id", "order_item_id").count().where("count > 1").count() == 0
    assert marts.daily_metrics(wh).groupBy("purchase_date").count().where("count > 1").count() == 0
    assert wh.dim_customers.groupBy("customer_unique_id").count().where("count > 1").count() == 0
    assert marts.weekly_metrics(wh).groupBy("year_week").count().where("count > 1").count() == 0


def test_rfm_ntile_balanced(wh):
    rows = sql_reports.q21_rfm_segments(wh).collect()
    assert sum(r.customer_count for r in rows) == wh.view_delivered.select("customer_unique_id").distinct().count()


def test_layer_audit_counts(wh):
    audit = {r.table: r.rows for r in ads_reports.s8_warehouse_stats(wh).collect()}
    assert audit["dwd_order_detail"] == wh.fact.count()
    assert audit["ods_order_items"] == wh.t("order_items").count()
