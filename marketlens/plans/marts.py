"""Summary marts (DWS layer M1-M6 from the fact; CSV summaries M7-M9).

Each mart is one ``groupBy().agg()`` over the fact: Spark plans a partial
aggregate per task before the shuffle on the group key, so a day or category
holding a third of all rows costs one partial row per task.  Values are stored
with the warehouse DDL's decimal scales (``dec``), and later reports aggregate
the stored values, as the source system does (N8: averages of averages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.dates import mysql_week, year_month, year_week
from marketlens.functions.numeric import dec, decimals_to_double, decq, fdiv, rnd
from marketlens.operators.distinct_bitmaps import count_values
from marketlens.operators.grouping import distinct_per_group, n_orders
from marketlens.plans.model import FLAGS, Warehouse


def _etl(wh: Warehouse):
    return F.lit(wh.etl_date).cast("date") if wh.etl_date else F.current_date()


def _pos_days():
    return F.when(F.col("delivery_days") > 0, F.col("delivery_days"))


def _mean(c, p: int, s: int, **kw):
    """Exact mean of an integer / decimal column stored as DECIMAL(p, s)."""
    c = F.col(c) if isinstance(c, str) else c
    return decq(F.sum(c), F.count(c), p, s, **kw)


def _common(wh: Warehouse) -> dict:
    return {
        "avg_delivery_days": _mean(_pos_days(), 6, 2),
        "delay_rate": _mean("is_delayed", 6, 4),
        "avg_review_score": dec(F.avg("review_score"), 4, 2),
    }


def _nonempty(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def _late_days():
    return F.when(F.col("is_delayed") == 1, F.col("delay_days"))


# ------------------------------------------------------------------- M1
def daily_metrics(wh: Warehouse) -> DataFrame:
    """Per purchase day (M1).

    Orders and what belongs to an order are counted on its flagged first item,
    so the day aggregate is partial sums only; distinct customers and sellers
    come from (day, customer) and (day, seller) pairs joined back by day (one
    row per day).  ``total_gmv`` sums the order payment once per item row as the
    source system does (N17); ``total_gmv_order_level`` counts it once per order.
    """
    f = wh.fact
    first = F.col("first_of_order")
    m = _common(wh)
    day = f.groupBy("purchase_date").agg(
        n_orders().alias("total_orders"),
        F.count(F.lit(1)).alias("total_items"),
        dec(F.sum("payment_value"), 38, 2).alias("total_gmv"),
        dec(F.sum(F.when(first, F.col("payment_value"))), 38, 2).alias("total_gmv_order_level"),
        dec(F.sum("price"), 38, 2).alias("total_revenue"),
        dec(F.sum("freight_value"), 38, 2).alias("total_freight"),
        decq(F.sum("payment_value"), n_orders(), 10, 2, num_scale=2).alias("avg_order_value"),
        F.count(F.when(first & F.col("delivered_date").isNotNull(), 1)).alias("delivered_orders"),
        *[c.alias(n) for n, c in m.items()],
        _mean(_late_days(), 6, 2).alias("avg_delay_days"),
    )
    out = day
    for col, name, rows in (("customer_unique_id", "unique_customers", f.where(first)), ("seller_id", "unique_sellers", f)):
        out = out.join(distinct_per_group(rows, "purchase_date", col, name), "purchase_date", "left")
    counts = ("unique_customers", "unique_sellers")
    return out.select("purchase_date", "total_orders", "total_items", "total_gmv", "total_gmv_order_level", "total_revenue",
                      "total_freight", "avg_order_value", "delivered_orders", "avg_delivery_days", "delay_rate",
                      "avg_delay_days", "avg_review_score", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                      _etl(wh).alias("etl_date"))


# ------------------------------------------------------------------- M2
def daily_category(wh: Warehouse) -> DataFrame:
    m = _common(wh)
    return wh.fact.where(_nonempty("category_name")).groupBy("purchase_date", "category_name").agg(
        n_orders("first_in_category").alias("total_orders"),
        dec(F.sum("payment_value"), 38, 2).alias("total_gmv"),
        dec(F.sum("price"), 38, 2).alias("total_revenue"),
        _mean("price", 10, 2, num_scale=2).alias("avg_price"),
        m["avg_delivery_days"].alias("avg_delivery_days"),
        m["delay_rate"].alias("delay_rate"),
        m["avg_review_score"].alias("avg_review_score"),
        _etl(wh).alias("etl_date"),
    )


# ------------------------------------------------------------------- M3
def daily_state(wh: Warehouse) -> DataFrame:
    m = _common(wh)
    return (wh.fact.where(F.col("customer_state").isNotNull())
            .groupBy("purchase_date", F.col("customer_state").alias("state")).agg(
                n_orders().alias("total_orders"),
                dec(F.sum("payment_value"), 38, 2).alias("total_gmv"),
                m["avg_delivery_days"].alias("avg_delivery_days"),
                m["delay_rate"].alias("delay_rate"),
                m["avg_review_score"].alias("avg_review_score"),
                _etl(wh).alias("etl_date")))


# ------------------------------------------------------------------- M4
def weekly_metrics(wh: Warehouse, daily: DataFrame | None = None) -> DataFrame:
    """Roll-up of M1 by (YEAR, MySQL WEEK(d,1)) (N13); a week spanning New Year splits."""
    d = daily if daily is not None else wh.mart("dws_daily_metrics")
    dt = F.col("purchase_date")
    return (d.groupBy(F.year(dt).alias("_y"), mysql_week(dt).alias("_w")).agg(
        F.min(dt).alias("week_start_date"),
        F.max(dt).alias("week_end_date"),
        F.sum("total_orders").cast("bigint").alias("total_orders"),
        dec(F.sum("total_gmv"), 38, 2).alias("total_gmv"),
        decq(F.sum("total_orders"), F.lit(7), 20, 1).alias("avg_daily_orders"),
        _mean("avg_delivery_days", 6, 2, num_scale=2).alias("avg_delivery_days"),
        _mean("delay_rate", 6, 4, num_scale=4).alias("delay_rate"),
        _mean("avg_review_score", 4, 2, num_scale=2).alias("avg_review_score"),
        _etl(wh).alias("etl_date"))
        .withColumn("year_week", year_week(F.col("week_start_date")))
        .select("year_week", "week_start_date", "week_end_date", "total_orders", "total_gmv",
                "avg_daily_orders", "avg_delivery_days", "delay_rate", "avg_review_score", "etl_date"))


# ------------------------------------------------------------------- M5
def category_summary(wh: Warehouse) -> DataFrame:
    """Category totals + revenue share, running share (row by row, N9) and ABC.

    The ABC class tests the *stored* (4-place) running share.  The running
    window runs over one row per category — a small aggregate.
    """
    f = wh.fact.where(_nonempty("category_name"))
    m = _common(wh)
    agg = f.groupBy("category_name").agg(
        n_orders("first_in_category").alias("total_orders"),
        dec(F.sum("payment_value"), 38, 2).alias("total_gmv"),
        F.sum("price").alias("_rev"),
        _mean("price", 10, 2, num_scale=2).alias("avg_price"),
        *[c.alias(n) for n, c in m.items()],
        _mean(_late_days(), 6, 2).alias("avg_delay_days"),
        decq(F.count(F.lit(1)), F.datediff(F.max("purchase_date"), F.min("purchase_date")), 20, 1).alias("daily_avg_items"),
    )
    agg = (agg.join(distinct_per_group(f, "category_name", "seller_id", "_sellers"), "category_name", "left")
           .withColumn("unique_sellers", F.coalesce("_sellers", F.lit(0)).cast("bigint")).drop("_sellers"))
    total = F.sum("_rev").over(Window.partitionBy())
    run = F.sum("_rev").over(Window.orderBy(F.col("_rev").desc(), F.col("category_name"))
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a, b, c = L.ABC_MART_LABELS
    lo, hi = L.ABC_FRACTION_BOUNDS
    out = (agg.withColumn("total_revenue", dec(F.col("_rev"), 38, 2))
           .withColumn("revenue_pct", decq(F.col("_rev"), total, 6, 4, num_scale=2, den_scale=2))
           .withColumn("cumulative_pct", decq(run, total, 6, 4, num_scale=2, den_scale=2)))
    out = out.withColumn("abc_class", F.when(F.col("cumulative_pct") <= lo, a)
                         .when(F.col("cumulative_pct") <= hi, b).otherwise(c))
    return out.select("category_name", "total_orders", "total_gmv", "total_revenue", "avg_price",
                      "avg_delivery_days", "delay_rate", "avg_review_score", "revenue_pct", "cumulative_pct",
                      "abc_class", "unique_sellers", "daily_avg_items", "avg_delay_days",
                      _etl(wh).alias("etl_date"))


# ------------------------------------------------------------------- M6
def state_summary(wh: Warehouse) -> DataFrame:
    """Per customer state (M6): partial sums, and one distinct count (customers) on the first items."""
    m = _common(wh)
    f = wh.fact.where(F.col("customer_state").isNotNull())
    agg = f.groupBy(F.col("customer_state").alias("state")).agg(
        n_orders().alias("total_orders"),
        dec(F.sum("payment_value"), 38, 2).alias("total_gmv"),
        *[c.alias(n) for n, c in m.items()])
    people = distinct_per_group(f.where("first_of_order").withColumnRenamed("customer_state", "state"), "state",
                                "customer_unique_id", "unique_customers")
    return agg.join(people, "state", "left").select(
        "state", "total_orders", "total_gmv", "avg_delivery_days", "delay_rate", "avg_review_score",
        F.coalesce("unique_customers", F.lit(0)).cast("bigint").alias("unique_customers"), _etl(wh).alias("etl_date"))


# ------------------------------------------------------- M7-M9 (CSV path)
def _csv_common():
    return {
        "avg_delivery_days": fdiv(F.sum("delivery_time_days"), F.count("delivery_time_days")),
        "delay_rate": rnd(F.avg("is_delayed") * F.lit(100.0), 1),
    }


def seller_summary(wh: Warehouse) -> DataFrame:
    """Per seller (M7).  pandas ``first`` city/state becomes ``min``."""
    m = _csv_common()
    return wh.csv_delivered.where(F.col("seller_id").isNotNull()).groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("total_revenue"),
        m["avg_delivery_days"].alias("avg_delivery_days"),
        m["delay_rate"].alias("delay_rate"),
        fdiv(F.sum("freight_value"), F.count("freight_value")).alias("avg_freight"),
        F.min("seller_city").alias("seller_city"),
        F.min("seller_state").alias("seller_state"),
    )


def csv_category_summary(wh: Warehouse) -> DataFrame:
    m = _csv_common()
    d = wh.csv_delivered.where(F.col("category_name").isNotNull())
    out = d.groupBy("category_name").agg(
        n_orders("first_in_category").alias("total_orders"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("total_revenue"),
        fdiv(F.sum("price"), F.count("price")).alias("avg_price"),
        m["avg_delivery_days"].alias("avg_delivery_days"),
        m["delay_rate"].alias("delay_rate"))
    for col, name in (("product_id", "unique_products"), ("seller_id", "unique_sellers")):
        out = out.join(distinct_per_group(d, "category_name", col, name), "category_name", "left").withColumn(
            name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out


def monthly_summary(wh: Warehouse) -> DataFrame:
    m = _csv_common()
    return wh.report_frame.where(F.col("purchase_year_month").isNotNull()).groupBy("purchase_year_month").agg(
        n_orders().alias("total_orders"),
        F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("total_revenue"),
        m["avg_delivery_days"].alias("avg_delivery_days"),
        m["delay_rate"].alias("delay_rate"),
        F.countDistinct("customer_unique_id").alias("unique_customers"),
    )


# ------------------------------------- distinct people from daily bitmaps (A1)
def distinct_by_month(wh: Warehouse) -> DataFrame:
    """Distinct customers and sellers a month: daily counts do not add up, daily bitmaps do."""
    return _distinct_by(wh, year_month(F.col("purchase_date")).alias("purchase_year_month"))


def distinct_by_week(wh: Warehouse) -> DataFrame:
    """As ``distinct_by_month``, by the weeks of the weekly mart (a week that spans New Year splits)."""
    day = F.col("purchase_date")
    return _distinct_by(wh, F.year(day).alias("purchase_year"), mysql_week(day).cast("int").alias("purchase_week"))


def _distinct_by(wh: Warehouse, *by) -> DataFrame:
    people = count_values(wh.day_bitmaps("distinct_customers"), by, "unique_customers")
    sellers = count_values(wh.day_bitmaps("distinct_sellers"), by, "unique_sellers")
    keys = [c for c in people.columns if c != "unique_customers"]
    return people.join(sellers, keys, "full").fillna(0, ["unique_customers", "unique_sellers"])


def distinct_by_state(wh: Warehouse) -> DataFrame:
    """Distinct customers per state, over all days."""
    known = wh.day_bitmaps("distinct_customers").where(F.col("customer_state").isNotNull())
    return count_values(known, ["customer_state"], "unique_customers")


def _out(df: DataFrame) -> DataFrame:
    return decimals_to_double(df.drop("etl_date", *FLAGS))


QUERIES = {
    "d5_order_detail": lambda wh: _out(wh.fact),
    "d2_dim_customers": lambda wh: wh.dim_customers,
    "d3_dim_products": lambda wh: _out(wh.dim_products),
    "d4_dim_sellers": lambda wh: _out(wh.dim_sellers),
    "d1_dim_dates": lambda wh: wh.dim_dates_for_orders(),
    "m10_order_full": lambda wh: _out(wh.view),
    "m1_daily_metrics": lambda wh: _out(daily_metrics(wh)),
    "m2_daily_category": lambda wh: _out(daily_category(wh)),
    "m3_daily_state": lambda wh: _out(daily_state(wh)),
    "m4_weekly_metrics": lambda wh: _out(weekly_metrics(wh)),
    "m5_category_summary": lambda wh: _out(category_summary(wh)),
    "m6_state_summary": lambda wh: _out(state_summary(wh)),
    "m7_seller_summary": seller_summary,
    "m8_csv_category_summary": csv_category_summary,
    "m9_monthly_summary": monthly_summary,
    "m_distinct_by_month": distinct_by_month,
    "m_distinct_by_week": distinct_by_week,
    "m_distinct_by_state": distinct_by_state,
}
