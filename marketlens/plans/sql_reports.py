"""SQL report family Q1-Q21 over the delivered view ``V`` (and raw reviews).

Conventions shared with the oracle: averages of integers are plain ``avg``;
averages and sums of DECIMAL money are taken exactly and divided once in
double; every reported fraction is rounded half-up through ``rnd``; counts are
BIGINT.  ``LIMIT`` reports order by the reported (rounded) measure and break
ties on the group key, so the cut is repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.buckets import case_labels
from marketlens.functions.numeric import fdiv, rnd
from marketlens.operators.grouping import distinct_per_group, group_metrics, n_orders, semi_top_n, share_of_total
from marketlens.operators.ranking import abc_classify, pareto
from marketlens.operators.rfm import rfm, rfm_score
from marketlens.operators.stats import cohort_profile
from marketlens.plans.model import Warehouse



def _n_orders():
    return F.countDistinct("order_id")


def _avg_days():
    return rnd(F.avg("delivery_days"), 1)


def _late_pct():
    return rnd(F.avg("is_delayed") * F.lit(100.0), 1)


def _money(c: str = "price", places: int = 0):
    return rnd(F.sum(c), places)


def _mean_money(c: str):
    return fdiv(F.sum(c), F.count(c))


def _reviewed(wh: Warehouse, grain: str = "item") -> DataFrame:
    """V joined to reviews.

    ``grain='item'`` joins the raw reviews: one row per item × review, as the
    source reports do (an order with two reviews counts twice, N5).
    ``grain='order'`` joins the per-order mean review instead (no fan-out).
    """
    if grain == "item":
        r = wh.t("order_reviews").select("order_id", "review_score")
    elif grain == "order":
        r = wh.reviews_by_order
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return wh.view_delivered.join(r, "order_id", "inner")


# ---------------------------------------------------------------- delivery
def q01_delivery_kpi(wh: Warehouse) -> DataFrame:
    return wh.view_delivered.agg(
        F.lit(L.SCOPE_ALL).alias("scope"),
        n_orders().alias("total_delivered"),
        _avg_days().alias("avg_delivery_days"),
        rnd(F.avg("delivery_days"), 0).alias("median_delivery_days"),
        _late_pct().alias("delay_rate_pct"),
        rnd(F.avg(F.when(F.col("is_delayed") == 1, F.col("delay_days"))), 1).alias("avg_delay_when_late"),
    )


def q02_monthly_delivery(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "purchase_year_month", {
        "avg_delivery_days": _avg_days(),
        "delay_rate_pct": _late_pct(),
        "order_count": n_orders(),
    }, order_by=["purchase_year_month"])


def q03_state_delivery(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "customer_state", {
        "avg_delivery_days": _avg_days(), "delay_rate_pct": _late_pct(), "order_count": n_orders(),
    }, non_null_keys=True, min_support=("order_count", 50),
        order_by=[F.col("avg_delivery_days").desc(), "customer_state"])


def q04_category_delay_top15(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "category_name", {
        "avg_delivery_days": _avg_days(), "delay_rate_pct": _late_pct(), "order_count": n_orders("first_in_category"),
    }, non_null_keys=True, order_by=[F.col("delay_rate_pct").desc(), "category_name"], limit=15)


def q05_delay_days_distribution(wh: Warehouse) -> DataFrame:
    v = wh.view_delivered.where((F.col("is_delayed") == 1) & (F.col("delay_days") <= 30))
    return group_metrics(v, "delay_days", {"delay_count": n_orders()}, order_by=["delay_days"])


def q06_worst_sellers(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "seller_id", {
        "avg_delivery_days": _avg_days(), "delay_rate_pct": _late_pct(), "total_orders": _n_orders(),
        "total_revenue": F.sum("price").cast("double"),
    }, non_null_keys=True, order_by=[F.col("delay_rate_pct").desc(), "seller_id"], limit=10)


# --------------------------------------------------------------- inventory
def q07_category_velocity(wh: Warehouse) -> DataFrame:
    v = wh.view_delivered
    span = v.agg(F.datediff(F.max("order_purchase_timestamp"), F.min("order_purchase_timestamp"))).scalar()
    orders = n_orders("first_in_category")
    out = group_metrics(v, "category_name", {
        "total_sales": orders,
        "total_revenue": _money(),
        "daily_sales": rnd(fdiv(orders, span), 2),
    }, non_null_keys=True, order_by=[F.col("daily_sales").desc(), "category_name"], limit=20)
    for col, name in (("product_id", "unique_products"), ("seller_id", "unique_sellers")):  # of the 20 only
        pairs = distinct_per_group(v.join(F.broadcast(out.select("category_name")), "category_name", "left_semi"), "category_name", col, name)
        out = out.join(pairs, "category_name", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return out.orderBy(F.col("daily_sales").desc(), "category_name")


def q08_abc(wh: Warehouse) -> DataFrame:
    cat = group_metrics(wh.view_delivered, "category_name", {
        "revenue": F.sum("price")}, non_null_keys=True)
    ranked = pareto(cat, "category_name", "revenue", frame="range", share="revenue_pct", cum="cum_pct")
    a, b, c = L.ABC_SQL_LABELS
    return ranked.select(
        "category_name",
        rnd("revenue", 0).alias("revenue"),
        rnd("revenue_pct", 1).alias("revenue_pct"),
        rnd("cum_pct", 1).alias("cum_pct"),
        abc_classify("cum_pct", L.ABC_PCT_BOUNDS, (a, b, c)).alias("abc_class"),
    ).orderBy(F.col("revenue").desc(), "category_name")


def q09_top5_category_share(wh: Warehouse) -> DataFrame:
    """Share among the top 5 only: the WHERE runs before the window."""
    v = wh.view_delivered
    rank = v.groupBy("category_name").agg(F.sum("price").alias("rev"))
    top = semi_top_n(v, rank, "category_name", [F.col("rev").desc_nulls_last(), F.col("category_name")], 5)
    monthly = top.groupBy("purchase_year_month", "category_name").agg(F.sum("price").alias("monthly_revenue"))
    w = Window.partitionBy("purchase_year_month")
    total = F.sum("monthly_revenue").over(w)
    return monthly.select(
        "purchase_year_month", "category_name",
        F.col("monthly_revenue").cast("double").alias("monthly_revenue"),
        total.cast("double").alias("total_monthly_revenue"),
        rnd(fdiv(F.col("monthly_revenue"), total) * F.lit(100.0), 1).alias("revenue_share_pct"),
    ).orderBy("purchase_year_month", "category_name")


def q10_seller_coverage(wh: Warehouse) -> DataFrame:
    per_seller = group_metrics(wh.view_delivered, "seller_id",
                               {"category_count": F.countDistinct("category_name")}, non_null_keys=True)
    one, two3, four5, more = L.SELLER_TYPES
    seg = (F.when(F.col("category_count") == 1, one).when(F.col("category_count") <= 3, two3)
           .when(F.col("category_count") <= 5, four5).otherwise(more))
    counts = per_seller.groupBy(seg.alias("seller_type")).agg(F.count(F.lit(1)).alias("seller_count"))
    return (share_of_total(counts, "seller_count", None, "_pct")
            .select("seller_type", "seller_count", rnd("_pct", 1).alias("pct"))
            .orderBy(F.col("seller_count").desc(), "seller_type"))


# ------------------------------------------------------------ satisfaction
def _score_rate(cond):
    return rnd(fdiv(F.sum(F.when(cond, 1).otherwise(0)), F.countDistinct("order_id")) * F.lit(100.0), 1)


def q11_score_by_delay(wh: Warehouse, grain: str = "item") -> DataFrame:
    label = F.when(F.col("is_delayed") == 1, L.DELAYED_LABEL).otherwise(L.ON_TIME_LABEL)
    return group_metrics(_reviewed(wh, grain), label.alias("delivery_type"), {
        "order_count": _n_orders(),
        "avg_score": rnd(F.avg("review_score"), 2),
        "score_5_rate_pct": _score_rate(F.col("review_score") == 5),
        "negative_rate_pct": _score_rate(F.col("review_score") <= 2),
    })


def q12_score_by_days_bucket(wh: Warehouse, grain: str = "item") -> DataFrame:
    rng = case_labels("delivery_days", L.Q12_BOUNDS, L.Q12_LABELS, L.Q12_ELSE)
    out = group_metrics(_reviewed(wh, grain), rng.alias("delivery_range"), {
        "order_count": _n_orders(),
        "avg_score": rnd(F.avg("review_score"), 2),
        "score_5_rate_pct": _score_rate(F.col("review_score") == 5),
        "_min_days": F.min("delivery_days"),
    })
    return out.orderBy(F.col("_min_days").asc_nulls_first(), "delivery_range").drop("_min_days")


def q13_state_satisfaction(wh: Warehouse, grain: str = "item") -> DataFrame:
    return group_metrics(_reviewed(wh, grain), "customer_state", {
        "avg_delivery_days": _avg_days(), "delay_rate_pct": _late_pct(),
        "avg_score": rnd(F.avg("review_score"), 2), "order_count": _n_orders(),
    }, non_null_keys=True, min_support=("order_count", 50), order_by=["avg_score", "customer_state"])


def q14_satisfaction_factors(wh: Warehouse, grain: str = "item") -> DataFrame:
    return _reviewed(wh, grain).agg(
        rnd(F.avg("review_score"), 2).alias("avg_score"),
        _avg_days().alias("avg_delivery_days"),
        _late_pct().alias("delay_rate_pct"),
        rnd(_mean_money("freight_value"), 2).alias("avg_freight"),
        rnd(_mean_money("product_weight_g"), 0).alias("avg_weight_g"),
        rnd(_mean_money("price"), 2).alias("avg_price"),
    )


def q15_review_cohorts(wh: Warehouse, grain: str = "item") -> DataFrame:
    s = F.col("review_score")
    return cohort_profile(_reviewed(wh, grain), {L.NEGATIVE_COHORT: s <= 2, L.POSITIVE_COHORT: s == 5}, {
        "order_count": _n_orders(),
        "avg_delivery_days": _avg_days(),
        "avg_delay_days": rnd(F.avg("delay_days"), 1),
        "avg_freight": rnd(_mean_money("freight_value"), 2),
        "avg_weight_g": rnd(_mean_money("product_weight_g"), 0),
    }).withColumn("order_count", F.coalesce("order_count", F.lit(0)).cast("bigint"))


# -------------------------------------------------------------------- sales
def q16_monthly_sales(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "purchase_year_month", {
        "monthly_orders": n_orders(),
        "monthly_revenue": _money(),
        "unique_customers": F.countDistinct("customer_unique_id"),
        "avg_order_value": rnd(fdiv(F.sum("price"), n_orders()), 0),
    }, order_by=["purchase_year_month"])


def q17_weekday_sales(wh: Warehouse) -> DataFrame:
    dow = F.dayofweek("order_purchase_timestamp")
    out = group_metrics(wh.view_delivered, dow.alias("_dow"), {
        "order_count": n_orders(), "total_revenue": _money()})
    names = F.array(*[F.lit(x) for x in L.DOW_SUN1_NAMES])
    return (out.select(F.element_at(names, F.col("_dow")).alias("day_of_week"), "order_count",
                       "total_revenue", "_dow").orderBy("_dow").drop("_dow"))


def q18_month_of_year_sales(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, F.col("purchase_month").cast("bigint").alias("purchase_month"), {
        "order_count": n_orders(), "total_revenue": _money()}, order_by=["purchase_month"])


def q19_state_sales(wh: Warehouse) -> DataFrame:
    return group_metrics(wh.view_delivered, "customer_state", {
        "total_orders": n_orders(),
        "total_revenue": _money(),
        "customer_count": F.countDistinct("customer_unique_id"),
        "avg_order_value": rnd(fdiv(F.sum("price"), n_orders()), 0),
    }, non_null_keys=True, order_by=[F.col("total_revenue").desc(), "customer_state"])


def q20_status_shares(wh: Warehouse) -> DataFrame:
    o = wh.t("orders")
    total = o.agg(F.countDistinct("order_id")).scalar()
    return group_metrics(o, "order_status", {
        "count": _n_orders(),
        "pct": rnd(fdiv(F.countDistinct("order_id"), total) * F.lit(100.0), 1),
    }, order_by=[F.col("count").desc(), "order_status"])


def q21_rfm_segments(wh: Warehouse) -> DataFrame:
    """NTILE(4) scores with the customer id as tie-break (N10), distributed (§7.4);
    recency from the latest delivered purchase (N25)."""
    base = rfm(wh.view_delivered, "customer_unique_id", "order_id", "order_purchase_timestamp", "price")
    seg = rfm_score(base, "customer_unique_id", "ntile")
    counts = seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        rnd(_mean_money("monetary"), 0).alias("avg_lifetime_value"),
        rnd(F.avg("frequency"), 1).alias("avg_orders"),
    )
    ordinal = F.array_position(F.array(*[F.lit(x) for x in L.RFM_LABELS]), F.col("segment"))
    return (share_of_total(counts, "customer_count", None, "_pct")
            .select("segment", "customer_count", rnd("_pct", 1).alias("pct"), "avg_lifetime_value",
                    "avg_orders", ordinal.alias("_o"))
            .orderBy("_o").drop("_o"))


QUERIES = {
    "q01_delivery_kpi": q01_delivery_kpi,
    "q02_monthly_delivery": q02_monthly_delivery,
    "q03_state_delivery": q03_state_delivery,
    "q04_category_delay_top15": q04_category_delay_top15,
    "q05_delay_days_distribution": q05_delay_days_distribution,
    "q06_worst_sellers": q06_worst_sellers,
    "q07_category_velocity": q07_category_velocity,
    "q08_abc": q08_abc,
    "q09_top5_category_share": q09_top5_category_share,
    "q10_seller_coverage": q10_seller_coverage,
    "q11_score_by_delay": q11_score_by_delay,
    "q12_score_by_days_bucket": q12_score_by_days_bucket,
    "q13_state_satisfaction": q13_state_satisfaction,
    "q14_satisfaction_factors": q14_satisfaction_factors,
    "q15_review_cohorts": q15_review_cohorts,
    "q16_monthly_sales": q16_monthly_sales,
    "q17_weekday_sales": q17_weekday_sales,
    "q18_month_of_year_sales": q18_month_of_year_sales,
    "q19_state_sales": q19_state_sales,
    "q20_status_shares": q20_status_shares,
    "q21_rfm_segments": q21_rfm_segments,
}
