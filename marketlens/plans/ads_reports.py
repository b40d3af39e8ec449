"""Warehouse report family Q22-Q43 (reads the marts and the fact) and S8.

Reports read the marts through ``Warehouse.mart``: the stored tables of a built or
materialized warehouse, and plans over the fact only where nothing is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.buckets import case_labels
from marketlens.functions.numeric import decimals_to_double, fdiv
from marketlens.operators.grouping import semi_top_n
from marketlens.operators.rfm import rfm
from marketlens.operators.stats import repeatable_sample
from marketlens.plans.model import Warehouse

SAMPLE_ROWS, SAMPLE_SEED = 5000, 42  # defaults of the sampling reports (L5)


def _sel(df: DataFrame, *cols, order=None, limit=None) -> DataFrame:
    out = df.select(*cols)
    if order:
        out = out.orderBy(*order)
    if limit:
        out = out.limit(limit)
    return decimals_to_double(out)


def _mean(c: str):
    return fdiv(F.sum(c), F.count(c))


# ---------------------------------------------------------------- overview
def q22_overview_kpis(wh: Warehouse) -> DataFrame:
    d = wh.mart("dws_daily_metrics")
    return d.agg(F.sum("total_orders").cast("bigint").alias("total_orders"),
                 F.sum("total_gmv").cast("double").alias("total_gmv"),
                 _mean("avg_delivery_days").alias("avg_delivery"),
                 (_mean("delay_rate") * F.lit(100.0)).alias("delay_rate_pct"))


def q23_overview_gmv_trend(wh: Warehouse) -> DataFrame:
    d = wh.mart("dws_daily_metrics")
    return (d.groupBy(F.date_format("purchase_date", "yyyy-MM").alias("month"))
            .agg(F.sum("total_gmv").cast("double").alias("gmv"), F.sum("total_orders").cast("bigint").alias("orders"))
            .orderBy("month"))


# ---------------------------------------------------------------- delivery
def q24_delivery_distribution(wh: Warehouse) -> DataFrame:
    f = wh.fact.where((F.col("delivery_days") > 0) & (F.col("delivery_days") <= 60)
                      & F.col("delivered_date").isNotNull())
    return f.groupBy("delivery_days").agg(F.count(F.lit(1)).alias("cnt")).orderBy("delivery_days")


def q25_delivery_daily_trend(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_daily_metrics"), "purchase_date", "avg_delivery_days", "delay_rate",
                order=["purchase_date"])


def q26_delivery_by_state(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_state_summary"), "state", "avg_delivery_days", "delay_rate", "total_orders",
                order=[F.col("avg_delivery_days").desc(), "state"])


def q27_delivery_by_category(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_category_summary"), "category_name", "avg_delivery_days", "delay_rate",
                "total_orders", "avg_review_score", order=[F.col("total_orders").desc(), "category_name"])


def q28_delivery_heatmap(wh: Warehouse) -> DataFrame:
    m = wh.mart("dws_daily_category").where(F.col("purchase_date").isNotNull())
    return _sel(m, "purchase_date", "category_name", "avg_delivery_days")


def q29_delayed_top_categories(wh: Warehouse) -> DataFrame:
    m = wh.mart("dws_category_summary").where(F.col("total_orders") > 100)
    return _sel(m, "category_name", "delay_rate", "avg_delay_days", "total_orders",
                order=[F.col("delay_rate").desc(), "category_name"], limit=10)


# --------------------------------------------------------------- inventory
def q30_category_abc(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_category_summary"), "category_name", "total_revenue", "revenue_pct", "cumulative_pct",
                "abc_class", "total_orders", "avg_price", "unique_sellers", "daily_avg_items",
                order=[F.col("total_revenue").desc(), "category_name"])


def q31_category_treemap(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_category_summary"), "category_name", "total_revenue", "total_orders", "avg_price",
                "cumulative_pct", order=[F.col("total_revenue").desc(), "category_name"], limit=30)


def q32_category_sellers(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_category_summary"), "category_name", "unique_sellers", "total_orders", "total_revenue",
                order=[F.col("total_orders").desc(), "category_name"])


# ------------------------------------------------------------ satisfaction
def _scored_fact(wh: Warehouse) -> DataFrame:
    return wh.fact.where((F.col("delivery_days") > 0) & F.col("review_score").isNotNull()
                         & (F.col("delivery_days") <= 60))


def q33_review_vs_delivery_sample(wh: Warehouse, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    s = repeatable_sample(_scored_fact(wh), ["order_id", "order_item_id"], n, seed)
    return _sel(s, "delivery_days", "review_score", "delay_days", "is_delayed", "freight_value", "product_weight_g")


def q34_review_by_delivery_bucket(wh: Warehouse) -> DataFrame:
    f = wh.fact.where((F.col("delivery_days") > 0) & F.col("review_score").isNotNull())
    b = case_labels("delivery_days", L.Q34_BOUNDS, L.Q34_LABELS, L.Q34_ELSE)
    out = f.groupBy(b.alias("bucket")).agg(_mean("review_score").alias("avg_score"),
                                           F.count(F.lit(1)).alias("cnt"), F.min("delivery_days").alias("_m"))
    return out.orderBy("_m").drop("_m")


def q35_review_state_comparison(wh: Warehouse) -> DataFrame:
    m = wh.mart("dws_state_summary").where(F.col("total_orders") > 100)
    return _sel(m, "state", "avg_review_score", "avg_delivery_days", "total_orders",
                order=["avg_review_score", "state"])


def q36_correlation_sample(wh: Warehouse, n: int = SAMPLE_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    s = repeatable_sample(_scored_fact(wh), ["order_id", "order_item_id"], n, seed)
    return _sel(s, "delivery_days", "delay_days", "review_score", "freight_value", "product_weight_g", "price")


# -------------------------------------------------------------------- sales
def q37_sales_trend(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_daily_metrics"), "purchase_date", "total_orders", "total_gmv", "avg_order_value",
                "unique_customers", order=["purchase_date"])


def q38_sales_monthly(wh: Warehouse) -> DataFrame:
    d = wh.mart("dws_daily_metrics")
    return (d.groupBy(F.date_format("purchase_date", "yyyy-MM").alias("month")).agg(
        F.sum("total_orders").cast("bigint").alias("orders"),
        F.sum("total_gmv").cast("double").alias("gmv"),
        _mean("avg_order_value").alias("aov"),
        F.sum("unique_customers").cast("bigint").alias("customers")).orderBy("month"))


def q39_sales_weekday_pattern(wh: Warehouse) -> DataFrame:
    return (wh.fact.groupBy(F.col("purchase_dayofweek").cast("bigint").alias("purchase_dayofweek"))
            .agg(F.count(F.lit(1)).alias("order_count"), _mean("payment_value").alias("avg_value"))
            .orderBy("purchase_dayofweek"))


def q40_sales_seasonal_heatmap(wh: Warehouse) -> DataFrame:
    return wh.fact.groupBy(F.col("purchase_month").cast("bigint").alias("purchase_month"),
                           F.col("purchase_dayofweek").cast("bigint").alias("purchase_dayofweek")).agg(
        F.count(F.lit(1)).alias("cnt"))


def q41_sales_by_state(wh: Warehouse) -> DataFrame:
    return _sel(wh.mart("dws_state_summary"), "state", "total_orders", "total_gmv", "unique_customers",
                order=[F.col("total_gmv").desc(), "state"])


def q42_rfm_data(wh: Warehouse, ref_date: str = L.WAREHOUSE_RFM_DATE) -> DataFrame:
    """Warehouse RFM inputs: fixed reference date, item-weighted payment value."""
    f = wh.fact.where(F.col("customer_unique_id").isNotNull())
    r = rfm(f, "customer_unique_id", "order_id", "purchase_date", "payment_value", ref=ref_date)
    return r.select("customer_unique_id", F.col("recency").cast("bigint").alias("recency"), "frequency",
                    F.col("monetary").cast("double").alias("monetary"))


def q43_category_trend(wh: Warehouse) -> DataFrame:
    top = semi_top_n(wh.mart("dws_daily_category"), wh.mart("dws_category_summary"), "category_name",
                     [F.col("total_revenue").desc(), F.col("category_name")], 5)
    return _sel(top, "purchase_date", "category_name", "total_gmv", "total_orders",
                order=["purchase_date", "category_name"])


# -------------------------------------------------------------- S8 audit
def warehouse_layers(wh: Warehouse) -> dict[str, dict[str, DataFrame | None]]:
    """Every modelled table; a source that is absent is None (0 rows in the audit), and so is what needs it."""
    def has(*names):
        return all(n in wh.src for n in names)

    fact = wh.fact if "fact" in wh.__dict__ or has("orders", "order_items", "customers", "products", "sellers",
                                                   "product_category_translation", "order_payments", "order_reviews") else None
    return {
        "ODS": {f"ods_{t}": wh.src.get(t) for t in ("customers", "sellers", "products", "orders", "order_items",
                                                    "order_payments", "order_reviews")},
        "DWD": {"dim_customers": wh.dim_customers if fact is not None and has("customers", "orders") else None,
                "dim_products": wh.dim_products if has("products", "product_category_translation") else None,
                "dim_sellers": wh.dim_sellers if fact is not None and has("sellers") else None,
                "dim_dates": wh.dim_dates_for_orders() if has("orders") else None,
                "dwd_order_detail": wh.__dict__.get("full_fact", fact)},
        "DWS": {name: wh.mart(name) if name in wh.stored or fact is not None else None for name in wh.MARTS},
    }


def s8_warehouse_stats(wh: Warehouse) -> DataFrame:
    """(layer, table, rows) for every modelled table: counts of a stored warehouse's writing jobs where there are any,
    the others as one Spark job (a union of counts)."""
    from marketlens.sources.warehouse import audit_counts
    layers = warehouse_layers(wh)
    known = [(layer, t, wh.known_rows[t]) for layer, tables in layers.items() for t in tables if t in wh.known_rows]
    if not known:
        return audit_counts(layers)
    stored = wh.spark.createDataFrame(known, "layer string, table string, rows bigint")
    rest = {layer: {t: df for t, df in tables.items() if t not in wh.known_rows} for layer, tables in layers.items()}
    return stored.unionByName(audit_counts(rest)) if any(rest.values()) else stored


QUERIES = {
    "q22_overview_kpis": q22_overview_kpis,
    "q23_overview_gmv_trend": q23_overview_gmv_trend,
    "q24_delivery_distribution": q24_delivery_distribution,
    "q25_delivery_daily_trend": q25_delivery_daily_trend,
    "q26_delivery_by_state": q26_delivery_by_state,
    "q27_delivery_by_category": q27_delivery_by_category,
    "q28_delivery_heatmap": q28_delivery_heatmap,
    "q29_delayed_top_categories": q29_delayed_top_categories,
    "q30_category_abc": q30_category_abc,
    "q31_category_treemap": q31_category_treemap,
    "q32_category_sellers": q32_category_sellers,
    "q33_review_vs_delivery_sample": q33_review_vs_delivery_sample,
    "q34_review_by_delivery_bucket": q34_review_by_delivery_bucket,
    "q35_review_state_comparison": q35_review_state_comparison,
    "q36_correlation_sample": q36_correlation_sample,
    "q37_sales_trend": q37_sales_trend,
    "q38_sales_monthly": q38_sales_monthly,
    "q39_sales_weekday_pattern": q39_sales_weekday_pattern,
    "q40_sales_seasonal_heatmap": q40_sales_seasonal_heatmap,
    "q41_sales_by_state": q41_sales_by_state,
    "q42_rfm_data": q42_rfm_data,
    "q43_category_trend": q43_category_trend,
    "s8_warehouse_stats": s8_warehouse_stats,
}
