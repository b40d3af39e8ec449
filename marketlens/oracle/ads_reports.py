"""Oracle SQL for Q22-Q43 and S8 (DuckDB), over the mart CTEs."""

from __future__ import annotations

from marketlens.functions import labels as L
from marketlens.oracle import marts as _marts  # noqa: F401  (registers the mart CTEs)
from marketlens.oracle.prelude import DIV


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sample_order(keys, n: int = 5000, seed: int = 42) -> str:
    """Order by the MD5 of the seed and the key's text, and keep the first n."""
    text = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"ORDER BY md5(concat_ws('|', '{seed}', {text})), {', '.join(keys)} LIMIT {n}"


def D(c: str) -> str:
    return f"CAST({c} AS DOUBLE) AS {c}"


MEAN = lambda c: DIV(f"sum({c})", f"count({c})")
SCORED = "FROM fact WHERE delivery_days > 0 AND review_score IS NOT NULL AND delivery_days <= 60"
SAMPLE = sample_order(["order_id", "order_item_id"])
Q34 = " ".join(f"WHEN delivery_days <= {b} THEN {_q(lab)}" for b, lab in zip(L.Q34_BOUNDS, L.Q34_LABELS))

LAYERS = {
    "ODS": [("ods_customers", "s_customers"), ("ods_sellers", "s_sellers"), ("ods_products", "s_products"),
            ("ods_orders", "s_orders"), ("ods_order_items", "s_items"), ("ods_order_payments", "s_payments"),
            ("ods_order_reviews", "s_reviews")],
    "DWD": [("dim_customers", "(SELECT DISTINCT customer_unique_id FROM s_customers)"),
            ("dim_products", "dim_products"), ("dim_sellers", "s_sellers"),
            ("dim_dates", "(SELECT unnest(generate_series(make_date(min(year(order_purchase_timestamp)), 1, 1), "
                          "make_date(max(year(order_purchase_timestamp)), 12, 31), INTERVAL 1 DAY)) FROM s_orders)"),
            ("dwd_order_detail", "fact")],
    "DWS": [("dws_daily_metrics", "m_daily"), ("dws_daily_category", "m_daily_cat"),
            ("dws_daily_state", "m_daily_state"), ("dws_weekly_metrics", "m_weekly"),
            ("dws_category_summary", "m_category"), ("dws_state_summary", "m_state")],
}

SQL = {
    "q22_overview_kpis": f"""
        SELECT CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(total_gmv) AS DOUBLE) AS total_gmv,
               {MEAN('avg_delivery_days')} AS avg_delivery, {MEAN('delay_rate')} * 100.0 AS delay_rate_pct
        FROM m_daily""",
    "q23_overview_gmv_trend": """
        SELECT strftime(purchase_date, '%Y-%m') AS month, CAST(sum(total_gmv) AS DOUBLE) AS gmv,
               CAST(sum(total_orders) AS BIGINT) AS orders
        FROM m_daily GROUP BY 1 ORDER BY month""",
    "q24_delivery_distribution": """
        SELECT delivery_days, count(*) AS cnt FROM fact
        WHERE delivery_days > 0 AND delivery_days <= 60 AND delivered_date IS NOT NULL
        GROUP BY delivery_days ORDER BY delivery_days""",
    "q25_delivery_daily_trend": f"""
        SELECT purchase_date, {D('avg_delivery_days')}, {D('delay_rate')} FROM m_daily ORDER BY purchase_date""",
    "q26_delivery_by_state": f"""
        SELECT state, {D('avg_delivery_days')}, {D('delay_rate')}, total_orders FROM m_state
        ORDER BY avg_delivery_days DESC, state""",
    "q27_delivery_by_category": f"""
        SELECT category_name, {D('avg_delivery_days')}, {D('delay_rate')}, total_orders, {D('avg_review_score')}
        FROM m_category ORDER BY total_orders DESC, category_name""",
    "q28_delivery_heatmap": f"""
        SELECT purchase_date, category_name, {D('avg_delivery_days')} FROM m_daily_cat
        WHERE purchase_date IS NOT NULL""",
    "q29_delayed_top_categories": f"""
        SELECT category_name, {D('delay_rate')}, {D('avg_delay_days')}, total_orders FROM m_category
        WHERE total_orders > 100 ORDER BY m_category.delay_rate DESC, category_name LIMIT 10""",
    "q30_category_abc": f"""
        SELECT category_name, {D('total_revenue')}, {D('revenue_pct')}, {D('cumulative_pct')}, abc_class,
               total_orders, {D('avg_price')}, unique_sellers, {D('daily_avg_items')}
        FROM m_category ORDER BY m_category.total_revenue DESC, category_name""",
    "q31_category_treemap": f"""
        SELECT category_name, {D('total_revenue')}, total_orders, {D('avg_price')}, {D('cumulative_pct')}
        FROM m_category ORDER BY m_category.total_revenue DESC, category_name LIMIT 30""",
    "q32_category_sellers": f"""
        SELECT category_name, unique_sellers, total_orders, {D('total_revenue')}
        FROM m_category ORDER BY total_orders DESC, category_name""",
    "q33_review_vs_delivery_sample": f"""
        SELECT delivery_days, review_score, delay_days, is_delayed, {D('freight_value')}, {D('product_weight_g')}
        {SCORED} {SAMPLE}""",
    "q34_review_by_delivery_bucket": f"""
        SELECT CASE {Q34} ELSE {_q(L.Q34_ELSE)} END AS bucket, {MEAN('review_score')} AS avg_score, count(*) AS cnt
        FROM fact WHERE delivery_days > 0 AND review_score IS NOT NULL GROUP BY 1 ORDER BY min(delivery_days)""",
    "q35_review_state_comparison": f"""
        SELECT state, {D('avg_review_score')}, {D('avg_delivery_days')}, total_orders FROM m_state
        WHERE total_orders > 100 ORDER BY m_state.avg_review_score, state""",
    "q36_correlation_sample": f"""
        SELECT delivery_days, delay_days, review_score, {D('freight_value')}, {D('product_weight_g')}, {D('price')}
        {SCORED} {SAMPLE}""",
    "q37_sales_trend": f"""
        SELECT purchase_date, total_orders, {D('total_gmv')}, {D('avg_order_value')}, unique_customers
        FROM m_daily ORDER BY purchase_date""",
    "q38_sales_monthly": f"""
        SELECT strftime(purchase_date, '%Y-%m') AS month, CAST(sum(total_orders) AS BIGINT) AS orders,
               CAST(sum(total_gmv) AS DOUBLE) AS gmv, {MEAN('avg_order_value')} AS aov,
               CAST(sum(unique_customers) AS BIGINT) AS customers
        FROM m_daily GROUP BY 1 ORDER BY month""",
    "q39_sales_weekday_pattern": f"""
        SELECT CAST(purchase_dayofweek AS BIGINT) AS purchase_dayofweek, count(*) AS order_count,
               {MEAN('payment_value')} AS avg_value
        FROM fact GROUP BY 1 ORDER BY 1""",
    "q40_sales_seasonal_heatmap": """
        SELECT CAST(purchase_month AS BIGINT) AS purchase_month, CAST(purchase_dayofweek AS BIGINT) AS purchase_dayofweek,
               count(*) AS cnt
        FROM fact GROUP BY 1, 2""",
    "q41_sales_by_state": f"""
        SELECT state, total_orders, {D('total_gmv')}, unique_customers FROM m_state
        ORDER BY m_state.total_gmv DESC, state""",
    "q42_rfm_data": f"""
        SELECT customer_unique_id,
               CAST(date_diff('day', max(purchase_date), DATE '{L.WAREHOUSE_RFM_DATE}') AS BIGINT) AS recency,
               count(DISTINCT order_id) AS frequency, CAST(sum(payment_value) AS DOUBLE) AS monetary
        FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
    "q43_category_trend": f"""
        SELECT purchase_date, category_name, {D('total_gmv')}, total_orders FROM m_daily_cat
        WHERE category_name IN (SELECT category_name FROM m_category
                                ORDER BY total_revenue DESC, category_name LIMIT 5)
        ORDER BY purchase_date, category_name""",
    "s8_warehouse_stats": "\nUNION ALL\n".join(
        f"SELECT '{layer}' AS layer, '{name}' AS \"table\", count(*) AS rows FROM {src} x"
        for layer, tables in LAYERS.items() for name, src in tables),
}
