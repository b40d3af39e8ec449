"""Oracle SQL for the modelled tables and marts (DuckDB)."""

from __future__ import annotations

from marketlens.functions import labels as L
from marketlens.oracle import prelude
from marketlens.oracle.prelude import DIV, DQ, R


def DEC(expr: str, p: int, s: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), {s}) AS DECIMAL({p},{s}))"


POS = "CASE WHEN delivery_days > 0 THEN delivery_days END"


def MEAN(c: str, p: int, s: int, **kw) -> str:
    return DQ(f"sum({c})", f"count({c})", p, s, **kw)


COMMON = f"""{MEAN(POS, 6, 2)} AS avg_delivery_days, {MEAN('is_delayed', 6, 4)} AS delay_rate,
             {DEC('avg(review_score)', 4, 2)} AS avg_review_score"""
MWEEK = ("(CAST(floor((dayofyear(purchase_date) - 1 + (isodow(make_date(year(purchase_date), 1, 1)) - 1)) / 7) AS INTEGER)"
         " + CASE WHEN isodow(make_date(year(purchase_date), 1, 1)) - 1 <= 3 THEN 1 ELSE 0 END)")
A, B, C = L.ABC_MART_LABELS
LO, HI = L.ABC_FRACTION_BOUNDS

prelude.MART_CTES[:] = [
    ("m_daily", f"""
        SELECT purchase_date, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
               CAST(count(*) AS BIGINT) AS total_items, {DEC('sum(payment_value)', 38, 2)} AS total_gmv,
               {DEC('(SELECT sum(pv) FROM (SELECT max(payment_value) AS pv FROM fact f2 WHERE f2.purchase_date = fact.purchase_date GROUP BY f2.order_id) o)', 38, 2)} AS total_gmv_order_level,
               {DEC('sum(price)', 38, 2)} AS total_revenue, {DEC('sum(freight_value)', 38, 2)} AS total_freight,
               {DQ('sum(payment_value)', 'count(DISTINCT order_id)', 10, 2, ns=2)} AS avg_order_value,
               CAST(count(DISTINCT CASE WHEN delivered_date IS NOT NULL THEN order_id END) AS BIGINT) AS delivered_orders,
               {COMMON},
               {MEAN('CASE WHEN is_delayed = 1 THEN delay_days END', 6, 2)} AS avg_delay_days,
               CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS unique_customers,
               CAST(count(DISTINCT seller_id) AS BIGINT) AS unique_sellers
        FROM fact GROUP BY purchase_date"""),
    ("m_daily_cat", f"""
        SELECT purchase_date, category_name, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
               {DEC('sum(payment_value)', 38, 2)} AS total_gmv, {DEC('sum(price)', 38, 2)} AS total_revenue,
               {MEAN('price', 10, 2, ns=2)} AS avg_price, {COMMON}
        FROM fact WHERE category_name IS NOT NULL AND category_name <> ''
        GROUP BY purchase_date, category_name"""),
    ("m_daily_state", f"""
        SELECT purchase_date, customer_state AS state, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
               {DEC('sum(payment_value)', 38, 2)} AS total_gmv, {COMMON}
        FROM fact WHERE customer_state IS NOT NULL GROUP BY purchase_date, customer_state"""),
    ("m_weekly", f"""
        SELECT CAST(year(min(purchase_date)) AS VARCHAR) || '-W' ||
                   lpad(CAST({MWEEK.replace('purchase_date', 'min(purchase_date)')} AS VARCHAR), 2, '0') AS year_week,
               min(purchase_date) AS week_start_date, max(purchase_date) AS week_end_date,
               CAST(sum(total_orders) AS BIGINT) AS total_orders, {DEC('sum(total_gmv)', 38, 2)} AS total_gmv,
               {DQ('sum(total_orders)', '7', 20, 1)} AS avg_daily_orders,
               {MEAN('avg_delivery_days', 6, 2, ns=2)} AS avg_delivery_days,
               {MEAN('delay_rate', 6, 4, ns=4)} AS delay_rate,
               {MEAN('avg_review_score', 4, 2, ns=2)} AS avg_review_score
        FROM m_daily GROUP BY year(purchase_date), {MWEEK}"""),
    ("m_category_base", f"""
        SELECT category_name, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
               {DEC('sum(payment_value)', 38, 2)} AS total_gmv, sum(price) AS rev,
               {MEAN('price', 10, 2, ns=2)} AS avg_price, {COMMON},
               {MEAN('CASE WHEN is_delayed = 1 THEN delay_days END', 6, 2)} AS avg_delay_days,
               CAST(count(DISTINCT seller_id) AS BIGINT) AS unique_sellers,
               {DQ('count(*)', "date_diff('day', min(purchase_date), max(purchase_date))", 20, 1)} AS daily_avg_items
        FROM fact WHERE category_name IS NOT NULL AND category_name <> '' GROUP BY category_name"""),
    ("m_category_pct", f"""
        SELECT *, {DEC('total_revenue_x', 38, 2)} AS total_revenue,
               {DQ('rev', 'sum(rev) OVER ()', 6, 4, ns=2, ds=2)} AS revenue_pct,
               {DQ('sum(rev) OVER (ORDER BY rev DESC, category_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'sum(rev) OVER ()', 6, 4, ns=2, ds=2)} AS cumulative_pct
        FROM (SELECT *, rev AS total_revenue_x FROM m_category_base) b"""),
    ("m_category", f"""
        SELECT category_name, total_orders, total_gmv, total_revenue, avg_price, avg_delivery_days, delay_rate,
               avg_review_score, revenue_pct, cumulative_pct,
               CASE WHEN cumulative_pct <= {LO} THEN '{A}' WHEN cumulative_pct <= {HI} THEN '{B}' ELSE '{C}' END
                   AS abc_class,
               unique_sellers, daily_avg_items, avg_delay_days
        FROM m_category_pct"""),
    ("m_state", f"""
        SELECT customer_state AS state, CAST(count(DISTINCT order_id) AS BIGINT) AS total_orders,
               {DEC('sum(payment_value)', 38, 2)} AS total_gmv, {COMMON},
               CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS unique_customers
        FROM fact WHERE customer_state IS NOT NULL GROUP BY customer_state"""),
]


def DBL(table: str, cols: str) -> str:
    """SELECT with every listed decimal column cast to DOUBLE."""
    return cols


def _dbl_all(table: str) -> str:
    return f"SELECT * REPLACE ({{}}) FROM {table}"


CSV_COMMON = f"""{DIV('sum(delivery_time_days)', 'count(delivery_time_days)')} AS avg_delivery_days,
                 {R('avg(is_delayed) * 100.0', 1)} AS delay_rate"""

SQL = {
    "d5_order_detail": """
        SELECT * REPLACE (CAST(product_weight_g AS DOUBLE) AS product_weight_g, CAST(price AS DOUBLE) AS price,
                          CAST(freight_value AS DOUBLE) AS freight_value, CAST(payment_value AS DOUBLE) AS payment_value)
        FROM fact""",
    "d2_dim_customers": """
        SELECT b.*, CAST(COALESCE(n.n, 0) AS BIGINT) AS total_orders FROM (
            SELECT c.customer_unique_id, max(c.customer_state) AS customer_state, max(c.customer_city) AS customer_city,
                   max(c.customer_zip_code_prefix) AS customer_zip_prefix,
                   min(CAST(o.order_purchase_timestamp AS DATE)) AS first_purchase_date
            FROM s_customers c LEFT JOIN s_orders o ON c.customer_id = o.customer_id
            GROUP BY c.customer_unique_id) b
        LEFT JOIN (SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM fact GROUP BY customer_unique_id) n
            ON b.customer_unique_id = n.customer_unique_id""",
    "d3_dim_products": """
        SELECT * REPLACE (CAST(product_weight_g AS DOUBLE) AS product_weight_g,
                          CAST(product_length_cm AS DOUBLE) AS product_length_cm,
                          CAST(product_height_cm AS DOUBLE) AS product_height_cm,
                          CAST(product_width_cm AS DOUBLE) AS product_width_cm,
                          CAST(product_volume_cm3 AS DOUBLE) AS product_volume_cm3)
        FROM dim_products""",
    "d4_dim_sellers": """
        SELECT s.seller_id, s.seller_state, s.seller_city, lpad(CAST(sp.s_nationkey AS VARCHAR), 5, '0') AS seller_zip_prefix,
               CAST(COALESCE(a.n, 0) AS BIGINT) AS total_orders, CAST(COALESCE(a.rev, 0) AS DOUBLE) AS total_revenue
        FROM s_sellers s JOIN supplier sp ON s.seller_id = sp.s_suppkey
        LEFT JOIN (SELECT seller_id, count(*) AS n, sum(price) AS rev FROM fact GROUP BY seller_id) a
            ON s.seller_id = a.seller_id""",
    "d1_dim_dates": """
        SELECT d AS date_id, year(d) AS year, quarter(d) AS quarter, month(d) AS month, monthname(d) AS month_name,
               weekofyear(d) AS week_of_year, day(d) AS day_of_month, isodow(d) AS day_of_week,
               dayname(d) AS day_name, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               strftime(d, '%Y-%m') AS year_month
        FROM (SELECT CAST(unnest(generate_series(make_date(min(year(order_purchase_timestamp)), 1, 1),
                                                 make_date(max(year(order_purchase_timestamp)), 12, 31),
                                                 INTERVAL 1 DAY)) AS DATE) AS d FROM s_orders) x""",
    "m10_order_full": """
        SELECT * REPLACE (CAST(product_weight_g AS DOUBLE) AS product_weight_g, CAST(price AS DOUBLE) AS price,
                          CAST(freight_value AS DOUBLE) AS freight_value, CAST(payment_value AS DOUBLE) AS payment_value)
        FROM v_order_full""",
    "m1_daily_metrics": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv, CAST(total_revenue AS DOUBLE) AS total_revenue,
            CAST(total_gmv_order_level AS DOUBLE) AS total_gmv_order_level, CAST(total_freight AS DOUBLE) AS total_freight, CAST(avg_order_value AS DOUBLE) AS avg_order_value,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_delay_days AS DOUBLE) AS avg_delay_days, CAST(avg_review_score AS DOUBLE) AS avg_review_score)
        FROM m_daily""",
    "m2_daily_category": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv, CAST(total_revenue AS DOUBLE) AS total_revenue,
            CAST(avg_price AS DOUBLE) AS avg_price,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_review_score AS DOUBLE) AS avg_review_score)
        FROM m_daily_cat""",
    "m3_daily_state": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_review_score AS DOUBLE) AS avg_review_score)
        FROM m_daily_state""",
    "m4_weekly_metrics": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv, CAST(avg_daily_orders AS DOUBLE) AS avg_daily_orders,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_review_score AS DOUBLE) AS avg_review_score)
        FROM m_weekly""",
    "m5_category_summary": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv, CAST(total_revenue AS DOUBLE) AS total_revenue,
            CAST(avg_price AS DOUBLE) AS avg_price,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_review_score AS DOUBLE) AS avg_review_score, CAST(revenue_pct AS DOUBLE) AS revenue_pct,
            CAST(cumulative_pct AS DOUBLE) AS cumulative_pct, CAST(daily_avg_items AS DOUBLE) AS daily_avg_items,
            CAST(avg_delay_days AS DOUBLE) AS avg_delay_days)
        FROM m_category""",
    "m6_state_summary": """
        SELECT * REPLACE (CAST(total_gmv AS DOUBLE) AS total_gmv,
            CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, CAST(delay_rate AS DOUBLE) AS delay_rate,
            CAST(avg_review_score AS DOUBLE) AS avg_review_score)
        FROM m_state""",
    "m7_seller_summary": f"""
        SELECT seller_id, count(DISTINCT order_id) AS total_orders,
               CAST(COALESCE(sum(price), 0) AS DOUBLE) AS total_revenue, {CSV_COMMON},
               {DIV('sum(freight_value)', 'count(freight_value)')} AS avg_freight,
               min(seller_city) AS seller_city, min(seller_state) AS seller_state
        FROM D WHERE seller_id IS NOT NULL GROUP BY seller_id""",
    "m8_csv_category_summary": f"""
        SELECT category_name, count(DISTINCT order_id) AS total_orders,
               CAST(COALESCE(sum(price), 0) AS DOUBLE) AS total_revenue,
               {DIV('sum(price)', 'count(price)')} AS avg_price, {CSV_COMMON},
               count(DISTINCT product_id) AS unique_products, count(DISTINCT seller_id) AS unique_sellers
        FROM D WHERE category_name IS NOT NULL GROUP BY category_name""",
    "m9_monthly_summary": f"""
        SELECT purchase_year_month, count(DISTINCT order_id) AS total_orders,
               CAST(COALESCE(sum(price), 0) AS DOUBLE) AS total_revenue, {CSV_COMMON},
               count(DISTINCT customer_unique_id) AS unique_customers
        FROM D WHERE purchase_year_month IS NOT NULL GROUP BY purchase_year_month""",
    "m_distinct_by_month": """
        SELECT strftime(purchase_date, '%Y-%m') AS purchase_year_month, count(DISTINCT customer_unique_id) AS unique_customers,
               count(DISTINCT seller_id) AS unique_sellers
        FROM fact GROUP BY 1""",
    "m_distinct_by_week": f"""
        SELECT CAST(year(purchase_date) AS INTEGER) AS purchase_year, CAST({MWEEK} AS INTEGER) AS purchase_week,
               count(DISTINCT customer_unique_id) AS unique_customers, count(DISTINCT seller_id) AS unique_sellers
        FROM fact GROUP BY 1, 2""",
    "m_distinct_by_state": """
        SELECT customer_state, count(DISTINCT customer_unique_id) AS unique_customers
        FROM fact WHERE customer_state IS NOT NULL GROUP BY customer_state""",
}
