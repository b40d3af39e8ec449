"""Oracle SQL for R1-R31 (DuckDB) over the CSV-population CTE ``D``."""

from __future__ import annotations

from marketlens.functions import labels as L
from marketlens.oracle import marts as _marts  # noqa: F401
from marketlens.oracle.marts import SQL as MART_SQL
from marketlens.oracle.prelude import DIV, QR, R
from marketlens.plans.py_reports import CORR_COLUMNS, STAT_PLACES

P = STAT_PLACES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def MEAN(c: str) -> str:
    return DIV(f"sum({c})", f"count({c})")


def PSUM(c: str) -> str:
    return f"CAST(COALESCE(sum({c}), 0) AS DOUBLE)"


LATE = f"{MEAN('is_delayed')} * 100.0"
SPAN = "(SELECT CAST(floor(date_diff('second', min(order_purchase_timestamp), max(order_purchase_timestamp)) / 86400) AS BIGINT) FROM D)"
M8 = f"({MART_SQL['m8_csv_category_summary']})"
M9 = f"({MART_SQL['m9_monthly_summary']})"


def TOP(measure: str, n: int) -> str:
    return f"(SELECT * FROM {M8} c ORDER BY {measure} DESC, category_name LIMIT {n})"


def SHARE_EQ(c: str, v) -> str:
    return f"avg(CASE WHEN {c} = {v} THEN 1 ELSE 0 END) * 100.0"


def BOX(c: str) -> str:
    return (f"count({c}) AS n, {R(f'quantile_cont({c}, 0.25)', P)} AS q1, {R(f'quantile_cont({c}, 0.5)', P)} AS median, "
            f"{R(f'quantile_cont({c}, 0.75)', P)} AS q3, {R(f'avg({c})', P)} AS mean, "
            f"{R(f'stddev_samp({c})', P)} AS sd, {R(f'min({c})', P)} AS min, {R(f'max({c})', P)} AS max")


def BIN(col: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {col} > {edges[i]} AND {col} <= {edges[i + 1]} THEN {_q(labels[i])}"
                     for i in range(len(edges) - 1))
    return f"CASE {parts} END"


MODEL = """(SELECT regr_count(review_score, delivery_time_days) AS n,
                   regr_slope(review_score, delivery_time_days) AS slope,
                   regr_intercept(review_score, delivery_time_days) AS intercept,
                   corr(delivery_time_days, review_score) AS r,
                   var_samp(delivery_time_days) AS vx, var_samp(review_score) AS vy,
                   min(delivery_time_days) AS x_min, max(delivery_time_days) AS x_max
            FROM D WHERE delivery_time_days IS NOT NULL AND review_score IS NOT NULL)"""
STDERR = "CASE WHEN n > 2 THEN sqrt((1.0 - r * r) * vy / vx / (n - 2)) END"
R24_LABELS = [f"({L.R24_EDGES[i]}, {L.R24_EDGES[i + 1]}]" for i in range(len(L.R24_EDGES) - 1)]
DOW = " ".join(f"WHEN {i} THEN {_q(n)}" for i, n in enumerate(L.DOW_MON0_NAMES))
MON = " ".join(f"WHEN {i + 1} THEN {_q(n)}" for i, n in enumerate(L.MONTH_NAMES))
RFM_SEG = (f"CASE WHEN t >= {L.RFM_BOUNDS[0]} THEN {_q(L.RFM_LABELS[0])} "
           f"WHEN t >= {L.RFM_BOUNDS[1]} THEN {_q(L.RFM_LABELS[1])} "
           f"WHEN t >= {L.RFM_BOUNDS[2]} THEN {_q(L.RFM_LABELS[2])} ELSE {_q(L.RFM_LABELS[3])} END")
GEO = "(SELECT state, state AS state_name, region FROM s_geo)"

SQL = {
    "r01_overview_kpis": f"""
        SELECT count(DISTINCT order_id) AS total_orders, {PSUM('price')} AS total_gmv,
               {MEAN('delivery_time_days')} AS avg_delivery, {LATE} AS delay_rate,
               count(DISTINCT customer_unique_id) AS customers, count(DISTINCT seller_id) AS sellers,
               strftime(min(order_purchase_timestamp), '%Y-%m') AS first_month,
               strftime(max(order_purchase_timestamp), '%Y-%m') AS last_month
        FROM D""",
    "r01_overview_from_monthly": f"""
        SELECT CAST(coalesce(sum(total_orders), 0) AS BIGINT) AS total_orders, coalesce(sum(total_revenue), 0.0) AS total_gmv,
               avg(avg_delivery_days) AS avg_delivery, avg(delay_rate) AS delay_rate,
               CAST(coalesce(sum(unique_customers), 0) AS BIGINT) AS customers, 0 AS sellers,
               CAST(NULL AS VARCHAR) AS first_month, CAST(NULL AS VARCHAR) AS last_month
        FROM {M9} m""",
    "r02_data_summary": f"""
        SELECT count(DISTINCT order_id) AS orders, {PSUM('price')} AS revenue,
               count(DISTINCT category_name) AS categories, count(DISTINCT seller_id) AS sellers,
               count(DISTINCT customer_unique_id) AS customers, {MEAN('delivery_time_days')} AS avg_delivery_days,
               {LATE} AS delay_rate_pct, CAST(min(order_purchase_timestamp) AS DATE) AS min_date,
               CAST(max(order_purchase_timestamp) AS DATE) AS max_date
        FROM D""",
    "r03_delivery_kpis": f"""
        SELECT count(*) AS rows, {MEAN('delivery_time_days')} AS avg_delivery,
               {R('quantile_cont(delivery_time_days, 0.5)', P)} AS median_delivery, {LATE} AS delay_rate_pct,
               {MEAN('CASE WHEN is_delayed = 1 THEN delay_days END')} AS avg_delay_days,
               {R('quantile_cont(delivery_time_days, 0.95)', P)} AS p95_delivery
        FROM D""",
    "r04_delivery_histogram": """
        SELECT bin, count(*) AS n, 0.0 + bin * 1.5 AS bin_lo, 0.0 + (bin + 1) * 1.5 AS bin_hi FROM (
            SELECT CAST(least(floor((CAST(delivery_time_days AS DOUBLE) - 0.0) / 1.5), 39) AS INTEGER) AS bin
            FROM D WHERE delivery_time_days BETWEEN 0 AND 60) x
        GROUP BY bin""",
    "r04_delivery_box": f"""
        SELECT {BOX('CAST(delivery_time_days AS DOUBLE)')} FROM D WHERE delivery_time_days BETWEEN 0 AND 60""",
    "r05_monthly_delivery": f"SELECT purchase_year_month, avg_delivery_days, delay_rate FROM {M9} m",
    "r06_delivery_by_state": f"""
        SELECT customer_state, {MEAN('delivery_time_days')} AS avg_delivery, {R(LATE, 1)} AS delay_rate,
               count(DISTINCT order_id) AS order_count
        FROM D WHERE customer_state IS NOT NULL GROUP BY customer_state
        HAVING count(DISTINCT order_id) >= 50""",
    "r07_delivery_by_category": f"""
        SELECT category_name, avg_delivery_days, delay_rate, total_orders,
               (SELECT {LATE} FROM D) AS overall_delay_pct
        FROM {TOP('total_orders', 15)} t""",
    "r08_delivery_heatmap": f"""
        SELECT category_name, purchase_year_month, {MEAN('delivery_time_days')} AS avg_delivery_days
        FROM D WHERE category_name IN (SELECT category_name FROM {TOP('total_orders', 12)} t)
          AND purchase_year_month IS NOT NULL
        GROUP BY category_name, purchase_year_month HAVING count(delivery_time_days) > 0""",
    "r09_delay_days_distribution": """
        SELECT delay_days, count(*) AS n FROM D WHERE is_delayed = 1 AND delay_days IS NOT NULL AND delay_days <= 30
        GROUP BY delay_days""",
    "r10_most_late_categories": f"""
        SELECT category_name, count(DISTINCT order_id) AS delay_count, {MEAN('delay_days')} AS avg_delay
        FROM D WHERE is_delayed = 1 AND category_name IS NOT NULL GROUP BY category_name
        ORDER BY delay_count DESC, category_name LIMIT 10""",
    "r11_inventory_kpis": f"""
        SELECT (SELECT count(*) FROM {M8} c) AS categories,
               {R(f"(SELECT sum(total_revenue) FROM {TOP('total_revenue', 3)} t) / (SELECT sum(total_revenue) FROM {M8} c) * 100.0", P)} AS top3_share_pct,
               {DIV('count(*)', f'greatest({SPAN}, 1)')} AS daily_orders,
               (SELECT avg(k) FROM (SELECT seller_id, count(DISTINCT category_name) AS k FROM D
                                    WHERE seller_id IS NOT NULL GROUP BY seller_id) s) AS avg_categories_per_seller,
               (SELECT avg(unique_sellers) FROM {M8} c) AS avg_sellers_per_category,
               count(DISTINCT product_id) AS products
        FROM D""",
    "r12_category_treemap": f"""
        SELECT category_name, total_revenue, delay_rate, total_orders, avg_price, avg_delivery_days
        FROM {TOP('total_revenue', 30)} t""",
    "r13_sales_velocity": f"""
        SELECT category_name, count(DISTINCT order_id) AS total_sales, {PSUM('price')} AS total_revenue,
               {DIV('count(DISTINCT order_id)', f'greatest({SPAN}, 1)')} AS daily_sales,
               {DIV(PSUM('price'), f'greatest({SPAN}, 1)')} AS daily_revenue
        FROM D WHERE category_name IS NOT NULL GROUP BY category_name
        ORDER BY daily_sales DESC, category_name LIMIT 20""",
    "r14_abc_curve": f"""
        SELECT category_name, total_revenue, cum_pct, rank,
               CASE WHEN cum_pct <= {L.ABC_PCT_BOUNDS[0]} THEN 'A' WHEN cum_pct <= {L.ABC_PCT_BOUNDS[1]} THEN 'B'
                    ELSE 'C' END AS abc_class
        FROM (SELECT category_name, total_revenue,
                     {R('CAST(sum(total_revenue) OVER (ORDER BY total_revenue DESC, category_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(total_revenue) OVER () AS DOUBLE) * 100.0', P)} AS cum_pct,
                     CAST(row_number() OVER (ORDER BY total_revenue DESC, category_name) AS INTEGER) AS rank
              FROM {M8} c) x""",
    "r15_seller_category_distribution": """
        SELECT num_categories, count(*) AS sellers FROM (
            SELECT seller_id, count(DISTINCT category_name) AS num_categories FROM D
            WHERE seller_id IS NOT NULL GROUP BY seller_id) s
        GROUP BY num_categories ORDER BY num_categories LIMIT 15""",
    "r15_category_competition": f"""
        SELECT category_name, unique_sellers AS sellers FROM {TOP('unique_sellers', 15)} t""",
    "r16_top8_monthly_dynamics": f"""
        SELECT purchase_year_month, category_name, {PSUM('price')} AS revenue, count(DISTINCT order_id) AS orders
        FROM D WHERE purchase_year_month IS NOT NULL
          AND category_name IN (SELECT category_name FROM {TOP('total_revenue', 8)} t)
        GROUP BY purchase_year_month, category_name""",
    "r17_category_detail": f"""
        SELECT category_name, total_orders, {R('total_revenue', 0)} AS total_revenue, {R('avg_price', 2)} AS avg_price,
               {R('avg_delivery_days', 1)} AS avg_delivery_days, delay_rate, unique_products, unique_sellers
        FROM {M8} c""",
    "r18_satisfaction_kpis": f"""
        SELECT {MEAN('review_score')} AS avg_score, {SHARE_EQ('review_score', 5)} AS score_5_pct,
               {SHARE_EQ('review_score', 1)} AS score_1_pct,
               {MEAN('CASE WHEN is_delayed = 0 THEN review_score END')} AS on_time_score,
               {MEAN('CASE WHEN is_delayed = 1 THEN review_score END')} AS delayed_score,
               {MEAN('CASE WHEN is_delayed = 0 THEN review_score END')} - {MEAN('CASE WHEN is_delayed = 1 THEN review_score END')} AS score_gap
        FROM D""",
    "r19_score_distribution": """
        SELECT review_score, count(*) AS n FROM D WHERE review_score IS NOT NULL GROUP BY review_score""",
    "r20_score_box_by_delay": f"""
        SELECT is_delayed, {BOX('CAST(review_score AS DOUBLE)')} FROM D WHERE review_score IS NOT NULL
        GROUP BY is_delayed""",
    "r20_regression": f"""
        SELECT n, {R('slope', P)} AS slope, {R('intercept', P)} AS intercept, {R('r', P)} AS r,
               {R(STDERR, P)} AS stderr, CAST(x_min AS DOUBLE) AS x_min, CAST(x_max AS DOUBLE) AS x_max,
               CASE WHEN r < {L.VERDICT_R_BOUND} THEN {_q(L.VERDICT_NEGATIVE)} ELSE {_q(L.VERDICT_WEAK)} END AS verdict
        FROM {MODEL} m""",
    # Student t, two-sided: midpoint integration of cos(x)^(v-1) over the tail and over the whole
    "r20_regression_pvalue": f"""
        WITH m AS (SELECT n, r, CAST(n - 2 AS DOUBLE) AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM {MODEL} q),
             cut AS (SELECT *, atan(t / sqrt(v)) AS a, least(pi() / 2, atan(t / sqrt(v)) + 40 / sqrt(v)) AS b,
                            least(pi() / 2, 40 / sqrt(v)) AS c FROM m)
        SELECT n, {R('r', P)} AS r, {R("""
                 ((b - a) * list_sum(list_transform(range(0, 20000), lambda i: exp((v - 1) * ln(cos(a + (b - a) * (i + 0.5) / 20000))))))
               / (c * list_sum(list_transform(range(0, 20000), lambda i: exp((v - 1) * ln(cos(c * (i + 0.5) / 20000))))))""", P)} AS p_value
        FROM cut""",
    "r20_trend_line": f"""
        SELECT i AS point, {R('x_min + (x_max - x_min) * i / 99', P)} AS x,
               {R('slope * (x_min + (x_max - x_min) * i / 99) + intercept', P)} AS y
        FROM range(100) t(i), {MODEL} m""",
    "r21_satisfaction_by_state": f"""
        SELECT customer_state, {MEAN('review_score')} AS avg_score, {SHARE_EQ('review_score', 5)} AS score_5_rate,
               {MEAN('is_delayed')} AS delay_rate, count(DISTINCT order_id) AS order_count
        FROM D WHERE customer_state IS NOT NULL GROUP BY customer_state HAVING count(DISTINCT order_id) >= 50""",
    "r22_score_by_day_bins": f"""
        SELECT b.delivery_range, a.avg_score, COALESCE(a.order_count, 0) AS order_count
        FROM (SELECT * FROM (VALUES {', '.join(f"({i}, {_q(x)})" for i, x in enumerate(L.R22_LABELS))}) v(bin_ord, delivery_range)) b
        LEFT JOIN (SELECT {BIN('delivery_time_days', L.R22_EDGES, L.R22_LABELS)} AS delivery_range,
                          {MEAN('review_score')} AS avg_score, count(DISTINCT order_id) AS order_count
                   FROM D GROUP BY 1) a ON a.delivery_range = b.delivery_range
        ORDER BY b.bin_ord""",
    "r23_correlation_matrix": "\nUNION ALL\n".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, "
        + (f"CASE WHEN min({a}) = max({a}) THEN CAST('NaN' AS DOUBLE) WHEN count(*) > 0 THEN 1.0 END" if a == b
           else R(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))", P))
        + " AS r FROM (SELECT * FROM D WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CORR_COLUMNS) + ") x"
        for a in CORR_COLUMNS for b in CORR_COLUMNS),
    "r24_insights": f"""
        WITH bins AS (SELECT {BIN('delivery_time_days', L.R24_EDGES, R24_LABELS)} AS b,
                             {MEAN('review_score')} AS s FROM D GROUP BY 1 HAVING b IS NOT NULL),
             ord AS (SELECT *, CASE b {' '.join(f"WHEN {_q(x)} THEN {i + 1}" for i, x in enumerate(R24_LABELS))} END AS o FROM bins),
             st AS (SELECT customer_state, {MEAN('review_score')} AS s FROM D WHERE customer_state IS NOT NULL
                    GROUP BY customer_state HAVING count(review_score) > 0)
        SELECT (SELECT {R('slope', P)} FROM {MODEL} m) AS score_change_per_day,
               (SELECT b FROM ord ORDER BY s DESC NULLS LAST, o LIMIT 1) AS best_bin,
               (SELECT max(s) FROM ord) AS best_bin_score,
               (SELECT customer_state FROM st ORDER BY s DESC, customer_state DESC LIMIT 1) AS best_state,
               (SELECT max(s) FROM st) AS best_state_score,
               (SELECT customer_state FROM st ORDER BY s ASC, customer_state ASC LIMIT 1) AS worst_state,
               (SELECT min(s) FROM st) AS worst_state_score""",
    "r25_sales_kpis": f"""
        WITH m AS (SELECT purchase_year_month, total_revenue,
                          lag(total_revenue) OVER (ORDER BY purchase_year_month) AS prev,
                          row_number() OVER (ORDER BY purchase_year_month DESC) AS rk FROM {M9} x)
        SELECT {PSUM('price')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
               {DIV('COALESCE(sum(price), 0)', 'count(DISTINCT order_id)')} AS avg_order_value,
               count(DISTINCT customer_unique_id) AS customers,
               {R("COALESCE((SELECT CASE WHEN prev IS NULL OR prev <= 0 THEN 0.0 ELSE (total_revenue - prev) / prev * 100.0 END FROM m WHERE rk = 1), 0.0)", P)} AS mom_growth_pct,
               {R('quantile_cont(CAST(price AS DOUBLE), 0.5)', P)} AS median_price
        FROM D""",
    "r26_revenue_trend": f"SELECT purchase_year_month, total_revenue, total_orders FROM {M9} m",
    "r27_weekday_pattern": f"""
        SELECT purchase_dayofweek, count(DISTINCT order_id) AS orders, {PSUM('price')} AS revenue,
               CASE purchase_dayofweek {DOW} END AS day_name
        FROM D WHERE purchase_dayofweek IS NOT NULL GROUP BY purchase_dayofweek""",
    "r27_month_pattern": f"""
        SELECT purchase_month, count(DISTINCT order_id) AS orders, {PSUM('price')} AS revenue,
               CASE purchase_month {MON} END AS month_name
        FROM D WHERE purchase_month IS NOT NULL GROUP BY purchase_month""",
    "r28_geo_sales": f"""
        SELECT g.customer_state, s.state_name, COALESCE(s.region, '{L.UNKNOWN_REGION}') AS region,
               g.orders, g.revenue, g.avg_score
        FROM (SELECT customer_state, count(DISTINCT order_id) AS orders, {PSUM('price')} AS revenue,
                     {MEAN('review_score')} AS avg_score
              FROM D WHERE customer_state IS NOT NULL GROUP BY customer_state) g
        LEFT JOIN {GEO} s ON g.customer_state = s.state""",
    "r29_top5_share_of_all": f"""
        SELECT p.purchase_year_month, p.category_name, p.revenue, t.total_revenue,
               {DIV('p.revenue', 't.total_revenue')} * 100.0 AS share
        FROM (SELECT purchase_year_month, category_name, {PSUM('price')} AS revenue FROM D
              WHERE purchase_year_month IS NOT NULL
                AND category_name IN (SELECT category_name FROM {TOP('total_revenue', 5)} t)
              GROUP BY 1, 2) p
        JOIN (SELECT purchase_year_month, {PSUM('price')} AS total_revenue FROM D
              WHERE purchase_year_month IS NOT NULL GROUP BY 1) t
          ON p.purchase_year_month = t.purchase_year_month""",
    "r30_order_status_funnel": """
        SELECT order_status, n,
               CASE WHEN lag(n) OVER (ORDER BY n DESC, order_status) IS NULL THEN 100.0
                    ELSE CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY n DESC, order_status) * 100.0 END AS pct_previous
        FROM (SELECT order_status, count(*) AS n FROM s_orders WHERE order_status IS NOT NULL
              GROUP BY order_status) x""",
    "r31_rfm_fractional": f"""
        WITH person AS (FROM V SELECT customer_unique_id AS id,
                          date_diff('second', max(order_purchase_timestamp), (SELECT max(order_purchase_timestamp) FROM V)) / 86400.0 AS days,
                          count(DISTINCT order_id) AS orders, sum(price) AS spent GROUP BY customer_unique_id),
             point AS (FROM person SELECT spent, ntile(4) OVER (ORDER BY days DESC NULLS LAST, id NULLS FIRST)
                          + ntile(4) OVER (ORDER BY orders NULLS FIRST, id NULLS FIRST) + ntile(4) OVER (ORDER BY spent NULLS FIRST, id NULLS FIRST) AS t)
        SELECT CASE WHEN t >= {L.RFM_BOUNDS[0]} THEN {_q(L.RFM_LABELS[0])} WHEN t >= {L.RFM_BOUNDS[1]} THEN {_q(L.RFM_LABELS[1])}
                    WHEN t >= {L.RFM_BOUNDS[2]} THEN {_q(L.RFM_LABELS[2])} ELSE {_q(L.RFM_LABELS[3])} END AS segment,
               count(*) AS customer_count, {R(DIV('sum(spent)', 'count(spent)'), 0)} AS avg_lifetime_value,
               {QR('count(*)', '(SELECT count(*) FROM person)', 1, mult=100)} AS pct
        FROM point GROUP BY segment""",
    "r31_rfm_segments": f"""
        WITH base AS (
            SELECT customer_unique_id,
                   CAST(floor(date_diff('second', max(order_purchase_timestamp),
                        (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY FROM D)) / 86400) AS INTEGER) AS recency,
                   count(DISTINCT order_id) AS frequency, COALESCE(sum(price), 0) AS monetary
            FROM D GROUP BY customer_unique_id),
        edges AS (SELECT quantile_cont(CAST(recency AS DOUBLE), [0.25, 0.5, 0.75]) AS e FROM base),
        ranked AS (
            SELECT b.*, e,
                   row_number() OVER (ORDER BY frequency ASC NULLS FIRST, customer_unique_id ASC NULLS FIRST) AS rf,
                   row_number() OVER (ORDER BY monetary ASC NULLS FIRST, customer_unique_id ASC NULLS FIRST) AS rm,
                   count(*) OVER () AS n
            FROM base b, edges),
        scored AS (
            SELECT *,
                   CASE WHEN recency <= e[1] THEN 4 WHEN recency <= e[2] THEN 3 WHEN recency <= e[3] THEN 2 ELSE 1 END AS r_score,
                   CASE WHEN n = 1 THEN 1 ELSE greatest(1, CAST(ceil(4 * (rf - 1) / (n - 1)) AS INTEGER)) END AS f_score,
                   CASE WHEN n = 1 THEN 1 ELSE greatest(1, CAST(ceil(4 * (rm - 1) / (n - 1)) AS INTEGER)) END AS m_score
            FROM ranked),
        seg AS (SELECT *, {RFM_SEG.replace('t >=', '(r_score + f_score + m_score) >=')} AS segment FROM scored)
        SELECT segment, count(*) AS customers, {DIV('sum(monetary)', 'count(monetary)')} AS avg_monetary,
               {QR('count(*)', 'sum(count(*)) OVER ()', P, mult=100)} AS pct
        FROM seg GROUP BY segment""",
}

SQL["r14_abc_counts"] = f"SELECT abc_class, count(*) AS n FROM ({SQL['r14_abc_curve']}) x GROUP BY abc_class"


# The dashboard frame in warehouse mode: the fact under the reports' names, with sizes.
_WAREHOUSE_D = """
    SELECT f.* EXCLUDE (purchase_dayofweek), delivery_days AS delivery_time_days, purchase_timestamp AS order_purchase_timestamp,
           isodow(purchase_date) - 1 AS purchase_dayofweek, product_length_cm, product_height_cm, product_width_cm
    FROM fact f LEFT JOIN (SELECT product_id, product_length_cm, product_height_cm, product_width_cm FROM dim_products) p USING (product_id)"""
_WAREHOUSE_M8 = f"""(
    SELECT category_name, total_orders, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(avg_price AS DOUBLE) AS avg_price,
           CAST(avg_delivery_days AS DOUBLE) AS avg_delivery_days, {R('CAST(m.delay_rate AS DOUBLE) * 100', 1)} AS delay_rate,
           (SELECT count(DISTINCT product_id) FROM fact WHERE fact.category_name = m.category_name) AS unique_products, unique_sellers
    FROM m_category m)"""


def in_warehouse_mode(body: str) -> str:
    """A report's SQL over the stored fact and category mart instead of the CSV population."""
    from marketlens.oracle.prelude import with_prelude
    body = body.replace(M8, _WAREHOUSE_M8)
    if "FROM s_orders" in body and "order_status" in body:  # the funnel
        body = body.replace("FROM s_orders", "FROM (SELECT DISTINCT order_id, order_status FROM fact) s_orders")
    return with_prelude(body, {"D": _WAREHOUSE_D})


def above_floor(body: str, day: str) -> str:
    """A report's SQL over the part of the fact that was purchased on or after ``day``."""
    return body.replace("FROM fact", f"FROM (SELECT * FROM fact WHERE purchase_date >= DATE '{day}') fact")
