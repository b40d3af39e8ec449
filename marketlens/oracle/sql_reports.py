"""Oracle SQL for Q1-Q21 (DuckDB), written against the prelude CTEs."""

from __future__ import annotations

from marketlens.functions import labels as L
from marketlens.oracle.prelude import DIV, R

AVG_DAYS = R("avg(delivery_days)", 1)
LATE_PCT = R("avg(is_delayed) * 100.0", 1)
VR = "(SELECT v.*, r.review_score FROM V v INNER JOIN s_reviews r ON v.order_id = r.order_id)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rate(cond: str) -> str:
    return R(f"{DIV(f'sum(CASE WHEN {cond} THEN 1 ELSE 0 END)', 'count(DISTINCT order_id)')} * 100.0", 1)


A, B, C = (_q(x) for x in L.ABC_SQL_LABELS)
ST = [_q(x) for x in L.SELLER_TYPES]
Q12 = " ".join(f"WHEN delivery_days <= {b} THEN {_q(lab)}" for b, lab in zip(L.Q12_BOUNDS, L.Q12_LABELS))
DOW = " ".join(f"WHEN {i + 1} THEN {_q(n)}" for i, n in enumerate(L.DOW_SUN1_NAMES))
RFM_SEG = (f"CASE WHEN t >= {L.RFM_BOUNDS[0]} THEN {_q(L.RFM_LABELS[0])} "
           f"WHEN t >= {L.RFM_BOUNDS[1]} THEN {_q(L.RFM_LABELS[1])} "
           f"WHEN t >= {L.RFM_BOUNDS[2]} THEN {_q(L.RFM_LABELS[2])} ELSE {_q(L.RFM_LABELS[3])} END")

SQL = {
    "q01_delivery_kpi": f"""
        SELECT {_q(L.SCOPE_ALL)} AS scope, count(DISTINCT order_id) AS total_delivered,
               {AVG_DAYS} AS avg_delivery_days, {R('avg(delivery_days)', 0)} AS median_delivery_days,
               {LATE_PCT} AS delay_rate_pct,
               {R('avg(CASE WHEN is_delayed = 1 THEN delay_days END)', 1)} AS avg_delay_when_late
        FROM V""",
    "q02_monthly_delivery": f"""
        SELECT purchase_year_month, {AVG_DAYS} AS avg_delivery_days, {LATE_PCT} AS delay_rate_pct,
               count(DISTINCT order_id) AS order_count
        FROM V GROUP BY purchase_year_month ORDER BY purchase_year_month""",
    "q03_state_delivery": f"""
        SELECT customer_state, {AVG_DAYS} AS avg_delivery_days, {LATE_PCT} AS delay_rate_pct,
               count(DISTINCT order_id) AS order_count
        FROM V WHERE customer_state IS NOT NULL GROUP BY customer_state
        HAVING count(DISTINCT order_id) >= 50 ORDER BY avg_delivery_days DESC, customer_state""",
    "q04_category_delay_top15": f"""
        SELECT category_name, {AVG_DAYS} AS avg_delivery_days, {LATE_PCT} AS delay_rate_pct,
               count(DISTINCT order_id) AS order_count
        FROM V WHERE category_name IS NOT NULL GROUP BY category_name
        ORDER BY delay_rate_pct DESC, category_name LIMIT 15""",
    "q05_delay_days_distribution": """
        SELECT delay_days, count(DISTINCT order_id) AS delay_count
        FROM V WHERE is_delayed = 1 AND delay_days <= 30 GROUP BY delay_days ORDER BY delay_days""",
    "q06_worst_sellers": f"""
        SELECT seller_id, {AVG_DAYS} AS avg_delivery_days, {LATE_PCT} AS delay_rate_pct,
               count(DISTINCT order_id) AS total_orders, CAST(sum(price) AS DOUBLE) AS total_revenue
        FROM V WHERE seller_id IS NOT NULL GROUP BY seller_id
        ORDER BY delay_rate_pct DESC, seller_id LIMIT 10""",
    "q07_category_velocity": f"""
        SELECT category_name, count(DISTINCT order_id) AS total_sales, {R('sum(price)', 0)} AS total_revenue,
               {R(DIV('count(DISTINCT order_id)', '(SELECT date_diff(' + "'day'" + ', CAST(min(order_purchase_timestamp) AS DATE), CAST(max(order_purchase_timestamp) AS DATE)) FROM V)'), 2)} AS daily_sales,
               count(DISTINCT product_id) AS unique_products, count(DISTINCT seller_id) AS unique_sellers
        FROM V WHERE category_name IS NOT NULL GROUP BY category_name
        ORDER BY daily_sales DESC, category_name LIMIT 20""",
    # running share over a tie: everything that earns at least as much
    "q08_abc": f"""
        WITH earned AS (FROM V SELECT category_name, sum(price) AS rev WHERE category_name IS NOT NULL GROUP BY ALL),
             pct AS (FROM earned x SELECT category_name, rev,
                       CAST(rev AS DOUBLE) / (SELECT CAST(sum(rev) AS DOUBLE) FROM earned) * 100 AS own,
                       (SELECT CAST(sum(y.rev) AS DOUBLE) FROM earned y WHERE y.rev >= x.rev)
                           / (SELECT CAST(sum(rev) AS DOUBLE) FROM earned) * 100 AS upto)
        SELECT category_name, {R('rev', 0)} AS revenue, {R('own', 1)} AS revenue_pct, {R('upto', 1)} AS cum_pct,
               CASE WHEN upto > {L.ABC_PCT_BOUNDS[1]} THEN {C} WHEN upto > {L.ABC_PCT_BOUNDS[0]} THEN {B} ELSE {A} END AS abc_class
        FROM pct ORDER BY rev DESC, category_name""",
    "q09_top5_category_share": f"""
        WITH place AS (FROM V SELECT category_name, row_number() OVER (ORDER BY sum(price) DESC NULLS LAST, category_name NULLS FIRST) AS nth
                       GROUP BY category_name),
             month AS (FROM V SEMI JOIN (FROM place WHERE nth <= 5) p USING (category_name)
                       SELECT purchase_year_month, category_name, sum(price) AS rev GROUP BY ALL),
             whole AS (FROM month SELECT purchase_year_month, sum(rev) AS total GROUP BY ALL)
        SELECT purchase_year_month, category_name, CAST(rev AS DOUBLE) AS monthly_revenue,
               CAST(total AS DOUBLE) AS total_monthly_revenue, {R(DIV('rev', 'total') + ' * 100.0', 1)} AS revenue_share_pct
        FROM month JOIN whole USING (purchase_year_month) ORDER BY purchase_year_month, category_name""",
    # seller types by their range of category counts (a seller without any counts as few)
    "q10_seller_coverage": f"""
        WITH span(lo, hi, seller_type) AS (VALUES (1, 1, {ST[0]}), (0, 0, {ST[1]}), (2, 3, {ST[1]}), (4, 5, {ST[2]}), (6, 1000000000, {ST[3]})),
             spread AS (FROM V SELECT seller_id, len(list_distinct(list(category_name))) AS n WHERE seller_id IS NOT NULL GROUP BY seller_id)
        SELECT seller_type, count(*) AS seller_count,
               {R('CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM spread) * 100', 1)} AS pct
        FROM spread JOIN span ON n BETWEEN lo AND hi GROUP BY seller_type ORDER BY seller_count DESC, seller_type""",
    "q11_score_by_delay": f"""
        SELECT CASE WHEN is_delayed = 1 THEN {_q(L.DELAYED_LABEL)} ELSE {_q(L.ON_TIME_LABEL)} END AS delivery_type,
               count(DISTINCT order_id) AS order_count, {R('avg(review_score)', 2)} AS avg_score,
               {_rate('review_score = 5')} AS score_5_rate_pct, {_rate('review_score <= 2')} AS negative_rate_pct
        FROM {VR} x GROUP BY 1""",
    "q12_score_by_days_bucket": f"""
        SELECT CASE {Q12} ELSE {_q(L.Q12_ELSE)} END AS delivery_range,
               count(DISTINCT order_id) AS order_count, {R('avg(review_score)', 2)} AS avg_score,
               {_rate('review_score = 5')} AS score_5_rate_pct
        FROM {VR} x GROUP BY 1 ORDER BY min(delivery_days) NULLS FIRST""",
    "q13_state_satisfaction": f"""
        SELECT customer_state, {AVG_DAYS} AS avg_delivery_days, {LATE_PCT} AS delay_rate_pct,
               {R('avg(review_score)', 2)} AS avg_score, count(DISTINCT order_id) AS order_count
        FROM {VR} x WHERE customer_state IS NOT NULL GROUP BY customer_state
        HAVING count(DISTINCT order_id) >= 50 ORDER BY avg_score, customer_state""",
    "q14_satisfaction_factors": f"""
        SELECT {R('avg(review_score)', 2)} AS avg_score, {AVG_DAYS} AS avg_delivery_days,
               {LATE_PCT} AS delay_rate_pct, {R(DIV('sum(freight_value)', 'count(freight_value)'), 2)} AS avg_freight,
               {R(DIV('sum(product_weight_g)', 'count(product_weight_g)'), 0)} AS avg_weight_g,
               {R(DIV('sum(price)', 'count(price)'), 2)} AS avg_price
        FROM {VR} x""",
    "q15_review_cohorts": "\nUNION ALL\n".join(f"""
        SELECT {_q(label)} AS group_type, count(DISTINCT order_id) AS order_count, {AVG_DAYS} AS avg_delivery_days,
               {R('avg(delay_days)', 1)} AS avg_delay_days,
               {R(DIV('sum(freight_value)', 'count(freight_value)'), 2)} AS avg_freight,
               {R(DIV('sum(product_weight_g)', 'count(product_weight_g)'), 0)} AS avg_weight_g
        FROM {VR} x WHERE {cond}""" for label, cond in [(L.NEGATIVE_COHORT, "review_score <= 2"),
                                                       (L.POSITIVE_COHORT, "review_score = 5")]),
    "q16_monthly_sales": f"""
        SELECT purchase_year_month, count(DISTINCT order_id) AS monthly_orders, {R('sum(price)', 0)} AS monthly_revenue,
               count(DISTINCT customer_unique_id) AS unique_customers,
               {R(DIV('sum(price)', 'count(DISTINCT order_id)'), 0)} AS avg_order_value
        FROM V GROUP BY purchase_year_month ORDER BY purchase_year_month""",
    "q17_weekday_sales": f"""
        SELECT CASE dayofweek(order_purchase_timestamp) + 1 {DOW} END AS day_of_week,
               count(DISTINCT order_id) AS order_count, {R('sum(price)', 0)} AS total_revenue
        FROM V GROUP BY dayofweek(order_purchase_timestamp) ORDER BY dayofweek(order_purchase_timestamp)""",
    "q18_month_of_year_sales": f"""
        SELECT CAST(purchase_month AS BIGINT) AS purchase_month, count(DISTINCT order_id) AS order_count,
               {R('sum(price)', 0)} AS total_revenue
        FROM V GROUP BY purchase_month ORDER BY purchase_month""",
    "q19_state_sales": f"""
        SELECT customer_state, count(DISTINCT order_id) AS total_orders, {R('sum(price)', 0)} AS total_revenue,
               count(DISTINCT customer_unique_id) AS customer_count,
               {R(DIV('sum(price)', 'count(DISTINCT order_id)'), 0)} AS avg_order_value
        FROM V WHERE customer_state IS NOT NULL GROUP BY customer_state ORDER BY total_revenue DESC, customer_state""",
    "q20_status_shares": f"""
        SELECT order_status, count(DISTINCT order_id) AS count,
               {R(DIV('count(DISTINCT order_id)', '(SELECT count(DISTINCT order_id) FROM s_orders)') + ' * 100.0', 1)} AS pct
        FROM s_orders GROUP BY order_status ORDER BY count DESC, order_status""",
    # quarters by place: the first n % 4 of them hold one more
    "q21_rfm_segments": f"""
        WITH person AS (FROM V SELECT customer_unique_id AS id, max(order_purchase_timestamp) AS latest,
                          count(DISTINCT order_id) AS orders, sum(price) AS spent GROUP BY customer_unique_id),
             place AS (FROM person SELECT *, count(*) OVER () AS n, unnest([
                          row_number() OVER (ORDER BY CAST(latest AS DATE) ASC NULLS LAST, id NULLS FIRST),
                          row_number() OVER (ORDER BY orders NULLS FIRST, id NULLS FIRST),
                          row_number() OVER (ORDER BY spent NULLS FIRST, id NULLS FIRST)]) AS pos),
             point AS (FROM place SELECT id, orders, spent, sum(CASE
                          WHEN pos <= (n % 4) * (n // 4 + 1) THEN (pos - 1) // (n // 4 + 1) + 1
                          ELSE n % 4 + (pos - (n % 4) * (n // 4 + 1) - 1) // greatest(n // 4, 1) + 1 END) AS t GROUP BY ALL)
        SELECT {RFM_SEG} AS segment, count(*) AS customer_count,
               {R('CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM person) * 100', 1)} AS pct,
               {R(DIV('sum(spent)', 'count(spent)'), 0)} AS avg_lifetime_value, {R('avg(orders)', 1)} AS avg_orders
        FROM point GROUP BY segment""",
}
