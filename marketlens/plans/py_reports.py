"""Report family R1-R31: the data behind each KPI block and chart of the
dashboard, over ``Warehouse.report_frame`` and its category and monthly frames:
the CSV population (``csv_delivered``: delivered orders, left item join, elapsed
day counts, per-order mean review), or in warehouse mode the stored fact and
category mart under the same column names.

pandas semantics kept: ``groupby`` drops NULL keys, ``mean`` skips NULLs,
``(x == k).mean()`` counts NULL as "no", ``sum`` of nothing is 0 (N24).
Statistics (r, slope, percentiles) are reported to 6 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.buckets import bucketize
from marketlens.functions.numeric import fdiv, qround, rnd
from marketlens.operators.grouping import n_orders, semi_top_n, with_empty_bins
from marketlens.operators.moments import corr_from_moments, linreg_from_moments, merge_moments
from marketlens.operators.ranking import exact_percentile, pareto
from marketlens.operators.rfm import rfm, rfm_score
from marketlens.operators.stats import box_stats, growth, histogram, with_p_value
from marketlens.plans.model import Warehouse

STAT_PLACES = 6
CORR_COLUMNS = Warehouse.MOMENTS["moments_matrix"]


def _mean(c):
    c = F.col(c) if isinstance(c, str) else c
    return fdiv(F.sum(c), F.count(c))


def _psum(c: str):
    """pandas ``sum``: 0 when every value is NULL."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def _late_pct():
    return _mean("is_delayed") * F.lit(100.0)


def _share_eq(c: str, v):
    """``(x == v).mean() * 100`` — NULL counts as not equal."""
    return F.avg(F.when(F.col(c) == v, 1).otherwise(0)) * F.lit(100.0)


def _span_days(d: DataFrame):
    ts = F.col("order_purchase_timestamp")
    return d.agg(F.floor(F.timestamp_diff("SECOND", F.min(ts), F.max(ts)) / 86400)).scalar()


def _top(df: DataFrame, measure: str, n: int, key: str = "category_name") -> DataFrame:
    """``nlargest(n, measure)``; ties keep the first row (key order)."""
    return df.orderBy(F.col(measure).desc(), F.col(key)).limit(n)


# ----------------------------------------------------------------- overview
def r01_overview_kpis(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    ts = F.col("order_purchase_timestamp")
    return d.agg(n_orders().alias("total_orders"), _psum("price").alias("total_gmv"),
                 _mean("delivery_time_days").alias("avg_delivery"), _late_pct().alias("delay_rate"),
                 F.countDistinct("customer_unique_id").alias("customers"),
                 F.countDistinct("seller_id").alias("sellers"),
                 F.date_format(F.min(ts), "yyyy-MM").alias("first_month"),
                 F.date_format(F.max(ts), "yyyy-MM").alias("last_month"))


def r01_overview_from_monthly(wh: Warehouse) -> DataFrame:
    """The overview where only the monthly summary is at hand: totals of the months, means of their means,
    no sellers and no date range."""
    m = wh.monthly_frame
    return m.agg(F.coalesce(F.sum("total_orders"), F.lit(0)).cast("bigint").alias("total_orders"), _psum("total_revenue").alias("total_gmv"),
                 F.avg("avg_delivery_days").alias("avg_delivery"), F.avg("delay_rate").alias("delay_rate"),
                 F.coalesce(F.sum("unique_customers"), F.lit(0)).cast("bigint").alias("customers"), F.lit(0).cast("bigint").alias("sellers"),
                 F.lit(None).cast("string").alias("first_month"), F.lit(None).cast("string").alias("last_month"))


def r02_data_summary(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    ts = F.col("order_purchase_timestamp")
    return d.agg(n_orders().alias("orders"), _psum("price").alias("revenue"),
                 F.countDistinct("category_name").alias("categories"),
                 F.countDistinct("seller_id").alias("sellers"),
                 F.countDistinct("customer_unique_id").alias("customers"),
                 _mean("delivery_time_days").alias("avg_delivery_days"), _late_pct().alias("delay_rate_pct"),
                 F.to_date(F.min(ts)).alias("min_date"), F.to_date(F.max(ts)).alias("max_date"))


# ----------------------------------------------------------------- delivery
def r03_delivery_kpis(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    x = F.col("delivery_time_days").cast("double")
    return d.agg(F.count(F.lit(1)).alias("rows"), _mean("delivery_time_days").alias("avg_delivery"),
                 rnd(F.percentile(x, 0.5), STAT_PLACES).alias("median_delivery"),
                 _late_pct().alias("delay_rate_pct"),
                 _mean(F.when(F.col("is_delayed") == 1, F.col("delay_days"))).alias("avg_delay_days"),
                 rnd(F.percentile(x, 0.95), STAT_PLACES).alias("p95_delivery"))


def _in_0_60(wh: Warehouse) -> DataFrame:
    return wh.report_frame.where(F.col("delivery_time_days").between(0, 60))


def r04_delivery_histogram(wh: Warehouse, bins: int = 40) -> DataFrame:
    return histogram(_in_0_60(wh), "delivery_time_days", 60.0 / bins, 0.0, 60.0)


def r04_delivery_box(wh: Warehouse) -> DataFrame:
    b = box_stats(_in_0_60(wh), None, "delivery_time_days")
    return b.select("n", *[rnd(c, STAT_PLACES).alias(c) for c in ("q1", "median", "q3", "mean", "sd", "min", "max")])


def r05_monthly_delivery(wh: Warehouse) -> DataFrame:
    return wh.monthly_frame.select("purchase_year_month", "avg_delivery_days", "delay_rate")


def r06_delivery_by_state(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("customer_state").isNotNull())
    return (d.groupBy("customer_state").agg(_mean("delivery_time_days").alias("avg_delivery"),
                                            rnd(_late_pct(), 1).alias("delay_rate"),
                                            n_orders().alias("order_count"))
            .where(F.col("order_count") >= 50).orderBy("avg_delivery", "customer_state"))


def r07_delivery_by_category(wh: Warehouse) -> DataFrame:
    overall = wh.report_frame.agg(_late_pct()).scalar()
    top = _top(wh.category_frame, "total_orders", 15)
    return top.select("category_name", "avg_delivery_days", "delay_rate", "total_orders",
                      overall.alias("overall_delay_pct"))


def r08_delivery_heatmap(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("category_name").isNotNull() & F.col("purchase_year_month").isNotNull())
    top = semi_top_n(d, wh.category_frame, "category_name",
                     [F.col("total_orders").desc(), F.col("category_name")], 12)
    return (top.groupBy("category_name", "purchase_year_month")
            .agg(_mean("delivery_time_days").alias("avg_delivery_days"))
            .where(F.col("avg_delivery_days").isNotNull()))


def _delayed(wh: Warehouse) -> DataFrame:
    return wh.report_frame.where(F.col("is_delayed") == 1)


def r09_delay_days_distribution(wh: Warehouse) -> DataFrame:
    d = _delayed(wh).where(F.col("delay_days").isNotNull() & (F.col("delay_days") <= 30))
    return d.groupBy("delay_days").agg(F.count(F.lit(1)).alias("n")).orderBy("delay_days")


def r10_most_late_categories(wh: Warehouse) -> DataFrame:
    d = _delayed(wh).where(F.col("category_name").isNotNull())
    agg = d.groupBy("category_name").agg(n_orders("first_in_category").alias("delay_count"),
                                         _mean("delay_days").alias("avg_delay"))
    return _top(agg, "delay_count", 10)


# ---------------------------------------------------------------- inventory
def r11_inventory_kpis(wh: Warehouse) -> DataFrame:
    ts, rev = F.col("order_purchase_timestamp"), F.col("total_revenue")
    place = F.row_number().over(Window.orderBy(rev.desc(), F.col("category_name")))  # one row per category
    cat = wh.category_frame.withColumn("_place", place).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(rev).alias("total"), F.sum(F.when(F.col("_place") <= 3, rev)).alias("top3"),
                 F.avg("unique_sellers").alias("sellers"))).scalar()
    span = F.floor(F.timestamp_diff("SECOND", F.min(ts), F.max(ts)) / 86400)
    return wh.report_frame.agg(
        cat["n"].alias("categories"),
        rnd(cat["top3"] / cat["total"] * F.lit(100.0), STAT_PLACES).alias("top3_share_pct"),
        fdiv(F.count(F.lit(1)), F.greatest(span, F.lit(1))).alias("daily_orders"),
        fdiv(F.countDistinct("seller_id", "category_name"), F.countDistinct("seller_id")).alias("avg_categories_per_seller"),
        cat["sellers"].alias("avg_sellers_per_category"),
        F.countDistinct("product_id").alias("products"))


def r12_category_treemap(wh: Warehouse) -> DataFrame:
    return _top(wh.category_frame, "total_revenue", 30).select(
        "category_name", "total_revenue", "delay_rate", "total_orders", "avg_price", "avg_delivery_days")


def r13_sales_velocity(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("category_name").isNotNull())
    span = F.greatest(_span_days(wh.report_frame), F.lit(1))
    agg = d.groupBy("category_name").agg(n_orders("first_in_category").alias("total_sales"),
                                         _psum("price").alias("total_revenue"))
    agg = agg.withColumn("daily_sales", fdiv(F.col("total_sales"), span)) \
             .withColumn("daily_revenue", fdiv(F.col("total_revenue"), span))
    return _top(agg, "daily_sales", 20)


def r14_abc_curve(wh: Warehouse) -> DataFrame:
    cat = wh.category_frame.select("category_name", "total_revenue")
    p = pareto(cat, "category_name", "total_revenue", frame="rows", share="_share", cum="_cum", rank="rank")
    a, b, c = L.ABC_MART_LABELS
    lo, hi = L.ABC_PCT_BOUNDS
    cum = rnd(F.col("_cum"), STAT_PLACES)
    return p.select("category_name", "total_revenue", cum.alias("cum_pct"), "rank",
                    F.when(cum <= lo, a).when(cum <= hi, b).otherwise(c).alias("abc_class"))


def r14_abc_counts(wh: Warehouse) -> DataFrame:
    return r14_abc_curve(wh).groupBy("abc_class").agg(F.count(F.lit(1)).alias("n"))


def r15_seller_category_distribution(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("seller_id").isNotNull())
    per = d.groupBy("seller_id").agg(F.countDistinct("category_name").alias("num_categories"))
    return (per.groupBy("num_categories").agg(F.count(F.lit(1)).alias("sellers"))
            .orderBy("num_categories").limit(15))


def r15_category_competition(wh: Warehouse) -> DataFrame:
    return _top(wh.category_frame, "unique_sellers", 15).select(
        "category_name", F.col("unique_sellers").alias("sellers"))


def r16_top8_monthly_dynamics(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("purchase_year_month").isNotNull())
    top = semi_top_n(d, wh.category_frame, "category_name",
                     [F.col("total_revenue").desc(), F.col("category_name")], 8)
    return top.groupBy("purchase_year_month", "category_name").agg(
        _psum("price").alias("revenue"), n_orders("first_in_category").alias("orders"))


def r17_category_detail(wh: Warehouse) -> DataFrame:
    c = wh.category_frame
    return c.select("category_name", "total_orders", rnd("total_revenue", 0).alias("total_revenue"),
                    rnd("avg_price", 2).alias("avg_price"), rnd("avg_delivery_days", 1).alias("avg_delivery_days"),
                    "delay_rate", "unique_products", "unique_sellers").orderBy(F.col("total_revenue").desc(),
                                                                             "category_name")


# ------------------------------------------------------------- satisfaction
def r18_satisfaction_kpis(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    s, late = F.col("review_score"), F.col("is_delayed")
    on = _mean(F.when(late == 0, s))
    lt = _mean(F.when(late == 1, s))
    return d.agg(_mean("review_score").alias("avg_score"), _share_eq("review_score", 5).alias("score_5_pct"),
                 _share_eq("review_score", 1).alias("score_1_pct"), on.alias("on_time_score"),
                 lt.alias("delayed_score"), (on - lt).alias("score_gap"))


def r19_score_distribution(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("review_score").isNotNull())
    return d.groupBy("review_score").agg(F.count(F.lit(1)).alias("n")).orderBy("review_score")


def r20_score_box_by_delay(wh: Warehouse) -> DataFrame:
    b = box_stats(wh.report_frame, ["is_delayed"], "review_score")
    return b.select("is_delayed", "n",
                    *[rnd(c, STAT_PLACES).alias(c) for c in ("q1", "median", "q3", "mean", "sd", "min", "max")])


def _model(wh: Warehouse) -> DataFrame:
    """Least squares review_score ~ delivery_time_days over every row (N11), from the months' moments."""
    name = "moments_score_by_days"
    total = merge_moments(wh.month_moments(name), wh.MOMENTS[name])
    return linreg_from_moments(total, "review_score", "delivery_time_days")


def r20_regression(wh: Warehouse) -> DataFrame:
    m = _model(wh)
    verdict = F.when(F.col("r") < F.lit(L.VERDICT_R_BOUND), L.VERDICT_NEGATIVE).otherwise(L.VERDICT_WEAK)
    return m.select("n", *[rnd(c, STAT_PLACES).alias(c) for c in ("slope", "intercept", "r", "stderr")],
                    F.col("x_min").cast("double").alias("x_min"), F.col("x_max").cast("double").alias("x_max"),
                    verdict.alias("verdict"))


def r20_regression_pvalue(wh: Warehouse) -> DataFrame:
    """Two-sided p-value of r (Student t, n-2 dof) on the one-row model."""
    return with_p_value(_model(wh)).select("n", *[rnd(c, STAT_PLACES).alias(c) for c in ("r", "p_value")])


def r20_trend_line(wh: Warehouse, points: int = 100) -> DataFrame:
    m = _model(wh).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("point") / F.lit(points - 1)
    return m.select(F.col("point").cast("long").alias("point"), rnd(x, STAT_PLACES).alias("x"),
                    rnd(F.col("slope") * x + F.col("intercept"), STAT_PLACES).alias("y"))


def r21_satisfaction_by_state(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("customer_state").isNotNull())
    return (d.groupBy("customer_state").agg(_mean("review_score").alias("avg_score"),
                                            _share_eq("review_score", 5).alias("score_5_rate"),
                                            _mean("is_delayed").alias("delay_rate"),
                                            n_orders().alias("order_count"))
            .where(F.col("order_count") >= 50))


def r22_score_by_day_bins(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    b = bucketize("delivery_time_days", L.R22_EDGES, L.R22_LABELS)
    agg = (d.withColumn("delivery_range", b).where(F.col("delivery_range").isNotNull())
           .groupBy("delivery_range").agg(_mean("review_score").alias("avg_score"),
                                          n_orders().alias("order_count")))
    out = with_empty_bins(wh.spark, agg, "delivery_range", L.R22_LABELS, {"order_count": 0})
    return out.orderBy("bin_ord").select("delivery_range", "avg_score", "order_count")


def r23_correlation_matrix(wh: Warehouse) -> DataFrame:
    m = corr_from_moments(merge_moments(wh.month_moments("moments_matrix"), CORR_COLUMNS), CORR_COLUMNS)
    return m.select("var1", "var2", rnd("r", STAT_PLACES).alias("r"))


def r24_insights(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    slope = _model(wh).select(rnd("slope", STAT_PLACES)).scalar()
    edges = L.R24_EDGES
    labels = [f"({edges[i]}, {edges[i + 1]}]" for i in range(len(edges) - 1)]
    bin_, state, mean = F.col("_bin"), F.col("customer_state"), F.col("_s")
    both = d.select("customer_state", "review_score", bucketize("delivery_time_days", edges, labels).alias("_bin")).groupingSets(
        [["_bin"], ["customer_state"]], "_bin", "customer_state").agg(
            F.grouping("customer_state").alias("_of_bins"), _mean("review_score").alias("_s"))
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), bin_)
    of_bins = F.col("_of_bins") == 1
    a_bin, a_state = of_bins & bin_.isNotNull(), ~of_bins & state.isNotNull() & mean.isNotNull()
    in_order = F.when(a_state, F.struct(mean, state))
    return both.agg(
        slope.alias("score_change_per_day"),
        F.max_by(bin_, F.when(a_bin, F.struct(mean, -place))).alias("best_bin"), F.max(F.when(a_bin, mean)).alias("best_bin_score"),
        F.max_by(state, in_order).alias("best_state"), F.max(F.when(a_state, mean)).alias("best_state_score"),
        F.min_by(state, in_order).alias("worst_state"), F.min(F.when(a_state, mean)).alias("worst_state_score"))


# -------------------------------------------------------------------- sales
def r25_sales_kpis(wh: Warehouse) -> DataFrame:
    d = wh.report_frame
    g = growth(wh.monthly_frame, "purchase_year_month", "total_revenue").select("growth_pct").scalar()
    # mean basket = mean over orders of the order's item total (0 without items)
    base = d.agg(_psum("price").alias("total_revenue"), n_orders().alias("total_orders"),
                 fdiv(F.coalesce(F.sum("price"), F.lit(0)), n_orders()).alias("avg_order_value"),
                 F.countDistinct("customer_unique_id").alias("customers"))
    median_price = exact_percentile(d, "price", 0.5)
    return base.select("total_revenue", "total_orders", "avg_order_value", "customers",
                       rnd(F.coalesce(g, F.lit(0.0)), STAT_PLACES).alias("mom_growth_pct"),
                       rnd(median_price, STAT_PLACES).alias("median_price"))


def r26_revenue_trend(wh: Warehouse) -> DataFrame:
    return wh.monthly_frame.select("purchase_year_month", "total_revenue", "total_orders")


def r27_weekday_pattern(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("purchase_dayofweek").isNotNull())
    names = F.array(*[F.lit(x) for x in L.DOW_MON0_NAMES])
    return (d.groupBy("purchase_dayofweek").agg(n_orders().alias("orders"),
                                                _psum("price").alias("revenue"))
            .withColumn("day_name", F.element_at(names, F.col("purchase_dayofweek") + 1))
            .orderBy("purchase_dayofweek"))


def r27_month_pattern(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("purchase_month").isNotNull())
    names = F.array(*[F.lit(x) for x in L.MONTH_NAMES])
    return (d.groupBy("purchase_month").agg(n_orders().alias("orders"),
                                            _psum("price").alias("revenue"))
            .withColumn("month_name", F.element_at(names, F.col("purchase_month")))
            .orderBy("purchase_month"))


def state_dimension(wh: Warehouse) -> DataFrame:
    """state → state name, region.  The supplied tables carry one (nation →
    region); source data in the original shape uses the fixed state map."""
    if "geo" in wh.src:
        return wh.t("geo").select("state", "state_name", "region")
    rows = [(s, n, next((r for r, ss in L.REGIONS.items() if s in ss), L.UNKNOWN_REGION))
            for s, n in L.STATE_NAMES.items()]
    return wh.spark.createDataFrame(rows, "state string, state_name string, region string")


def r28_geo_sales(wh: Warehouse) -> DataFrame:
    d = wh.report_frame.where(F.col("customer_state").isNotNull())
    geo = d.groupBy("customer_state").agg(n_orders().alias("orders"),
                                          _psum("price").alias("revenue"),
                                          _mean("review_score").alias("avg_score"))
    dim = state_dimension(wh)  # one row per state: a fixed, small table
    return (geo.join(F.broadcast(dim), geo.customer_state == dim.state, "left")
            .select("customer_state", "state_name",
                    F.coalesce("region", F.lit(L.UNKNOWN_REGION)).alias("region"),
                    "orders", "revenue", "avg_score"))


def r29_top5_share_of_all(wh: Warehouse) -> DataFrame:
    """Top-5 category share of *all* month revenue (N14: denominator = every category)."""
    d = wh.report_frame.where(F.col("purchase_year_month").isNotNull())
    month = F.sum("_sum").over(Window.partitionBy("purchase_year_month"))  # over one row per category
    per = (d.groupBy("purchase_year_month", "category_name").agg(_psum("price").alias("revenue"), F.sum("price").alias("_sum"))
           .withColumn("total_revenue", F.coalesce(month, F.lit(0)).cast("double")).drop("_sum"))
    top = semi_top_n(per, wh.category_frame, "category_name", [F.col("total_revenue").desc(), F.col("category_name")], 5)
    return top.withColumn("share", fdiv(F.col("revenue"), F.col("total_revenue")) * F.lit(100.0))


def r30_order_status_funnel(wh: Warehouse) -> DataFrame:
    """Orders per status (all statuses, N27), largest first, % of the previous stage."""
    o = wh.order_frame.where(F.col("order_status").isNotNull())
    counts = o.groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col("order_status"))  # one row per status
    prev = F.lag("n").over(w)
    return counts.withColumn("pct_previous", F.when(prev.isNull(), F.lit(100.0))
                             .otherwise(F.col("n").cast("double") / prev * F.lit(100.0)))


def r31_rfm_fractional(wh: Warehouse) -> DataFrame:
    """Segments with recency as fractional days (Julian-day difference) and NTILE scores."""
    base = rfm(wh.view_delivered, "customer_unique_id", "order_id", "order_purchase_timestamp", "price", recency="fractional")
    seg = rfm_score(base, "customer_unique_id", "ntile").groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"), rnd(fdiv(F.sum("monetary"), F.count("monetary")), 0).alias("avg_lifetime_value"))
    total = F.sum("customer_count").over(Window.partitionBy())  # at most 4 rows
    return seg.withColumn("pct", qround(F.col("customer_count"), total, 1, mult=100))


def r31_rfm_segments(wh: Warehouse) -> DataFrame:
    """RFM with pandas qcut scoring (W6, W7): R by value quartiles (labels 4..1),
    F and M by first-come rank quartiles, customer id as tie order (N10);
    reference = latest purchase + 1 day, elapsed days, price as monetary (N25)."""
    base = rfm(wh.report_frame, "customer_unique_id", "order_id", "order_purchase_timestamp", "price",
               ref_offset_days=1, recency="elapsed", null_amount_as_zero=True)
    seg = rfm_score(base, "customer_unique_id", "qcut")
    agg = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                     fdiv(F.sum("monetary"), F.count("monetary")).alias("avg_monetary"))
    total = F.sum("customers").over(Window.partitionBy())  # ≤ 4 rows
    return agg.withColumn("pct", qround(F.col("customers"), total, STAT_PLACES, mult=100))


QUERIES = {
    "r01_overview_kpis": r01_overview_kpis,
    "r01_overview_from_monthly": r01_overview_from_monthly,
    "r02_data_summary": r02_data_summary,
    "r03_delivery_kpis": r03_delivery_kpis,
    "r04_delivery_histogram": r04_delivery_histogram,
    "r04_delivery_box": r04_delivery_box,
    "r05_monthly_delivery": r05_monthly_delivery,
    "r06_delivery_by_state": r06_delivery_by_state,
    "r07_delivery_by_category": r07_delivery_by_category,
    "r08_delivery_heatmap": r08_delivery_heatmap,
    "r09_delay_days_distribution": r09_delay_days_distribution,
    "r10_most_late_categories": r10_most_late_categories,
    "r11_inventory_kpis": r11_inventory_kpis,
    "r12_category_treemap": r12_category_treemap,
    "r13_sales_velocity": r13_sales_velocity,
    "r14_abc_curve": r14_abc_curve,
    "r14_abc_counts": r14_abc_counts,
    "r15_seller_category_distribution": r15_seller_category_distribution,
    "r15_category_competition": r15_category_competition,
    "r16_top8_monthly_dynamics": r16_top8_monthly_dynamics,
    "r17_category_detail": r17_category_detail,
    "r18_satisfaction_kpis": r18_satisfaction_kpis,
    "r19_score_distribution": r19_score_distribution,
    "r20_score_box_by_delay": r20_score_box_by_delay,
    "r20_regression": r20_regression,
    "r20_regression_pvalue": r20_regression_pvalue,
    "r20_trend_line": r20_trend_line,
    "r21_satisfaction_by_state": r21_satisfaction_by_state,
    "r22_score_by_day_bins": r22_score_by_day_bins,
    "r23_correlation_matrix": r23_correlation_matrix,
    "r24_insights": r24_insights,
    "r25_sales_kpis": r25_sales_kpis,
    "r26_revenue_trend": r26_revenue_trend,
    "r27_weekday_pattern": r27_weekday_pattern,
    "r27_month_pattern": r27_month_pattern,
    "r28_geo_sales": r28_geo_sales,
    "r29_top5_share_of_all": r29_top5_share_of_all,
    "r30_order_status_funnel": r30_order_status_funnel,
    "r31_rfm_segments": r31_rfm_segments,
    "r31_rfm_fractional": r31_rfm_fractional,
}
