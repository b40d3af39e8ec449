"""Modelled tables: wide view (M10), CSV-population base, dims (D1-D4), fact.

Two populations exist in the source system and are kept apart (N18):

* ``view``  — orders ⟕ items ⟕ products ⟕ translation ⟕ sellers ⟕ customers
  ⟕ order-level payments; calendar day counts.  SQL reports filter it to
  ``delivered``.
* ``csv_delivered`` — the same left star join without payments, elapsed day
  counts (pandas semantics), delivered status only, with the per-order mean
  review score attached.
* ``fact`` — the detail fact: orders ⋈ items (inner) for delivered / shipped
  orders with a delivery date, payments and reviews aggregated per order
  *before* the join (so the join cannot fan out).

Every join below is keyed by ``order_id`` except the dimension lookups, so the
item-side shuffle by order id is shared by the payment and review aggregates;
dimension lookups use AQE's size-checked broadcast (no unconditional hint on
tables that grow with the data), and in a stored warehouse one by counted rows.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import (
    day_diff, days_late, late_flag, weekday_mon0, weekday_sun1, year_month,
)

# Statuses kept in the detail fact, and its date floor for the
# warehouse loader.
FACT_STATUSES = ("delivered", "shipped")
WAREHOUSE_DATE_FLOOR = "2016-09-01"


def flag_first_items(df: DataFrame) -> DataFrame:
    """``first_of_order`` and ``first_in_category``: one row of each order, and of each order and category.

    Rows come clustered by order from the order join, so the flags cost no
    shuffle; order counts of any order-level or category grouping become plain
    partial sums instead of distinct counts."""
    item = F.col("order_item_id").asc_nulls_first()
    return df.withColumns({
        "first_of_order": F.row_number().over(Window.partitionBy("order_id").orderBy(item)) == 1,
        "first_in_category": F.row_number().over(Window.partitionBy("order_id", "category_name").orderBy(item)) == 1})


FLAGS = ("first_of_order", "first_in_category")


class Warehouse:
    """Lazily built modelled tables over one set of source tables."""

    def __init__(self, spark: SparkSession, src: dict[str, DataFrame], etl_date: str | None = None):
        self.spark = spark
        self.src = src
        self.etl_date = etl_date
        self.stored: dict[str, DataFrame] = {}
        #: Row counts that a stored warehouse knows from its writing jobs.
        self.known_rows: dict[str, int] = {}
        #: Number of buckets by order id that the orders, items and payments lie in, if they do.
        self.order_buckets: int | None = None

    # ------------------------------------------------------------------ build
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Warehouse":
        from marketlens.sources.testdata import source_tables
        return cls(spark, source_tables(spark, sf_dir), **kw)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, **kw) -> "Warehouse":
        from marketlens.sources.csv import load_raw
        return cls(spark, load_raw(spark, path), **kw)

    @classmethod
    def from_warehouse(cls, spark: SparkSession, root: str, etl_date: str | None = None,
                       date_floor: str | None = WAREHOUSE_DATE_FLOOR) -> "Warehouse":
        """Read a built warehouse (``pipeline.build``): the ODS snapshot of
        ``etl_date`` (default: the latest) as sources, and the stored fact,
        dimensions and marts of that day.

        A dimension or mart counts as stored only if it was computed from that fact; one of
        another load, or of none, is computed from the stored fact instead, so neither an older day nor
        a rebuild of one layer is ever mixed with other tables.
        ``date_floor`` (the loader's fixed floor by default, None for all) keeps
        purchases on or after that day in the fact; the filter reaches the
        month-partitioned files as partition pruning.  The stored marts cover
        the whole fact, as they were written."""
        from marketlens.plans.pipeline import FACT, fact_basis, fact_day, ods_snapshot, stored_fact
        from marketlens.sources.releases import Release
        release = Release.open(spark, root)
        src, day = ods_snapshot(spark, root, etl_date, release)
        wh = cls(spark, src, etl_date=day)
        wh.known_rows = {f"ods_{t}": n for t in src if (n := release.rows(f"ods_{t}", [day]))}
        if fact_day(release) == day:
            fact, basis = stored_fact(release), fact_basis(release)
            wh.known_rows[FACT] = release.rows(FACT)
            for name in (*cls.DIMS, "dim_dates", *cls.MARTS):
                entry = release.entry(name, day)
                if entry is not None and entry.basis == basis:
                    df = release.table(name, [day] if entry.column else None)
                    if name in cls.MARTS:
                        wh.stored[name] = df
                    elif name in cls.DIMS:
                        wh.__dict__[name] = df
                    wh.known_rows[name] = entry.rows
            whole = cls(spark, src, etl_date=day)  # what is not stored comes from the whole fact, not from the part above the floor
            whole.known_rows = wh.known_rows
            whole.__dict__.update({n: wh.__dict__[n] for n in cls.DIMS if n in wh.__dict__}, fact=fact)
            whole.stored = wh.stored
            for name in cls.DIMS:
                if name not in wh.__dict__:
                    wh.__dict__[name] = getattr(whole, name)
            for name in cls.MARTS:
                whole.mart(name)
            wh.__dict__["full_fact"] = fact
        else:
            fact = wh.fact
        if date_floor:
            fact = fact.where((F.col("purchase_year_month") >= date_floor[:7])
                              & (F.col("purchase_date") >= F.lit(date_floor).cast("date")))
        wh.__dict__["fact"] = fact
        return wh

    @classmethod
    def load(cls, spark: SparkSession, source: str, path: str, fallback_csv: str | None = None,
             **kw) -> "Warehouse":
        """One interface over both sources (S10): ``source='warehouse'`` reads a
        built warehouse and falls back to the CSV files at ``fallback_csv`` when
        there is no warehouse (other errors are raised); ``source='csv'`` reads
        the raw files.  The fallback keeps the load date that was asked for."""
        if source == "csv":
            return cls.from_csv(spark, path, **kw)
        if source != "warehouse":
            raise ValueError(f"unknown source {source!r}")
        try:
            return cls.from_warehouse(spark, path, **kw)
        except LookupError:
            if fallback_csv is None:
                raise
            return cls.from_csv(spark, fallback_csv, etl_date=kw.get("etl_date"))

    # ------------------------------------------------------------ stored marts
    DIMS = ("dim_customers", "dim_products", "dim_sellers")
    MARTS = {"dws_daily_metrics": "daily_metrics", "dws_daily_category": "daily_category",
             "dws_daily_state": "daily_state", "dws_weekly_metrics": "weekly_metrics",
             "dws_category_summary": "category_summary", "dws_state_summary": "state_summary"}

    def mart(self, name: str) -> DataFrame:
        """A summary mart by table name: as stored, or computed once from the fact where it is not."""
        if name not in self.stored:
            from marketlens.plans import marts
            self.stored[name] = getattr(marts, self.MARTS[name])(self)
        return self.stored[name]

    @cached_property
    def warehouse_delivered(self) -> DataFrame:
        """The fact with product sizes attached (J12), each column once."""
        sizes = self.dim_products.select("product_id", "product_length_cm", "product_height_cm",
                                         "product_width_cm")
        return self.fact.join(self._counted(sizes, "dim_products"), "product_id", "left")

    def t(self, name: str) -> DataFrame:
        return self.src[name]

    # ------------------------------------------------------------- materialize
    def materialize(self, root: str) -> "Warehouse":
        """Write the source tables, the order star and the summary marts as Parquet under ``root``
        (a shared folder on a cluster) and return a Warehouse that reads them back.

        The star is joined and flagged once, and written clustered by order; fact, view and
        CSV population are projections of it, so a report reads only the star's columns that it
        needs.  The written files cut lineage: a lost executor costs only the tasks of the report that was running.
        """
        from marketlens.sources.warehouse import read_table, write_table, write_tables
        src = self.src
        if "_item_lines" in src:  # number the order lines once, derive items and payments from the written rows
            from marketlens.sources.testdata import with_stored_lines
            src = with_stored_lines(src, root)
        names = [n for n in src if not n.startswith("_")]
        write_tables({f"src_{n}": src[n] for n in names}, root)
        wh = Warehouse(self.spark, {n: read_table(self.spark, root, f"src_{n}") for n in names},
                       etl_date=self.etl_date)
        write_table(wh._star(with_payments=True, with_reviews=True), root, "base_star", [])  # from the written sources
        star = read_table(self.spark, root, "base_star")
        wh.__dict__.update(fact=wh._as_fact(star.where(self._fact_rows())), view=wh._as_view(star),
                           csv_main=wh._as_csv(star.drop("review_score")),
                           csv_delivered=wh._as_csv(star).where(F.col("order_status") == "delivered"))
        weekly = "dws_weekly_metrics"  # rolled up from the daily mart, so after it
        first = [n for n in self.MARTS if n != weekly]
        write_tables({f"base_{n}": wh.mart(n) for n in first}
                     | {f"base_{n}": wh.month_moments(n) for n in self.MOMENTS}
                     | {f"base_{n}": wh.day_bitmaps(n) for n in self.DISTINCT}, root)
        for n in (*first, *self.MOMENTS, *self.DISTINCT):
            wh.stored[n] = read_table(self.spark, root, f"base_{n}")
        write_table(wh.mart(weekly), root, f"base_{weekly}", [])
        wh.stored[weekly] = read_table(self.spark, root, f"base_{weekly}")
        return wh

    # ------------------------------------------------------- pre-aggregates
    @cached_property
    def payments_by_order(self) -> DataFrame:
        return self.t("order_payments").groupBy("order_id").agg(
            F.max("payment_type").alias("payment_type"),
            F.max("payment_installments").alias("payment_installments"),
            F.sum("payment_value").alias("payment_value"),
        )

    @cached_property
    def reviews_by_order(self) -> DataFrame:
        reviews = self.t("order_reviews")
        if self.order_buckets:  # once, to the buckets of the orders
            reviews = reviews.repartition(self.order_buckets, "order_id")
        return reviews.groupBy("order_id").agg(
            F.avg("review_score").alias("review_score"))

    # --------------------------------------------------------------- D3 products
    @cached_property
    def dim_products(self) -> DataFrame:
        p, tr = self.t("products"), self.t("product_category_translation")
        return p.join(tr, "product_category_name", "left").select(
            "product_id", "product_category_name",
            F.coalesce("product_category_name_english", "product_category_name").alias("category_name_english"),
            "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
            (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"))
            .alias("product_volume_cm3"),
            "product_photos_qty",
        )

    # ----------------------------------------------------------- the order star
    #: Columns of the star that only some frames have: the ids as the dimensions know them, and the payments.
    STAR_MARKERS = ("has_item", "known_product_id", "known_seller_id")
    PAYMENTS = ("payment_type", "payment_installments", "payment_value")

    def _star(self, with_payments: bool, with_reviews: bool = False, rows: Column | None = None) -> DataFrame:
        """orders ⟕ items ⟕ products ⟕ translation ⟕ sellers ⟕ customers [⟕ payments] [⟕ reviews], with the
        category and the first-item flags.

        Customer, payment and review lookups run on the (smaller) order rows,
        product and seller lookups on the item rows, then one order-keyed join
        brings both together.  Left joins on unique dimension keys commute, so
        the result equals the source's join order, and the rows end up clustered
        by order for the first-item flags.  ``rows`` keeps some rows before they are flagged.

        Where orders and items lie in buckets by order, they stay there and only keys travel to the dimensions
        (``_looked_up``).
        """
        o, oi = self.t("orders"), self.t("order_items").withColumn("has_item", F.lit(True))
        p = (self.t("products").join(self.t("product_category_translation"), "product_category_name", "left")
             .withColumns({"known_product_id": F.col("product_id"),
                           "category_name": F.coalesce("product_category_name_english", "product_category_name")}))
        s, c = self.t("sellers").withColumn("known_seller_id", F.col("seller_id")), self.t("customers")
        orders = self._looked_up(o, c, "customer_id", "customers")
        if with_payments:
            orders = orders.join(self.payments_by_order, "order_id", "left")
        if with_reviews:
            orders = orders.join(self.reviews_by_order, "order_id", "left")
        items = self._looked_up(self._looked_up(oi, p, "product_id", "products"), s, "seller_id", "sellers")
        star = orders.join(items, "order_id", "left")
        if rows is not None:
            star = star.where(rows)
        return flag_first_items(star)

    #: A dimension of at most so many rows, as counted by the job that wrote it, may go to rows in buckets as a broadcast.
    BROADCAST_ROWS = {"sellers": 500_000}
    #: A stored table of more rows is never broadcast: the planner goes by the bytes of compressed files, and the driver made
    #: a hash table of 580 MB from 5.4 million customers, whose files have 12 MB.
    SHUFFLED_FROM = 500_000

    def _counted(self, df: DataFrame, table: str, join: str = "shuffle_hash") -> DataFrame:
        """``df``, made row by row of ``table``, for a join: by shuffles where a stored warehouse counted too many rows for
        a broadcast, or did not count them.  ``shuffle_hash`` (the other side is not sorted) is for keys that are unique here."""
        if self.known_rows and (self.known_rows.get(table) or math.inf) > self.SHUFFLED_FROM:
            return df.hint(join)
        return df

    def _looked_up(self, rows: DataFrame, dim: DataFrame, key: str, name: str) -> DataFrame:
        """``rows ⟕ dim`` on ``key``.  Rows in buckets by order are not moved: their distinct pairs of order and key go to
        the dimension, and come back to the order's bucket with its columns."""
        if not self.order_buckets:
            return rows.join(self._counted(dim, f"ods_{name}"), key, "left")
        if (self.known_rows.get(f"ods_{name}") or math.inf) <= self.BROADCAST_ROWS.get(name, 0):
            return rows.join(F.broadcast(dim), key, "left")
        pairs = rows.select("order_id", key).distinct()
        found = pairs.join(self._counted(dim, f"ods_{name}"), key).repartition(self.order_buckets, "order_id")
        known = f"known_{key}"  # a copy of the key: made again after the way back
        found = found.withColumn(known, F.col(key)) if known in dim.columns else found
        found = found.withColumnsRenamed({"order_id": "_order", key: "_key"})
        # written as an equality, the key would be a second join key, and both sides were shuffled by the two
        same = (F.col("order_id") == F.col("_order")) & F.col(key).between(F.col("_key"), F.col("_key"))
        return rows.join(found, same, "left").drop("_order", "_key")

    # ------------------------------------------------------------- M10 the view
    @cached_property
    def view(self) -> DataFrame:
        """``v_order_full`` (M10): one row per order item (or per item-less order)."""
        return self._as_view(self._star(with_payments=True))

    def _as_view(self, star: DataFrame) -> DataFrame:
        deliv, purch = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
        est, carrier = F.col("order_estimated_delivery_date"), F.col("order_delivered_carrier_date")
        return star.select(
            "order_id", "order_status", "order_purchase_timestamp",
            "order_delivered_customer_date", "order_estimated_delivery_date",
            day_diff(deliv, purch).alias("delivery_days"),
            day_diff(deliv, carrier).alias("carrier_days"),
            late_flag(deliv, est).alias("is_delayed"),
            days_late(deliv, est).alias("delay_days"),
            F.year(purch).alias("purchase_year"),
            F.month(purch).alias("purchase_month"),
            year_month(purch).alias("purchase_year_month"),
            "customer_unique_id", "customer_state", "customer_city",
            "product_id", "product_category_name",
            "category_name",
            "product_weight_g", "seller_id", "seller_state", "seller_city",
            "price", "freight_value", *self.PAYMENTS, *FLAGS,
        )

    @cached_property
    def view_delivered(self) -> DataFrame:
        """``V`` of the SQL reports: the view filtered to delivered orders."""
        return self.view.where(F.col("order_status") == "delivered")

    # ----------------------------------------------- CSV population (pandas path)
    def _as_csv(self, star: DataFrame) -> DataFrame:
        df = star.drop(*self.STAR_MARKERS, *self.PAYMENTS)
        deliv, purch = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
        est, carrier = F.col("order_estimated_delivery_date"), F.col("order_delivered_carrier_date")
        return df.select(
            "*",
            day_diff(deliv, purch, "elapsed").alias("delivery_time_days"),
            day_diff(est, purch, "elapsed").alias("estimated_delivery_days"),
            day_diff(deliv, carrier, "elapsed").alias("carrier_time_days"),
            late_flag(deliv, est).alias("is_delayed"),
            days_late(deliv, est, "elapsed").alias("delay_days"),
            F.year(purch).alias("purchase_year"),
            F.month(purch).alias("purchase_month"),
            weekday_mon0(purch).alias("purchase_dayofweek"),
            F.weekofyear(purch).alias("purchase_week"),
            year_month(purch).alias("purchase_year_month"),
        )

    @cached_property
    def csv_main(self) -> DataFrame:
        """Left star join with pandas-style features (elapsed days, N1)."""
        return self._as_csv(self._star(with_payments=False))

    @cached_property
    def csv_delivered(self) -> DataFrame:
        """pandas ``delivered`` frame: delivered status + per-order mean review
        (joined on the order rows, before the items)."""
        return self._as_csv(self._star(with_payments=False, with_reviews=True)).where(F.col("order_status") == "delivered")

    # ------------------------------------------------ dashboard frames
    #: "csv" (the raw-file population) or "warehouse" (the stored fact and marts)
    report_source = "csv"

    def for_dashboard(self) -> "Warehouse":
        """Let R1-R31 read the warehouse's fact and category mart instead of the CSV population."""
        self.report_source = "warehouse"
        for frame in ("report_frame", "order_frame", "monthly_frame", "category_frame"):
            self.__dict__.pop(frame, None)  # of the CSV population, where a report has asked for it before
        return self

    @cached_property
    def report_frame(self) -> DataFrame:
        """The item-grain frame of the dashboard reports.

        In warehouse mode the fact with product sizes under the reports' column
        names (P13): delivered and shipped orders with a delivery date, calendar
        day counts, weekday from Monday = 0, ISO week."""
        if self.report_source == "csv":
            return self.csv_delivered
        day = F.col("purchase_date")
        return self.warehouse_delivered.withColumnsRenamed({
            "delivery_days": "delivery_time_days", "purchase_timestamp": "order_purchase_timestamp",
            "delivered_timestamp": "order_delivered_customer_date"}).withColumns({
                "order_estimated_delivery_date": F.col("estimated_date").cast("timestamp_ntz"),
                "purchase_year": F.year(day), "purchase_month": F.month(day), "purchase_dayofweek": weekday_mon0(day),
                "purchase_week": F.weekofyear(day), "purchase_year_month": year_month(day)})

    #: Column sets whose moments are kept a month: review score by delivery days, and the correlation matrix.
    MOMENTS = {
        "moments_score_by_days": ("delivery_time_days", "review_score"),
        "moments_matrix": ("review_score", "delivery_time_days", "delay_days", "price", "freight_value", "product_weight_g",
                           "product_length_cm", "product_height_cm", "product_width_cm"),
    }

    def month_moments(self, name: str) -> DataFrame:
        """Moments per purchase month of the report frame: as stored for the CSV population, else computed (ST1-ST3)."""
        if self.report_source == "csv" and name in self.stored:
            return self.stored[name]
        from marketlens.operators.moments import moments
        return moments(self.report_frame, ["purchase_year_month"], self.MOMENTS[name])

    #: Values whose distinct counts are kept as bitmaps per day: the fact's column, the source table that
    #: lists its values, the column that orders their numbers, and the columns beside the day.
    DISTINCT = {
        "distinct_customers": ("customer_unique_id", "customers", "customer_state", ("customer_state",)),
        "distinct_sellers": ("seller_id", "sellers", "seller_state", ()),
    }

    def day_bitmaps(self, name: str) -> DataFrame:
        """Bitmaps per purchase day of the fact's customers (and their state) or sellers: as stored, or computed (A1)."""
        if name in self.stored:
            return self.stored[name]
        from marketlens.operators.distinct_bitmaps import bitmaps, number_values
        key, table, near, beside = self.DISTINCT[name]
        values = self.t(table).groupBy(key).agg(F.max(near).alias(near))
        rows = self.fact.select("purchase_date", *beside, key).distinct().join(number_values(values, key, [near]), key)
        return bitmaps(rows, ["purchase_date", *beside])

    @cached_property
    def monthly_frame(self) -> DataFrame:
        from marketlens.plans import marts
        return marts.monthly_summary(self)

    @cached_property
    def category_frame(self) -> DataFrame:
        """The category summary of the dashboard; in warehouse mode the stored category mart with rates in
        percent and the number of distinct products counted from the fact (J11; none: 0)."""
        from marketlens.functions.numeric import rnd
        from marketlens.plans import marts
        if self.report_source == "csv":
            return marts.csv_category_summary(self)
        products = self.report_frame.groupBy("category_name").agg(F.countDistinct("product_id").alias("unique_products"))
        return self.mart("dws_category_summary").join(products, "category_name", "left").select(
            "category_name", "total_orders", *[F.col(c).cast("double").alias(c) for c in ("total_revenue", "avg_price", "avg_delivery_days")],
            rnd(F.col("delay_rate") * 100, 1).alias("delay_rate"),
            F.coalesce("unique_products", F.lit(0)).cast("bigint").alias("unique_products"), "unique_sellers")

    @cached_property
    def order_frame(self) -> DataFrame:
        """One row per order: all source orders, or in warehouse mode those of the fact."""
        if self.report_source == "csv":
            return self.t("orders")
        from marketlens.operators.grouping import one_per_key
        return one_per_key(self.fact, "order_id", "order_status")

    # ------------------------------------------------------------------ D5 fact
    @cached_property
    def fact(self) -> DataFrame:
        """``dwd_order_detail``: grain = order item, 30 columns (etl_date last) and the first-item flags."""
        return self._as_fact(self._star(with_payments=True, with_reviews=True, rows=self._fact_rows()))

    #: The star's columns that the fact keeps or is derived from.
    FACT_BASE = ("order_id", "order_item_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
                 "order_delivered_carrier_date", "order_estimated_delivery_date", "customer_unique_id", "customer_state",
                 "known_product_id", "category_name", "product_weight_g", "known_seller_id", "seller_state", "price",
                 "freight_value", "payment_value", "payment_type", "review_score", *FLAGS)

    def fact_base(self) -> DataFrame:
        """The rows of the fact before its derived columns, with the purchase month: what a build moves and stages."""
        star = self._star(with_payments=True, with_reviews=True, rows=self._fact_rows())
        return star.select(*self.FACT_BASE, year_month(F.col("order_purchase_timestamp")).alias("purchase_year_month"))

    @staticmethod
    def _fact_rows() -> Column:
        """Rows of the star that the fact holds; whole orders but for those without items, so flags stay true."""
        return (F.col("order_status").isin(*FACT_STATUSES) & F.col("order_purchase_timestamp").isNotNull()
                & F.col("order_delivered_customer_date").isNotNull() & F.col("has_item"))

    def _as_fact(self, star: DataFrame) -> DataFrame:
        deliv, purch = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
        est, carrier = F.col("order_estimated_delivery_date"), F.col("order_delivered_carrier_date")
        dow = weekday_sun1(purch)
        etl = F.lit(self.etl_date).cast("date") if self.etl_date else F.current_date()
        return star.select(
            "order_id", "order_item_id", "order_status",
            F.to_date(purch).alias("purchase_date"),
            purch.alias("purchase_timestamp"),
            F.to_date(deliv).alias("delivered_date"),
            deliv.alias("delivered_timestamp"),
            F.to_date(est).alias("estimated_date"),
            day_diff(deliv, purch).alias("delivery_days"),
            day_diff(deliv, carrier).alias("carrier_days"),
            late_flag(deliv, est).alias("is_delayed"),
            days_late(deliv, est).alias("delay_days"),
            F.year(purch).alias("purchase_year"),
            F.month(purch).alias("purchase_month"),
            year_month(purch).alias("purchase_year_month"),
            dow.alias("purchase_dayofweek"),
            F.when(dow.isin(1, 7), 1).otherwise(0).alias("is_weekend"),
            "customer_unique_id", "customer_state",
            F.col("known_product_id").alias("product_id"),
            "category_name",
            "product_weight_g",
            F.col("known_seller_id").alias("seller_id"),
            "seller_state", "price", "freight_value", "payment_value", "payment_type",
            "review_score", *FLAGS,
            etl.alias("etl_date"),
        )

    # ------------------------------------------------------------ D1, D2, D4
    def dim_dates(self, start: str = "2016-01-01", end: str = "2018-12-31") -> DataFrame:
        """Calendar over a fixed span (the source system uses 2016-2018)."""
        from marketlens.plans.calendar import calendar
        return calendar(self.spark, F.to_date(F.lit(start)), F.to_date(F.lit(end)))

    def dim_dates_for_orders(self) -> DataFrame:
        """Calendar from Jan 1 of the first to Dec 31 of the last purchase year."""
        from marketlens.plans.calendar import calendar
        ts = F.col("order_purchase_timestamp")
        span = self.t("orders").agg(F.make_date(F.min(F.year(ts)), F.lit(1), F.lit(1)).alias("s"),
                                    F.make_date(F.max(F.year(ts)), F.lit(12), F.lit(31)).alias("e"))
        return calendar(self.spark, None, None, span=span)

    @cached_property
    def dim_customers(self) -> DataFrame:
        """Per person: MAX state / city / zip (N7), first purchase date, fact orders."""
        c = self.t("customers")
        o = self._counted(self.t("orders").select("customer_id", "order_purchase_timestamp"), "ods_orders", "merge")
        base = c.join(o, "customer_id", "left").groupBy("customer_unique_id").agg(
            F.max("customer_state").alias("customer_state"),
            F.max("customer_city").alias("customer_city"),
            F.max("customer_zip_code_prefix").alias("customer_zip_prefix"),
            F.min(F.to_date("order_purchase_timestamp")).alias("first_purchase_date"),
        )
        orders = self.fact.groupBy("customer_unique_id").agg(F.count(F.when(F.col("first_of_order"), 1)).alias("_n"))
        return (base.join(orders, "customer_unique_id", "left")
                .withColumn("total_orders", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n"))

    @cached_property
    def dim_sellers(self) -> DataFrame:
        """Seller copy + fact item rows (not distinct orders) + revenue."""
        s = self.t("sellers").select(
            "seller_id", "seller_state", "seller_city",
            F.col("seller_zip_code_prefix").alias("seller_zip_prefix"))
        agg = self.fact.groupBy("seller_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("price").alias("_rev"))
        return (s.join(agg, "seller_id", "left")
                .withColumn("total_orders", F.coalesce("_n", F.lit(0)).cast("bigint"))
                .withColumn("total_revenue", F.coalesce("_rev", F.lit(0).cast("decimal(22,2)")))
                .drop("_n", "_rev"))
