"""Adapter: the supplied TPC-H-like tables → the retail source shape.

Every derived column is a deterministic expression of the supplied rows (see
FIXTURES.md §3), so the same tables can be rebuilt by any SQL engine for the
oracle.  Keys stay BIGINT (opaque ids); money is DECIMAL from the start.

Nothing here collects: each table is a lazy DataFrame over the Parquet scan,
so Catalyst prunes the columns each report does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Order status per TPC-H status letter.
STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "processing"}

# The delivery proxy wraps the ship-date offset into 0..59 days.
DELIVERY_WRAP_DAYS = 60
# ... and adds this many days where the offset is a multiple of SLOW_EVERY (deliveries of 150 to 209 days).
SLOW_DAYS, SLOW_EVERY = 150, 13
ESTIMATE_DAYS = 30
# Orders under the first total have no review, orders from the second on have two.
REVIEWED_FROM, REVIEWED_TWICE_FROM = 50_000, 450_000

#: So many order lines has a bucket of the stored input.
LINES_A_BUCKET = 500_000


def read_supplied(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _status(col):
    expr = None
    for k, v in STATUS_MAP.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(F.lit(None).cast("string"))


def from_item_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """The item and payment tables (one payment per item) of numbered order lines."""
    return {
        "order_items": lines.drop("_payment_type", "_installments"),
        "order_payments": lines.select(
            "order_id",
            F.col("order_item_id").alias("payment_sequential"),
            F.col("_payment_type").alias("payment_type"),
            F.col("_installments").alias("payment_installments"),
            (F.col("price") + F.col("freight_value")).cast("decimal(12,2)").alias("payment_value"),
        ),
    }


def with_stored_lines(src: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """The source tables with the order lines numbered and written once under ``root``; items and payments are
    read from the written rows, so a caller that writes or loads both shuffles the lines once."""
    from marketlens.sources.warehouse import read_table, write_table
    lines = src["_item_lines"]
    write_table(lines, root, "src_item_lines", [])
    stored = read_table(lines.sparkSession, root, "src_item_lines")
    return src | from_item_lines(stored) | {"_item_lines": stored}


def order_buckets(spark: SparkSession, sf_dir: str) -> int:
    """How many buckets by order id the supplied order lines fill (their number stands in the files' footers).  Each bucket
    is a task that keeps the months' files open, so there are not more than the rows need."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return max(1, -(-lines // LINES_A_BUCKET))


def with_stored_input(src: dict[str, DataFrame], root: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The source tables for a caller that loads them more than once: the order lines as in ``with_stored_lines``, and
    the orders, with the last ship dates of the stored lines, written once too; both in ``buckets`` buckets by order id,
    if given: the lines are numbered by order and the orders joined with them, so they lie so already."""
    from marketlens.sources.releases import read_bucketed, write_bucketed
    from marketlens.sources.warehouse import read_table, write_table
    if buckets:
        def stored(df: DataFrame, name: str) -> DataFrame:
            write_bucketed(df, f"{root}/{name}", "order_id", buckets)
            return read_bucketed(df.sparkSession, f"{root}/{name}", df.schema, "order_id", buckets)
        lines = stored(src["_item_lines"], "src_item_lines")
        last_ship = lines.groupBy("order_id").agg(F.max("shipping_limit_date").alias("_last_ship")).withColumnRenamed("order_id", "l_orderkey")
        supplied = src["_supplied_orders"].repartition(buckets, "o_orderkey")
        return src | from_item_lines(lines) | {"_item_lines": lines, "orders": stored(orders_of(supplied, last_ship), "src_orders")}
    src = with_stored_lines(src, root)
    last_ship = src["_item_lines"].groupBy(F.col("order_id").alias("l_orderkey")).agg(F.max("shipping_limit_date").alias("_last_ship"))
    write_table(orders_of(src["_supplied_orders"], last_ship), root, "src_orders", [])
    return src | {"orders": read_table(src["orders"].sparkSession, root, "src_orders")}


def orders_of(o: DataFrame, last_ship: DataFrame) -> DataFrame:
    """The order table of the supplied orders and the last ship date of each (``l_orderkey``, ``_last_ship``)."""
    od = o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left")
    offset = F.datediff(F.to_date("_last_ship"), F.to_date("o_orderdate"))
    deliv_days = F.pmod(offset, F.lit(DELIVERY_WRAP_DAYS)) + F.when(
        F.pmod(offset, F.lit(SLOW_EVERY)) == 0, SLOW_DAYS).otherwise(0)
    return od.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _status(F.col("o_orderstatus")).alias("order_status"),
        F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate")).alias("order_purchase_timestamp"),
        F.timestamp_add("DAY", F.lit(1),
                       F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))).alias("order_approved_at"),
        F.timestamp_add("DAY", F.floor(deliv_days / 2).cast("int"), F.col("o_orderdate")).alias("order_delivered_carrier_date"),
        F.timestamp_add("HOUR", F.col("o_orderkey") % 17,
                       F.timestamp_add("DAY", deliv_days, F.col("o_orderdate"))).alias("order_delivered_customer_date"),
        F.timestamp_add("DAY", F.lit(ESTIMATE_DAYS), F.col("o_orderdate")).alias("order_estimated_delivery_date"),
    )


def source_tables(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The eight source tables plus ``geo`` (state → state name, region); the shuffle that numbers the order lines has
    ``buckets`` partitions, if given."""
    t = read_supplied(spark, sf_dir)
    li, o = t["lineitem"], t["orders"]

    # ---- orders: timestamps from the order date and the last ship date ----
    orders = orders_of(o, li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_last_ship")))

    # ---- order items: one per lineitem; item number over all columns ----
    # Rename first so the window is partitioned by ``order_id``: the later
    # order-keyed joins then reuse this shuffle instead of repeating it.
    lines = li.withColumnRenamed("l_orderkey", "order_id")
    if buckets:
        lines = lines.repartition(buckets, "order_id")
    item_order = Window.partitionBy("order_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    freight = (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)")
    numbered = lines.withColumn("order_item_id", F.row_number().over(item_order))  # derived columns after the shuffle
    items_full = numbered.select(
        "order_id",
        "order_item_id",
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        freight.alias("freight_value"),
        F.col("l_returnflag").alias("_payment_type"),
        (F.col("l_quantity").cast("int") % 10 + 1).alias("_installments"),
    )
    items = from_item_lines(items_full)

    # ---- products and category translation ----
    p = t["part"]
    products = p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        F.length("p_type").alias("product_description_length"),
        (F.col("p_size") % 5 + 1).alias("product_photos_qty"),
        (F.col("p_size") * 100).cast("decimal(10,2)").alias("product_weight_g"),
        F.col("p_size").cast("decimal(10,2)").alias("product_length_cm"),
        (F.col("p_size") % 10 + 1).cast("decimal(10,2)").alias("product_height_cm"),
        (F.col("p_size") % 7 + 1).cast("decimal(10,2)").alias("product_width_cm"),
    )
    translation = (
        p.select(F.col("p_brand").alias("product_category_name")).distinct()
        .where(~F.col("product_category_name").endswith("5"))
        .select("product_category_name",
                F.concat(F.lit("brand_"), F.substring_index("product_category_name", "#", -1))
                .alias("product_category_name_english"))
    )

    # ---- geography: nation = state, region through the region table ----
    n, r = t["nation"], t["region"]
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
        F.col("n_nationkey").alias("_nationkey"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("state_name"),
        F.col("r_name").alias("region"),
    )
    c, s = t["customer"], t["supplier"]
    customers = c.join(geo, c.c_nationkey == geo._nationkey, "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    sellers = s.join(geo, s.s_nationkey == geo._nationkey, "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.col("state").alias("seller_state"),
    )

    # ---- reviews: small orders have none, large ones have two ----
    first = o.where(F.col("o_totalprice") >= REVIEWED_FROM).select(
        (F.col("o_orderkey") * 10 + 1).alias("review_id"),
        F.col("o_orderkey").alias("order_id"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("review_score"),
        F.timestamp_add("DAY", F.lit(31), F.col("o_orderdate")).alias("review_creation_date"),
    )
    second = o.where(F.col("o_totalprice") >= REVIEWED_TWICE_FROM).select(
        (F.col("o_orderkey") * 10 + 2).alias("review_id"),
        F.col("o_orderkey").alias("order_id"),
        (F.lit(1) + F.dayofmonth("o_orderdate") % 5).cast("int").alias("review_score"),
        F.timestamp_add("DAY", F.lit(32), F.col("o_orderdate")).alias("review_creation_date"),
    )
    order_reviews = first.unionByName(second)

    return {
        "orders": orders,
        **items,
        "order_reviews": order_reviews,
        "products": products,
        "product_category_translation": translation,
        "sellers": sellers,
        "customers": customers,
        "geo": geo.drop("_nationkey"),
        # shared parent of order_items and order_payments (not a source table):
        # a materializing caller writes it once and derives both from it
        "_item_lines": items_full,
        # what the orders are derived from, beside the lines
        "_supplied_orders": o,
    }
