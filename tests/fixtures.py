"""Hand-made mini source tables in the real source shape (FIXTURES.md §1)."""

from datetime import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

ORDERS = [
    # id, customer, status, purchase, carrier, delivered, estimated
    ("o1", "c1", "delivered", dt(2017, 1, 1, 12), dt(2017, 1, 2), dt(2017, 1, 3, 11), dt(2017, 1, 10)),  # N1
    ("o2", "c2", "delivered", dt(2017, 1, 2, 9), dt(2017, 1, 3), dt(2017, 1, 20, 9), dt(2017, 1, 15)),   # late 5
    ("o3", "c3", "delivered", dt(2017, 1, 3, 10), None, None, dt(2017, 1, 20)),                          # N2
    ("o4", "c4", "shipped", dt(2017, 1, 4, 10), dt(2017, 1, 5), dt(2017, 1, 8, 10), dt(2017, 1, 20)),
    ("o5", "c5", "shipped", dt(2017, 1, 5, 10), None, None, dt(2017, 1, 20)),
    ("o6", "c6", "canceled", dt(2017, 1, 6, 10), None, None, dt(2017, 1, 20)),
    ("o7", "c7", "delivered", dt(2017, 1, 7, 10), dt(2017, 1, 8), dt(2017, 1, 7, 9), dt(2017, 1, 20)),   # before purchase
    ("o8", "c8", "delivered", dt(2017, 1, 8, 10), dt(2017, 1, 9), dt(2017, 1, 12, 10), dt(2017, 1, 20)),  # no items
]
ITEMS = [  # order, item, product, seller, price, freight
    ("o1", 1, "p1", "s1", D("10.00"), D("1.00")),
    ("o1", 2, "p2", "s1", D("20.00"), D("2.00")),
    ("o2", 1, "p3", "s2", D("30.00"), D("3.00")),
    ("o3", 1, "p4", "s2", D("40.00"), D("4.00")),
    ("o4", 1, "p1", "s1", D("50.00"), D("5.00")),
    ("o5", 1, "p2", "s2", D("60.00"), D("6.00")),
    ("o6", 1, "p3", "s1", D("70.00"), D("7.00")),
    ("o7", 1, "p1", "s1", D("80.00"), D("8.00")),
]
PAYMENTS = [  # order, seq, type, installments, value
    ("o1", 1, "credit_card", 2, D("20.00")), ("o1", 2, "voucher", 1, D("13.00")),
    ("o2", 1, "boleto", 1, D("33.00")), ("o3", 1, "credit_card", 3, D("44.00")),
    ("o4", 1, "credit_card", 1, D("55.00")), ("o5", 1, "credit_card", 1, D("66.00")),
    ("o7", 1, "credit_card", 1, D("88.00")), ("o8", 1, "credit_card", 1, D("10.00")),
]
REVIEWS = [("r1", "o1", 5), ("r2", "o1", 4), ("r3", "o2", 1), ("r4", "o4", 3), ("r5", "o7", 5)]
PRODUCTS = [  # id, category, weight, l, h, w
    ("p1", "cama_mesa", D("100"), D("10"), D("2"), D("3")),
    ("p2", "sem_traducao", D("200"), D("1"), D("1"), D("1")),
    ("p3", None, D("300"), D("1"), D("1"), D("1")),
    ("p4", "", D("400"), D("1"), D("1"), D("1")),
]
TRANSLATION = [("cama_mesa", "bed_table")]
SELLERS = [("s1", "01310", "sao paulo", "SP"), ("s2", "20000", "rio", "RJ")]
CUSTOMERS = [(f"c{i}", "u1" if i in (1, 2) else f"u{i}", "01310", f"city{i}", "SP" if i != 2 else "RJ")
             for i in range(1, 9)]


def mini_sources(spark):
    ts = "timestamp_ntz"
    orders = spark.createDataFrame(ORDERS, f"""order_id string, customer_id string, order_status string,
        order_purchase_timestamp {ts}, order_delivered_carrier_date {ts}, order_delivered_customer_date {ts},
        order_estimated_delivery_date {ts}""").withColumn("order_approved_at", F.col("order_purchase_timestamp"))
    return {
        "orders": orders,
        "order_items": spark.createDataFrame(ITEMS, """order_id string, order_item_id int, product_id string,
            seller_id string, price decimal(10,2), freight_value decimal(10,2)"""),
        "order_payments": spark.createDataFrame(PAYMENTS, """order_id string, payment_sequential int,
            payment_type string, payment_installments int, payment_value decimal(10,2)"""),
        "order_reviews": spark.createDataFrame(REVIEWS, "review_id string, order_id string, review_score int"),
        "products": spark.createDataFrame(PRODUCTS, """product_id string, product_category_name string,
            product_weight_g decimal(10,2), product_length_cm decimal(10,2), product_height_cm decimal(10,2),
            product_width_cm decimal(10,2)""").withColumn("product_photos_qty", F.lit(1)),
        "product_category_translation": spark.createDataFrame(
            TRANSLATION, "product_category_name string, product_category_name_english string"),
        "sellers": spark.createDataFrame(SELLERS, """seller_id string, seller_zip_code_prefix string,
            seller_city string, seller_state string"""),
        "customers": spark.createDataFrame(CUSTOMERS, """customer_id string, customer_unique_id string,
            customer_zip_code_prefix string, customer_city string, customer_state string"""),
    }
