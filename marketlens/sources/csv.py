"""CSV source path (S1, S2, S4, S5): eight raw files → typed DataFrames.

Every column is read as text, misspelt headers are renamed, then each column
is converted by name with ``try_cast`` (unparseable → NULL), so column order
in the file does not matter and zip prefixes keep their leading zeros (N26).
Only the review file's free text may hold quoted newlines; it is split all the same
(``quoted_csv``; ``multiLine`` would give a file to one task).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.quoted_csv import read_quoted_csv

# Raw file per source table.
CSV_FILES = {
    "customers": "olist_customers_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "product_category_translation": "product_category_name_translation.csv",
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
}

# Misspelt raw headers and their corrected names.
HEADER_FIXES = {
    "product_name_lenght": "product_name_length",
    "product_description_lenght": "product_description_length",
}

TS = "timestamp_ntz"
MONEY = "decimal(10,2)"
# Column types of the source shape (FIXTURES.md §1).
SCHEMAS = {
    "customers": [("customer_id", "string"), ("customer_unique_id", "string"),
                  ("customer_zip_code_prefix", "string"), ("customer_city", "string"), ("customer_state", "string")],
    "sellers": [("seller_id", "string"), ("seller_zip_code_prefix", "string"), ("seller_city", "string"),
                ("seller_state", "string")],
    "products": [("product_id", "string"), ("product_category_name", "string"), ("product_name_length", "int"),
                 ("product_description_length", "int"), ("product_photos_qty", "int"),
                 ("product_weight_g", MONEY), ("product_length_cm", MONEY), ("product_height_cm", MONEY),
                 ("product_width_cm", MONEY)],
    "product_category_translation": [("product_category_name", "string"),
                                     ("product_category_name_english", "string")],
    "orders": [("order_id", "string"), ("customer_id", "string"), ("order_status", "string"),
               ("order_purchase_timestamp", TS), ("order_approved_at", TS), ("order_delivered_carrier_date", TS),
               ("order_delivered_customer_date", TS), ("order_estimated_delivery_date", TS)],
    "order_items": [("order_id", "string"), ("order_item_id", "int"), ("product_id", "string"),
                    ("seller_id", "string"), ("shipping_limit_date", TS), ("price", MONEY),
                    ("freight_value", MONEY)],
    "order_payments": [("order_id", "string"), ("payment_sequential", "int"), ("payment_type", "string"),
                       ("payment_installments", "int"), ("payment_value", MONEY)],
    "order_reviews": [("review_id", "string"), ("order_id", "string"), ("review_score", "int"),
                      ("review_comment_title", "string"), ("review_comment_message", "string"),
                      ("review_creation_date", TS), ("review_answer_timestamp", TS)],
}
MULTILINE = {"order_reviews"}


def raw_schema(name: str) -> str:
    """All-text schema of a raw file in its column order (misspelt headers kept)."""
    fixes = {v: k for k, v in HEADER_FIXES.items()}
    return ", ".join(f"`{fixes.get(c, c)}` string" for c, _ in SCHEMAS[name])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name in MULTILINE:
        return typed(read_quoted_csv(spark, path), name)
    return typed(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), name)


def typed(raw: DataFrame, name: str) -> DataFrame:
    """Rename misspelt headers and convert each column by name (bad values → NULL)."""
    raw = raw.withColumnsRenamed({k: v for k, v in HEADER_FIXES.items() if k in raw.columns})
    cols = []
    for col, typ in SCHEMAS[name]:
        if col not in raw.columns:
            cols.append(F.lit(None).cast(typ).alias(col))
        elif typ == "string":
            cols.append(F.col(col))
        else:
            cols.append(F.expr(f"try_cast(trim(`{col}`) AS {typ})").alias(col))
    return raw.select(*cols)


def load_raw(spark: SparkSession, root: str, report: list | None = None) -> dict[str, DataFrame]:
    """Read every present source file; a missing file is skipped and listed in
    ``report`` (S2)."""
    out: dict[str, DataFrame] = {}
    for name, fname in CSV_FILES.items():
        try:
            out[name] = read_table(spark, f"{root.rstrip('/')}/{fname}", name)
        except AnalysisException as e:  # Spark looks on the path's own file system
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if report is not None:
                report.append(name)
    if "product_category_translation" not in out and "products" in out:
        out["product_category_translation"] = spark.createDataFrame(
            [], "product_category_name string, product_category_name_english string")
    return out
