"""Registry of every report / table as ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.plans.model import Warehouse


def _families():
    from marketlens.plans import ads_reports, marts, py_reports, sql_reports
    return [m.QUERIES for m in (sql_reports, marts, ads_reports, py_reports)]


#: Reports that are also run on a warehouse that was built twice (over changed orders first):
#: tables and marts as stored, and dashboard reports in warehouse mode.
STORED = ("d5_order_detail", "m1_daily_metrics", "m5_category_summary", "s8_warehouse_stats", "q22_overview_kpis", "q30_category_abc",
          "q37_sales_trend", "q43_category_trend", "r01_overview_kpis", "r05_monthly_delivery", "r07_delivery_by_category",
          "r17_category_detail", "r23_correlation_matrix", "r27_weekday_pattern", "r30_order_status_funnel", "r31_rfm_segments")
#: Reports on a warehouse whose last run rebuilt the detail layer only, after a load in which one purchase month was wrong:
#: one month of the fact is rewritten, and marts of the earlier fact must not be seen.
DETAIL_ONLY = ("d5_order_detail", "q22_overview_kpis", "q37_sales_trend", "s8_warehouse_stats")
#: Reports on the stored warehouse above a date floor that lies inside the data.
DATE_FLOOR = "1995-07-15"
ABOVE_FLOOR = ("d5_order_detail", "q42_rfm_data")
#: Reports on the raw-file path: the source tables written as CSV (misspelt headers, multi-line comments) and read back.
FROM_CSV = ("q02_monthly_delivery", "q12_score_by_days_bucket", "r01_overview_kpis")
_built: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, kind: str, sf_dir: str, make: Callable[[str], None]) -> str:
    """The folder of a warehouse that is built once per session."""
    from marketlens.session import ensure_checkpoint_dir
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _built:
        root = f"{ensure_checkpoint_dir(spark)}/warehouse-{uuid.uuid4().hex[:12]}"
        make(root)
        _built[key] = root
    return _built[key]


def built_root(spark: SparkSession, sf_dir: str) -> str:
    """The supplied data as a stored warehouse: a first load has every order 45 days
    later, the second replaces it, so nothing of the first may be seen."""
    from marketlens.plans.pipeline import build
    from marketlens.sources.testdata import order_buckets, source_tables, with_stored_input

    def make(root: str) -> None:
        n = order_buckets(spark, sf_dir)
        src = with_stored_input(source_tables(spark, sf_dir, n), f"{root}-input", n)
        when = "order_purchase_timestamp"
        build(spark, src | {"orders": src["orders"].withColumn(when, F.timestamp_add("DAY", F.lit(45), F.col(when)))}, root, etl_date="2024-01-01",
              order_buckets=n)
        build(spark, src, root, etl_date="2024-01-02", order_buckets=n)
    return _once(spark, "two loads", sf_dir, make)


def built_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse.from_warehouse(spark, built_root(spark, sf_dir), date_floor=None).for_dashboard()


def detail_only_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """A whole load in which the freight of one purchase month is wrong, then the right sources and the detail layer alone."""
    from marketlens.functions.dates import year_month
    from marketlens.plans.pipeline import build
    from marketlens.sources.testdata import order_buckets, source_tables, with_stored_input

    def make(root: str) -> None:
        n = order_buckets(spark, sf_dir)
        src = source_tables(spark, sf_dir, n)
        wrong = src["orders"].where(year_month(F.col("order_purchase_timestamp")) == "1996-03").select("order_id").distinct().withColumn("_wrong", F.lit(1))
        # marked where the lines are clustered by order; payments are made from the right freight
        src = with_stored_input(src | {"_item_lines": src["_item_lines"].join(wrong, "order_id", "left")}, f"{root}-input", n)
        marked, src["order_items"] = src["order_items"], src["order_items"].drop("_wrong")
        freight = F.when(F.col("_wrong").isNull(), F.col("freight_value")).otherwise((F.col("freight_value") + 1).cast(marked.schema["freight_value"].dataType))
        items = marked.withColumn("freight_value", freight).select(*src["order_items"].columns)
        build(spark, src | {"order_items": items}, root, etl_date="2024-01-01", order_buckets=n)
        build(spark, src, root, layer="ods", etl_date="2024-01-02", order_buckets=n)
        build(spark, src, root, layer="dwd", etl_date="2024-01-02")
    return Warehouse.from_warehouse(spark, _once(spark, "detail only", sf_dir, make), date_floor=None)


def above_floor(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse.from_warehouse(spark, built_root(spark, sf_dir), date_floor=DATE_FLOOR)


def csv_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The source tables as raw CSV files; each review has a comment with quotes, commas and line ends."""
    from marketlens.sources.csv import CSV_FILES, HEADER_FIXES, SCHEMAS
    from marketlens.sources.testdata import source_tables, with_stored_lines

    def make(root: str) -> None:
        src = with_stored_lines(source_tables(spark, sf_dir), f"{root}-input")
        comment = F.concat(F.lit('said "fine",\nthen '), F.col("review_id"), F.lit('\n\n"end"'))
        src["order_reviews"] = src["order_reviews"].withColumn("review_comment_message", comment)
        for name, file in CSV_FILES.items():
            df = src[name].select(*[c for c, _ in SCHEMAS[name] if c in src[name].columns])
            df = df.withColumnsRenamed({right: raw for raw, right in HEADER_FIXES.items()})
            df.write.options(header=True, quote='"', escape='"').csv(f"{root}/{file}")
    return Warehouse.from_csv(spark, _once(spark, "csv", sf_dir, make))


def _stored(name: str, fn):
    from marketlens.plans.marts import _out
    marts = {"m1_daily_metrics": "dws_daily_metrics", "m5_category_summary": "dws_category_summary"}
    if name in marts:  # the mart as it was stored
        return lambda wh: _out(wh.mart(marts[name]))
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for fam in _families():
        for name, fn in fam.items():
            out[name] = (lambda f: lambda spark, sf_dir: f(Warehouse.from_testdata(spark, sf_dir)))(fn)
            if name in STORED:
                out[f"w_{name}"] = (lambda f: lambda spark, sf_dir: f(built_warehouse(spark, sf_dir)))(_stored(name, fn))
            if name in DETAIL_ONLY:
                out[f"w_detail_{name}"] = (lambda f: lambda spark, sf_dir: f(detail_only_warehouse(spark, sf_dir)))(fn)
            if name in FROM_CSV:
                out[f"c_{name}"] = (lambda f: lambda spark, sf_dir: f(csv_warehouse(spark, sf_dir)))(fn)
            if name in ABOVE_FLOOR:
                out[f"w_floor_{name}"] = (lambda f: lambda spark, sf_dir: f(above_floor(spark, sf_dir)))(fn)
    return out


def oracle_sql() -> dict[str, str]:
    from marketlens.oracle.prelude import with_prelude
    from marketlens.oracle import ads_reports, marts, py_reports, sql_reports
    bodies = {name: body for m in (sql_reports, marts, ads_reports, py_reports) for name, body in m.SQL.items()}
    return {name: with_prelude(body) for name, body in bodies.items()} | {
        f"w_{name}": py_reports.in_warehouse_mode(bodies[name]) for name in STORED} | {
        f"w_detail_{name}": with_prelude(bodies[name]) for name in DETAIL_ONLY} | {
        f"c_{name}": with_prelude(bodies[name]) for name in FROM_CSV} | {
        f"w_floor_{name}": with_prelude(py_reports.above_floor(bodies[name], DATE_FLOOR)) for name in ABOVE_FLOOR}
