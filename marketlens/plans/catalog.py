"""Publishing and running (S17-S19): temp views over the modelled tables, SQL
text against them, and report runs by name prefix."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from marketlens.plans.model import Warehouse


def publish_views(wh: Warehouse) -> list[str]:
    """Register the wide view, the fact, the dims and the marts as temp views."""
    views = {
        "v_order_full": wh.view, "dwd_order_detail": wh.fact, "dim_products": wh.dim_products,
        "dim_customers": wh.dim_customers, "dim_sellers": wh.dim_sellers,
        **{name: wh.mart(name) for name in wh.MARTS},
        **{name: t for name, t in wh.src.items() if not name.startswith("_")},
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    wh.published = sorted(views)
    return wh.published


def run_sql(wh: Warehouse, text: str) -> DataFrame:
    """SQL text over the published views (S17); the views are published once per warehouse.
    ``--`` comments are accepted by the parser."""
    if not getattr(wh, "published", None):
        publish_views(wh)
    return wh.spark.sql(text)


def run_reports(wh: Warehouse, reports: Mapping[str, Callable[[Warehouse], DataFrame]],
                prefix: str = "") -> dict[str, DataFrame]:
    """Plan every report whose name starts with ``prefix`` (S18).  A report that
    fails to plan yields a one-row ``error`` frame instead of stopping the run."""
    out: dict[str, DataFrame] = {}
    for name, fn in reports.items():
        if not name.startswith(prefix):
            continue
        try:
            out[name] = fn(wh)
        except Exception as e:  # noqa: BLE001
            out[name] = wh.spark.createDataFrame([(str(e),)], "error string")
    return out
