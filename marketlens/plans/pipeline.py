"""Layered build (S3, S6, S15): sources → ODS → DWD → DWS as Parquet tables.

Each layer is computed from the *written* previous layer, as the source system
does; a written table also cuts lineage, so losing an executor costs at most
the current layer's tasks.  One load date is fixed at the start and passed through all layers.

A run writes new load folders and publishes them as one release at its end: a run that dies leaves
the release before it as it was.  Of the fact only the months whose rows differ from the last
release are written.  Every table names the fact it was computed from, so readers never take marts
or dimensions of another load.
"""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.plans import marts
from marketlens.plans.model import Warehouse
from marketlens.sources.releases import Load, Release
from marketlens.sources.warehouse import ODS_PARTITION, PARTITIONS, STREAM_PREFIX, read_ods, try_read

LAYERS = ("ods", "dwd", "dws")
ODS_TABLES = ("customers", "sellers", "products", "product_category_translation", "orders", "order_items",
              "order_payments", "order_reviews")
#: Tables that a detail layer cannot do without; the others may be empty on a day.
REQUIRED = ("customers", "sellers", "products", "orders", "order_items")
#: Tables whose snapshots may lie in buckets by order id.
BY_ORDER = ("orders", "order_items", "order_payments")


def newest_day(spark: SparkSession, root: str, table: str, release: Release) -> str | None:
    """The newest load day of a source table, published or streamed."""
    days = release.days(f"ods_{table}")[-1:]
    stream = try_read(spark, root, STREAM_PREFIX + table)
    if stream is not None and (last := stream.agg(F.max(ODS_PARTITION)).first()[0]) is not None:  # one value
        days.append(str(last))
    return max(days, default=None)


def ods_snapshot(spark: SparkSession, root: str, etl_date: str | None = None,
                 release: Release | None = None) -> tuple[dict[str, DataFrame], str]:
    """The source tables of one load day, and the day (default: the newest day of ``orders``).

    A required table without rows for that day raises: a detail layer built on
    nothing would empty the dimensions and the fact without a sign.
    """
    release = release or Release.open(spark, root)
    if etl_date is None:
        etl_date = newest_day(spark, root, "orders", release)
        if etl_date is None:
            raise LookupError(f"no ODS snapshot of 'orders' under {root}")
    out = {t: df for t in ODS_TABLES if (df := read_ods(spark, root, t, release, etl_date)) is not None}
    absent = [t for t in REQUIRED if not release.rows(f"ods_{t}", [etl_date]) and (t not in out or out[t].isEmpty())]
    if absent:
        raise LookupError(f"no ODS snapshot of {etl_date} for {', '.join(absent)}")
    return {t: df.drop(ODS_PARTITION) for t, df in out.items()}, etl_date


def build(spark: SparkSession, src: dict[str, DataFrame], root: str, layer: str | None = None,
          etl_date: str | None = None, order_buckets: int | None = None) -> DataFrame:
    """Build one layer or all (``layer=None``) under ``root`` and publish them as one release; returns the
    (layer, table, rows) audit of the run's layers for its load date, from the counts of the writing jobs.

    ``etl_date`` defaults to today for a load of sources; a single later layer
    takes the newest snapshot (DWD) or the fact's own date (DWS).  ``order_buckets``: the orders, items and payments of
    ``src`` lie in so many buckets by order id (``testdata.with_stored_input``); their snapshots are kept so, and the
    detail layer then joins them where they lie."""
    if layer is not None and layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; expected one of {LAYERS}")
    todo = LAYERS if layer is None else (layer,)
    load, etl, audit = Load(spark, root), etl_date, []

    if "ods" in todo:
        etl = etl or datetime.date.today().isoformat()
        for t in ODS_TABLES:
            if t in src:
                kept = {"cluster": "order_id", "buckets": order_buckets} if order_buckets and t in BY_ORDER else {}
                load.replace_day(f"ods_{t}", src[t].withColumn(ODS_PARTITION, F.lit(etl).cast("date")), ODS_PARTITION, etl, **kept)
                audit.append(("ODS", f"ods_{t}", load.state.rows(f"ods_{t}", [etl])))

    if "dwd" in todo:
        sources, etl = ods_snapshot(spark, root, etl, load.state)
        wh = Warehouse(spark, sources, etl_date=etl)
        wh.order_buckets = load.state.buckets([f"ods_{t}" for t in BY_ORDER], etl)
        wh.known_rows = {f"ods_{t}": load.state.rows(f"ods_{t}", [etl]) for t in sources}
        load.replace_changed(FACT, wh.fact_base(), PARTITIONS[FACT][0], etl, wh._as_fact, ignore=("etl_date",))
        wh.__dict__["fact"] = stored_fact(load.state)  # the dimensions' order counts read it back
        basis = fact_basis(load.state)
        for name, df in (("dim_customers", wh.dim_customers), ("dim_products", wh.dim_products),
                         ("dim_sellers", wh.dim_sellers), ("dim_dates", wh.dim_dates_for_orders())):
            load.replace(name, df, etl, basis)
        audit += [("DWD", n, load.state.rows(n)) for n in ("dim_customers", "dim_products", "dim_sellers", "dim_dates", FACT)]

    if "dws" in todo:
        fact = stored_fact(load.state)
        if fact is None:
            raise LookupError(f"no stored fact under {root}")
        held = fact_day(load.state)
        if etl is not None and held != etl:
            raise LookupError(f"the stored fact is of {held}, not of {etl}")
        etl, basis = held, fact_basis(load.state)
        wh = Warehouse(spark, {}, etl_date=etl)
        wh.__dict__["fact"] = fact
        for name in Warehouse.MARTS:  # each from the written ones before it
            df = wh.mart(name)
            wh.stored[name] = (load.replace_day(name, df, ODS_PARTITION, etl, basis) if name in PARTITIONS else
                               load.replace(name, df, etl, basis))
        audit += [("DWS", n, load.state.rows(n, None if n not in PARTITIONS else [etl])) for n in Warehouse.MARTS]

    load.publish()
    return spark.createDataFrame(audit, "layer string, table string, rows bigint")


FACT = "dwd_order_detail"


def fact_day(release: Release) -> str | None:
    """The load day that the stored fact was last built for (kept months are confirmed by each build)."""
    return max((e.day for e in release.parts(FACT).values()), default=None)


def fact_basis(release: Release) -> str:
    """Identity of the stored fact: its load day and the content of its months."""
    return f"{fact_day(release)}|{hashlib.sha256(release.content(FACT).encode()).hexdigest()}"


def stored_fact(release: Release) -> DataFrame | None:
    """The stored fact; its load date is the release's, also in months that were kept."""
    fact = release.table(FACT)
    return None if fact is None else fact.withColumn("etl_date", F.lit(fact_day(release)).cast("date"))
