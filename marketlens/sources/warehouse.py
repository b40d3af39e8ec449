"""Layered Parquet warehouse: partition columns, source snapshots, plain table IO, audits.

ODS tables are day snapshots partitioned by ``etl_date``; the detail fact is
partitioned by purchase year-month; daily marts by ``etl_date``; the other
marts are unpartitioned (S3, S9, S11-S14, S20).  A build publishes them as releases
(``sources/releases.py``); ``write_table`` and ``read_table`` serve scratch copies.

Files are read through Spark only; an absent table is recognised by the
path-not-found condition and nothing else is swallowed.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.releases import CODEC, Release

# Partition column per written table.
PARTITIONS = {
    "dwd_order_detail": ["purchase_year_month"],
    "dws_daily_metrics": ["etl_date"],
    "dws_daily_category": ["etl_date"],
    "dws_daily_state": ["etl_date"],
}
ODS_PARTITION = "etl_date"
#: Micro-batch loads land beside the batch snapshots: a streaming sink's commit
#: log would hide files that a batch job writes into the same folder.
STREAM_PREFIX = "ods_stream_"


def write_table(df: DataFrame, root: str, name: str, partition_by=None) -> str:
    """Write ``df`` as Parquet at ``root/name``.

    The table is replaced whole.  Partitioned rows are rebalanced by their
    partition first, so a partition gets few files and a hot one is split among tasks.
    """
    path = f"{root.rstrip('/')}/{name}"
    cols = partition_by if partition_by is not None else PARTITIONS.get(name)
    if cols:
        df = df.hint("rebalance", *cols)
    w = df.write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "static")
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)
    return path


#: Tables that are written at the same time: small ones fill the cores that another's last tasks leave idle.
WRITERS = 4


def write_tables(tables: Mapping[str, DataFrame], root: str) -> None:
    """Write tables that do not depend on each other as unpartitioned Parquet, some at a time; the first failure is raised."""
    jobs = [inheritable_thread_target(df.sparkSession)(partial(write_table, df, root, name, [])) for name, df in tables.items()]
    with ThreadPool(WRITERS) as pool:
        pool.map(lambda job: job(), jobs, chunksize=1)


def read_table(spark: SparkSession, root: str, name: str, order_by=None) -> DataFrame:
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return df.orderBy(*order_by) if order_by else df


def try_read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table, or None if its folder does not exist or holds no data file yet."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_ods(spark: SparkSession, root: str, table: str, release: Release | None = None, day: str | None = None) -> DataFrame | None:
    """The snapshots of a source table (of one load day, or all): the published days, and the streamed days that no
    batch load replaced."""
    release = release or Release.open(spark, root)
    days = release.days("ods_" + table)
    batch = release.table("ods_" + table, None if day is None else [day])
    stream = try_read(spark, root, STREAM_PREFIX + table)
    if stream is not None:
        stream = stream.where(~F.col(ODS_PARTITION).cast("string").isin(days)) if days else stream
        stream = stream if day is None else stream.where(F.col(ODS_PARTITION) == F.lit(day).cast("date"))
    if batch is None or stream is None:
        return batch if stream is None else stream
    return batch.unionByName(stream, allowMissingColumns=True)


def audit_counts(layers: Mapping[str, Mapping[str, DataFrame | None]]) -> DataFrame:
    """(layer, table, rows) per table; a missing table (None) reports 0 rows."""
    out, spark, missing = None, None, []
    for layer, tables in layers.items():
        for name, df in tables.items():
            if df is None:
                missing.append((layer, name, 0))
                continue
            spark = df.sparkSession
            part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(layer).alias("layer"), F.lit(name).alias("table"), "rows")
            out = part if out is None else out.unionByName(part)
    if missing:
        spark = spark or SparkSession.active()
        zero = spark.createDataFrame(missing, "layer string, table string, rows bigint")
        out = zero if out is None else out.unionByName(zero)
    return out
