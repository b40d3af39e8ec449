"""Incremental ODS ingest: raw CSV files landing per table → typed Parquet
partitioned by ``etl_date`` (S3 as a stream).

Each micro-batch reads only new files (the file source tracks them in the
checkpoint), converts them with the same typing rules as the batch CSV path,
stamps the load date and appends a partition.  The checkpoint makes the sink
exactly-once across restarts and executor loss.  The sink has a folder of its
own (its commit log would hide files that batch loads write); readers take the
streamed days beside the batch days (``read_ods``).  ``available_now`` processes
everything that has landed and stops — the streaming twin of the nightly
batch load; without it the query keeps running on a processing-time trigger.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.sources.csv import MULTILINE, raw_schema, typed
from marketlens.sources.warehouse import ODS_PARTITION, STREAM_PREFIX


def start_ods_ingest(spark: SparkSession, landing: str, table: str, out_root: str, checkpoint: str,
                     etl_date: str | None = None, available_now: bool = True,
                     interval: str = "1 minute", max_files_per_trigger: int | None = None) -> StreamingQuery:
    reader = (spark.readStream.schema(raw_schema(table)).option("header", True)
              .option("multiLine", table in MULTILINE).option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = typed(reader.csv(f"{landing.rstrip('/')}/{table}"), table)
    stamp = F.lit(etl_date).cast("date") if etl_date else F.current_date()
    writer = (rows.withColumn(ODS_PARTITION, stamp).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint).partitionBy(ODS_PARTITION).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(f"{out_root.rstrip('/')}/{STREAM_PREFIX}{table}")
