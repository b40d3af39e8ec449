"""Spark session helpers.

The library never assumes a machine-local folder on a cluster: lineage is cut
with ``checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only when that is unset (local tests) do we create
one under the system temp folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


# Broadcast joins are chosen only on *measured* sizes: the planner's static
# estimate (compressed file bytes × pruned-column ratio) can call a table that
# grows with the data small, and a static broadcast is never undone.  AQE
# decides after the shuffle map stage has run, from the bytes it really wrote.
RUNTIME_BROADCAST_BYTES = 10 * 1024 * 1024


def get_spark(master: str | None = None, app: str = "marketlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session tuned for the library: AQE on, UI off, UTC, ANSI on (the default),
    broadcast joins only from runtime sizes (explicit hints on proven-small
    sides still apply).

    The master, the driver's memory and the number of shuffle partitions are the
    cluster's (spark-submit, spark-defaults); they are set only where a caller
    passes them, as local runs do (``$SPARK_DRIVER_MEMORY`` for the memory)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(RUNTIME_BROADCAST_BYTES),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and "SPARK_DRIVER_MEMORY" in os.environ:
        settings["spark.driver.memory"] = os.environ["SPARK_DRIVER_MEMORY"]
    for k, v in {**settings, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    A temp folder serves a local master only: on a cluster each executor would
    write to a disk that the others cannot read, so there it raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
