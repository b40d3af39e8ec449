"""Global ranking operators.

A window with ``ORDER BY`` and no ``PARTITION BY`` runs in a single task
(``Exchange SinglePartition``).  That is fine over a small aggregate (one row
per category), not over customers.  ``global_row_number`` numbers rows in a
total order without a single-partition step:

1. range-partition by the ordering columns (the last one a unique key) and
   sort inside each partition;
2. tag each row with its partition id and a per-partition position
   (``monotonically_increasing_id`` keeps partition order), and cut lineage
   with a reliable ``checkpoint()`` so the range bounds (sampled) cannot
   change if a task is retried;
3. count rows per partition (one row per partition → a proven-small table),
   prefix-sum the counts and broadcast the offsets back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.selection import values_at
from marketlens.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order_by: Sequence[Column], name: str = "rn",
                      num_partitions: int | None = None, stable_input: bool = False) -> DataFrame:
    """Exact ``ROW_NUMBER() OVER (ORDER BY order_by)``, distributed.

    ``order_by`` must define a total order (end with a unique key).
    ``stable_input=True`` states that ``df`` yields the same rows in the same
    partition order on every evaluation (a checkpointed / written table, or
    the output of another ranking, which is sorted within its partitions);
    the range bounds are then reproducible and the checkpoint is skipped.
    Use it for a single ranking over a written table; chained rankings should
    keep their checkpoints, or every ranking re-plans the ones before it.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    if not stable_input:
        ensure_checkpoint_dir(spark)
        tagged = tagged.checkpoint(eager=True)
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_base"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (tagged.join(F.broadcast(offsets.select("_pid", "_base", "_off")), "_pid")
            .withColumn(name, (F.col("_mid") - F.col("_base") + F.col("_off") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_base", "_off"))


def ntile_of(rn: Column, n: Column, k: int) -> Column:
    """``NTILE(k)`` from a 1-based row number and the row count.

    The first ``n mod k`` tiles get one extra row.
    """
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return (F.when(q == 0, rn)
            .when(rn <= big, F.ceil(rn / (q + 1)))
            .otherwise(r + F.ceil((rn - big) / q))).cast("int")


def global_ntile(df: DataFrame, order_by: Sequence[Column], k: int, name: str,
                 num_partitions: int | None = None, stable_input: bool = False) -> DataFrame:
    """Exact ``NTILE(k) OVER (ORDER BY order_by)`` without a single-partition window."""
    ranked = global_row_number(df, order_by, "_rn", num_partitions, stable_input)
    n = ranked.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    return ranked.withColumn(name, ntile_of(F.col("_rn"), n, k)).drop("_rn")


def rank_qcut(df: DataFrame, order_by: Sequence[Column], k: int, name: str,
              labels: Sequence[int] | None = None, num_partitions: int | None = None,
              stable_input: bool = False) -> DataFrame:
    """``pd.qcut(x.rank(method='first'), k, labels)``.

    Bin edges are the linear quantiles of ranks 1..n, right-closed, first bin
    includes the minimum: bin = max(1, ceil(k * (rn - 1) / (n - 1))).
    """
    ranked = global_row_number(df, order_by, "_rn", num_partitions, stable_input)
    n = ranked.agg(F.count(F.lit(1))).scalar()
    b = F.greatest(F.lit(1), F.ceil(F.lit(k) * (F.col("_rn") - 1) / (n - 1))).cast("int")
    b = F.when(n == 1, F.lit(1)).otherwise(b)
    if labels is not None:
        b = F.element_at(F.array(*[F.lit(x) for x in labels]), b)
    return ranked.withColumn(name, b).drop("_rn")


def value_qcut(df: DataFrame, col: str, k: int, name: str, labels: Sequence[int] | None = None) -> DataFrame:
    """``pd.qcut(x, k, labels)`` on values (W6): edges are exact linear
    percentiles selected by counting, bins right-closed, the first
    includes the minimum.  Duplicate edges make pandas raise; here the value
    falls in the first bin whose upper edge it does not exceed.
    """
    found = values_at(df, col, [i / k for i in range(1, k)])
    edges = [F.lit((1 - part) * low + part * high) for low, high, part in found] if found else [F.lit(None).cast("double")] * (k - 1)
    x = F.col(col).cast("double")
    expr = None
    for i in range(k - 1):
        cond = x <= edges[i]
        expr = F.when(cond, F.lit(i + 1)) if expr is None else expr.when(cond, F.lit(i + 1))
    b = expr.otherwise(F.lit(k))
    b = F.when(x.isNull(), F.lit(None)).otherwise(b)
    if labels is not None:
        b = F.element_at(F.array(*[F.lit(v) for v in labels]), b)
    return df.withColumn(name, b)


def pareto(df: DataFrame, key: str, measure: str, frame: str = "rows", scale: float = 100.0,
           share: str = "share", cum: str = "cum_share", rank: str | None = None) -> DataFrame:
    """Share and running share of ``measure``, largest first.

    ``frame='range'`` gives tied values the same running total (SQL default
    frame); ``'rows'`` accumulates row by row with ``key`` as tie-break.
    ``df`` is an aggregate (one row per key): the global window is over a
    small table.
    """
    order = [F.col(measure).desc(), F.col(key).asc()]
    w_all = Window.partitionBy()
    if frame == "range":
        w_cum = Window.orderBy(F.col(measure).desc())
    elif frame == "rows":
        w_cum = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        raise ValueError(frame)
    total = F.sum(measure).over(w_all).cast("double")
    out = (df.withColumn(share, F.col(measure).cast("double") / total * F.lit(scale))
           .withColumn(cum, F.sum(measure).over(w_cum).cast("double") / total * F.lit(scale)))
    if rank:
        out = out.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    return out


def abc_classify(cum: Column | str, bounds=(0.7, 0.9), labels=("A", "B", "C")) -> Column:
    """cum ≤ bounds[0] → A, ≤ bounds[1] → B, else C."""
    c = F.col(cum) if isinstance(cum, str) else cum
    return (F.when(c <= F.lit(bounds[0]), labels[0])
            .when(c <= F.lit(bounds[1]), labels[1]).otherwise(labels[2]))


def exact_percentile(df: DataFrame, col: str, p: float) -> Column:
    """Exact linear-interpolation percentile of a numeric column, as a literal column (null without values).

    Selected by counting passes over the value counts (``selection``): no task holds or
    sorts the distinct values, whatever the column."""
    found = values_at(df, col, [p])
    if found is None:
        return F.lit(None).cast("double")
    low, high, part = found[0]
    return F.lit(low + (high - low) * part)
