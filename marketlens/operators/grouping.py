"""Grouping operators.

Aggregations are expressed with built-in aggregate functions so Spark plans a
partial (map-side) aggregate before the shuffle: a hot key costs one partial
row per task, not one row per input row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def group_metrics(df: DataFrame, keys, metrics: Mapping[str, Column], *,
                  min_support: tuple[str, float] | None = None,
                  order_by: Sequence | None = None, limit: int | None = None,
                  non_null_keys: bool = False) -> DataFrame:
    """``GROUP BY keys`` with named metrics, optional HAVING, ORDER BY, LIMIT.

    ``min_support=(col, n)`` keeps groups with ``col >= n`` (A7).
    ``non_null_keys`` applies the P3 guard (NOT NULL) to every key first.
    A ``limit`` is only meaningful with an ``order_by`` that ends in a unique
    tie-break, so results are repeatable.
    """
    keys = _cols(keys)
    if non_null_keys:
        for k in keys:
            df = df.where(F.col(k).isNotNull() if isinstance(k, str) else k.isNotNull())
    aggs = [c.alias(n) for n, c in metrics.items()]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if min_support is not None:
        out = out.where(F.col(min_support[0]) >= F.lit(min_support[1]))
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out


def top_n(df: DataFrame, order_by: Sequence, n: int) -> DataFrame:
    """ORDER BY … LIMIT n (planned as TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*order_by).limit(n)


def semi_top_n(df: DataFrame, ranking: DataFrame, key: str, order_by: Sequence, n: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the first ``n`` of ``ranking``.

    The membership list has at most ``n`` rows, a proven bound, so it is
    broadcast and the semi join never shuffles ``df``.
    """
    keys = ranking.orderBy(*order_by).limit(n).select(key)
    return df.join(F.broadcast(keys), key, "left_semi")


def share_of_total(df: DataFrame, value: str, within: Sequence[str] | None, name: str,
                   scale: float = 100.0) -> DataFrame:
    """``value / SUM(value) OVER (PARTITION BY within) * scale``.

    ``df`` is an aggregate (one row per group); with ``within`` the window is
    partitioned by it, otherwise it spans the whole aggregate.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    total = F.sum(value).over(w)
    return df.withColumn(name, F.try_divide(F.col(value).cast("double"), total.cast("double")) * F.lit(scale))


def with_empty_bins(spark, agg: DataFrame, key: str, labels: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Keep every bin label, also those with no rows (``observed=False``).

    The label list is a fixed small table, broadcast to the aggregate.
    """
    bins = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], f"bin_ord int, {key} string")
    out = F.broadcast(bins).join(agg, key, "left")
    for c, v in fill.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def one_per_key(df: DataFrame, key: str, *carry: str) -> DataFrame:
    """One row per key with the smallest of each carried column (L6): for columns that are
    constant within a key, the same as dropping duplicates, and repeatable where they are not."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in carry])


def n_orders(flag: str = "first_of_order") -> Column:
    """Orders of a group, counted by their flagged first items: a plain partial sum.  For groups that
    split an order by category the flag is ``first_in_category``."""
    return F.count(F.when(F.col(flag), 1))


def distinct_per_group(df: DataFrame, key: str, col: str, name: str) -> DataFrame:
    """(key, name): distinct non-NULL values of ``col`` per key, reduced to pairs before they are counted."""
    return df.where(F.col(col).isNotNull()).select(key, col).distinct().groupBy(key).agg(F.count(F.lit(1)).alias(name))
