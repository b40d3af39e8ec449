"""Mergeable exact distinct counts: bitmaps of dense numbers per group, rolled up by OR.

Distinct counts of days do not add up to those of a month; bitmaps of days do.  Values are numbered
1, 2, ... once (``number_values``); a group then holds one bitmap of 32,768 bits for each run of
numbers it has a value in, so a row's size is fixed and a group's grows with its values only.
``roll_up`` merges bitmaps to coarser groups and ``count_values`` counts them, without the rows
that they were made from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ranking import global_row_number


def number_values(values: DataFrame, key: str, near: Sequence[str] = ()) -> DataFrame:
    """(key, number): the distinct non-NULL values of ``key`` numbered from 1.

    Values that share the columns ``near`` (a customer's state, say) get neighbouring numbers, so
    groups by these columns touch few bitmaps.  ``values`` has one row per value.
    """
    some = values.where(F.col(key).isNotNull()).select(key, *near)
    return global_row_number(some, [*[F.col(c).asc_nulls_first() for c in near], F.col(key)], "number").select(key, "number")


def bitmaps(df: DataFrame, by: Sequence[str | Column], number: str = "number") -> DataFrame:
    """(by, bucket, bitmap): the numbers of each group; rows without a number are left out.

    Partial bitmaps are built by each task, so a hot group sends one bitmap per task and bucket.
    """
    return (df.where(F.col(number).isNotNull())
            .groupBy(*by, F.bitmap_bucket_number(F.col(number)).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("bitmap")))


def roll_up(parts: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups, from those of finer ones."""
    return parts.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_values(parts: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """(by, name): distinct values per group of ``by``; a group without bitmaps has no row."""
    merged = roll_up(parts, by)
    keys = [c for c in merged.columns if c not in ("bucket", "bitmap")]
    return merged.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
