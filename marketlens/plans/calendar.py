"""Calendar dimension (D1 / S16): one row per day, generated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.dates import iso_weekday, year_month


def calendar(spark: SparkSession, start: Column | None, end: Column | None,
             span: DataFrame | None = None) -> DataFrame:
    """Days from ``start`` to ``end`` inclusive, or over a one-row ``span`` (s, e).

    Year, quarter, month, month name, ISO week, day, ISO weekday (1 = Monday),
    day name, weekend flag, year-month.
    """
    base = span if span is not None else spark.range(1).select(start.alias("s"), end.alias("e"))
    days = base.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("date_id"))
    d = F.col("date_id")
    wd = iso_weekday(d)
    return days.select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"), wd.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.when(wd >= 6, 1).otherwise(0).alias("is_weekend"),
        year_month(d).alias("year_month"),
    )
