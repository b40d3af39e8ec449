"""Column-level helpers (pure ``pyspark.sql.functions`` expressions)."""

from marketlens.functions.dates import (
    day_diff, late_flag, days_late, mysql_week, year_week, iso_weekday,
    weekday_sun1, weekday_mon0, year_month,
)
from marketlens.functions.numeric import rnd, ratio, fdiv, as_double
from marketlens.functions.buckets import bucketize, case_labels

__all__ = [
    "day_diff", "late_flag", "days_late", "mysql_week", "year_week", "iso_weekday",
    "weekday_sun1", "weekday_mon0", "year_month", "rnd", "ratio", "fdiv", "as_double",
    "bucketize", "case_labels",
]
