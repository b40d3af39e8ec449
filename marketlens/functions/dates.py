"""Date features.

All functions work on ``TIMESTAMP_NTZ`` / ``DATE`` columns and stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_diff(end, start, mode: str = "calendar") -> Column:
    """Whole days from ``start`` to ``end``.

    ``calendar`` counts midnights crossed (SQL ``DATEDIFF``); ``elapsed``
    floors the elapsed time (pandas ``.dt.days``); ``fractional`` keeps the
    fraction (Julian-day difference).  47 hours across two
    midnights is 2 calendar days but 1 elapsed day.
    """
    end, start = _c(end), _c(start)
    if mode == "calendar":
        return F.datediff(F.to_date(end), F.to_date(start))
    if mode == "elapsed":
        secs = F.timestamp_diff("SECOND", start, end)
        return F.floor(secs / F.lit(86400)).cast("int")
    if mode == "fractional":  # julianday(a) - julianday(b)
        return F.timestamp_diff("SECOND", start, end) / F.lit(86400.0)
    raise ValueError(f"unknown day_diff mode {mode!r}")


def late_flag(actual, promised) -> Column:
    """1 when delivered after the promise, else 0 (NULL compares as not late)."""
    return F.when(_c(actual) > _c(promised), F.lit(1)).otherwise(F.lit(0))


def days_late(actual, promised, mode: str = "calendar") -> Column:
    """Days past the promise floored at 0; NULL stays NULL (guards N2)."""
    d = day_diff(actual, promised, mode)
    return F.when(d.isNull(), F.lit(None).cast("int")).otherwise(F.greatest(d, F.lit(0)))


def weekday_sun1(ts) -> Column:
    """SQL ``DAYOFWEEK``: 1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(_c(ts))


def weekday_mon0(ts) -> Column:
    """pandas ``dayofweek``: 0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(ts))


def iso_weekday(ts) -> Column:
    """``isoweekday``: 1 = Monday ... 7 = Sunday."""
    return F.weekday(_c(ts)) + F.lit(1)


def year_month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def mysql_week(d) -> Column:
    """MySQL ``WEEK(d, 1)``: weeks start Monday, week 1 is the first with
    4+ days in the year, earlier days are week 0, no carry into next year."""
    d = F.to_date(_c(d))
    jan1 = F.make_date(F.year(d), F.lit(1), F.lit(1))
    wd = F.weekday(jan1)  # 0 = Monday
    return (F.floor((F.dayofyear(d) - 1 + wd) / 7) + F.when(wd <= 3, 1).otherwise(0)).cast("int")


def year_week(d) -> Column:
    """``YYYY-Www`` label used by the weekly mart."""
    return F.concat(F.year(F.to_date(_c(d))).cast("string"), F.lit("-W"),
                    F.lpad(mysql_week(d).cast("string"), 2, "0"))
