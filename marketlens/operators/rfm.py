"""RFM scoring (Q21, Q42, R31; N10, N25).

``rfm`` reduces a detail frame to one row per customer: recency (days from a
reference date), frequency (distinct orders) and monetary (sum of an amount).
``rfm_score`` adds quartile-style scores either with SQL ``NTILE`` semantics
or with pandas ``qcut`` semantics — both by selected cuts (no sort and no window
over customers) and both with the customer id as tie order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.operators.ranking import value_qcut
from marketlens.operators.selection import Order, rank_bin_ends, tile_ends, tiles, written


def rfm(df: DataFrame, customer: str, order_id: str, ts: str, amount: str, *,
        ref: Column | str | None = None, ref_offset_days: int = 0, recency: str = "calendar",
        null_amount_as_zero: bool = False) -> DataFrame:
    """(customer, recency, frequency, monetary).

    ``ref`` — a date / timestamp literal or Column; default the latest ``ts``
    in ``df`` (a scalar subquery) plus ``ref_offset_days``.  ``recency`` —
    ``'calendar'`` (DATEDIFF), ``'elapsed'`` (floored elapsed days) or
    ``'fractional'`` (elapsed days with their fraction).
    """
    t = F.col(ts)
    if ref is None:
        ref_col = df.agg(F.max(t)).scalar()
    elif isinstance(ref, str):
        ref_col = F.lit(ref).cast("timestamp_ntz")
    else:
        ref_col = ref
    if ref_offset_days:
        ref_col = F.timestamp_add("DAY", F.lit(ref_offset_days), ref_col)
    last = F.max(t)
    if recency == "calendar":
        rec = F.datediff(F.to_date(ref_col), F.to_date(last))
    elif recency == "elapsed":
        rec = F.floor(F.timestamp_diff("SECOND", last, ref_col) / 86400).cast("int")
    elif recency == "fractional":
        rec = F.timestamp_diff("SECOND", last, ref_col) / F.lit(86400.0)
    else:
        raise ValueError(recency)
    money = F.sum(amount)
    if null_amount_as_zero:
        money = F.coalesce(money, F.lit(0))
    return df.groupBy(customer).agg(rec.alias("recency"), F.countDistinct(order_id).alias("frequency"),
                                    money.alias("monetary"))


def rfm_score(base: DataFrame, customer: str, scoring: str = "ntile", k: int = 4) -> DataFrame:
    """Adds r_score, f_score, m_score (1 = worst, k = best), rfm_total and segment.

    ``ntile``: NTILE(k) over recency descending, frequency and monetary
    ascending.  ``qcut``: recency by value quartiles (labels k..1), frequency
    and monetary by first-come rank quartiles.
    """
    table = written(base, "rfm")  # a row per customer, read by each counting pass
    n = table.count()
    recency, frequency, monetary = (Order("recency", customer, desc=True, nulls_first=False), Order("frequency", customer),
                                    Order("monetary", customer))
    if scoring == "ntile":
        ends = tile_ends(n, k)
        s = tiles(table, {"r_score": (recency, ends), "f_score": (frequency, ends), "m_score": (monetary, ends)})
    elif scoring == "qcut":
        ends = rank_bin_ends(n, k)
        s = tiles(table, {"f_score": (frequency, ends), "m_score": (monetary, ends)})
        s = value_qcut(s, "recency", k, "r_score", labels=list(range(k, 0, -1)))
    else:
        raise ValueError(scoring)
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return s.withColumn("rfm_total", total).withColumn("segment", rfm_segment(total))


def rfm_segment(total: Column) -> Column:
    hi, mid, low = L.RFM_BOUNDS
    a, b, c, d = L.RFM_LABELS
    return F.when(total >= hi, a).when(total >= mid, b).when(total >= low, c).otherwise(d)
