"""Bucketing (B1-B9): CASE chains built from edges and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def case_labels(col, upper_bounds: Sequence[float], labels: Sequence[str], else_label: str | None) -> Column:
    """``CASE WHEN x <= b1 THEN l1 WHEN x <= b2 THEN l2 ... ELSE other END``.

    NULL input falls through to ``else_label`` like a SQL CASE.
    """
    x = _c(col)
    if len(labels) != len(upper_bounds):
        raise ValueError("one label per upper bound")
    expr = None
    for b, lab in zip(upper_bounds, labels):
        expr = F.when(x <= F.lit(b), F.lit(lab)) if expr is None else expr.when(x <= F.lit(b), F.lit(lab))
    return expr.otherwise(F.lit(else_label)) if else_label is not None else expr


def bucketize(col, edges: Sequence[float], labels: Sequence[str] | None = None,
              closed: str = "right", include_lowest: bool = False) -> Column:
    """``pd.cut`` semantics: intervals between consecutive edges; outside → NULL.

    ``closed='right'`` gives (a, b]; ``include_lowest`` makes the first [a, b].
    Returns the label, or the interval text ``(a, b]`` when no labels are given.
    """
    x = _c(col)
    n = len(edges) - 1
    if labels is not None and len(labels) != n:
        raise ValueError("need len(edges) - 1 labels")
    expr = None
    for i in range(n):
        lo, hi = edges[i], edges[i + 1]
        if closed == "right":
            lower = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
            cond = lower & (x <= F.lit(hi))
            text = f"({_fmt(lo)}, {_fmt(hi)}]"
        else:
            cond = (x >= F.lit(lo)) & (x < F.lit(hi))
            text = f"[{_fmt(lo)}, {_fmt(hi)})"
        lab = labels[i] if labels is not None else text
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def _fmt(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)
