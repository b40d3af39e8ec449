"""Mergeable moments: counts, means and centred products per group, combined to those of all rows.

A table of moments has one row per group (a month, say).  A correlation matrix or a least-squares
line is then read from these rows instead of the data, and a changed group replaces its own row.

Columns: the group's, ``n``, and for columns a, b of the set ``mean_a``, ``lo_a``, ``hi_a`` and, for
each pair in the set's order, ``a__b`` = Σ(a − mean_a)(b − mean_b).  Rows with a NULL in any column
of the set are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def moments(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Moments of ``cols`` per group.

    Sums run over differences from the overall means (one scalar subquery), which lie
    near each group's, so the correction to the group's own mean takes little away.
    """
    d = df.selectExpr(*by, *[f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in cols]).dropna(subset=list(cols))
    # by group first: both passes then read the same columns, and a shuffle below them is made once
    totals = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols])
    mean = totals.selectExpr("struct(" + ", ".join(f"sum(`{c}`) / sum(n) AS `{c}`" for c in cols) + ") AS m").scalar()
    sums = d.select(*by, *cols, *[(F.col(c) - mean[c]).alias(f"d_{c}") for c in cols]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"{f}(`{c}`)").alias(f"{name}_{c}") for c in cols for f, name in (("min", "lo"), ("max", "hi"))],
        *[F.expr(f"sum(`d_{c}`)").alias(f"d_{c}") for c in cols],
        *[F.expr(f"sum(`d_{a}` * `d_{b}`)").alias(f"{a}__{b}") for a, b in _pairs(cols)])

    def product(a, b):
        x = f"`{a}__{b}` - `d_{a}` * `d_{b}` / n"
        return F.expr(f"greatest({x}, 0.0D)" if a == b else x).alias(f"{a}__{b}")

    return sums.select(*by, "n", *[(mean[c] + F.col(f"d_{c}") / F.col("n")).alias(f"mean_{c}") for c in cols],
                       *[f"{name}_{c}" for c in cols for name in ("lo", "hi")], *[product(a, b) for a, b in _pairs(cols)])


def merge_moments(parts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The one-row moments of all groups together (n = 0 and NULLs for none).

    The products of a union are the groups' products and, for each group, n times the
    product of its means' distances from the overall means.  One pass over ``parts``; their
    means are held in one row, so groups are to be few, as the months of a calendar are.
    """
    whole = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        *[F.expr(f"try_divide(sum(n * `mean_{c}`), sum(n))").alias(f"mean_{c}") for c in cols],
        *[F.expr(f"{f}(`{name}_{c}`)").alias(f"{name}_{c}") for c in cols for f, name in (("min", "lo"), ("max", "hi"))],
        *[F.expr(f"sum(`{a}__{b}`)").alias(f"{a}__{b}") for a, b in _pairs(cols)],
        F.collect_list(F.struct("n", *[f"mean_{c}" for c in cols])).alias("_parts"))

    def between(a, b):
        return (f"aggregate(_parts, 0.0D, (s, p) -> s + p.n * (p.`mean_{a}` - `mean_{a}`) * (p.`mean_{b}` - `mean_{b}`))")

    return whole.selectExpr("n", *[f"mean_{c}" for c in cols], *[f"{name}_{c}" for c in cols for name in ("lo", "hi")],
                            *[f"`{a}__{b}` + {between(a, b)} AS `{a}__{b}`" for a, b in _pairs(cols)])


def corr_from_moments(total: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (var1, var2, r) of a one-row table of moments; as ``stats.corr_matrix``:
    NaN where a column is constant (on the diagonal too), NULL on no rows."""
    at = {c: i for i, c in enumerate(cols)}

    def r(a, b):
        x, y = sorted((a, b), key=at.get)
        value = "1.0D" if a == b else f"try_divide(`{x}__{y}`, sqrt(`{x}__{x}` * `{y}__{y}`))"
        return (f"CASE WHEN `lo_{a}` = `hi_{a}` OR `lo_{b}` = `hi_{b}` THEN CAST('NaN' AS DOUBLE) "
                f"WHEN n > 0 THEN {value} END")

    stack = ", ".join(f"'{a}', '{b}', {r(a, b)}" for a in cols for b in cols)
    return total.selectExpr(f"stack({len(cols) ** 2}, {stack}) AS (var1, var2, r)")


def linreg_from_moments(total: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares y ~ x of a one-row table of the moments of (x, y): the columns of ``stats.linreg``."""
    varies = f"`lo_{x}` < `hi_{x}`"
    slope = f"CASE WHEN {varies} THEN try_divide(`{x}__{y}`, `{x}__{x}`) END"
    r = f"CASE WHEN {varies} AND `lo_{y}` < `hi_{y}` THEN try_divide(`{x}__{y}`, sqrt(`{x}__{x}` * `{y}__{y}`)) END"
    out = total.selectExpr("*", f"{slope} AS slope", f"{r} AS r").selectExpr(
        "n", "slope", f"`mean_{y}` - slope * `mean_{x}` AS intercept", "r", f"`lo_{x}` AS x_min", f"`hi_{x}` AS x_max",
        f"CASE WHEN n > 2 THEN sqrt((1.0D - r * r) * `{y}__{y}` / nullif(`{x}__{x}`, 0.0D) / (n - 2)) END AS stderr")
    return out.select("n", "slope", "intercept", "r", "x_min", "x_max", "stderr")
