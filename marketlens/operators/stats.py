"""Distribution and statistics operators (A9-A10, A15-A16, ST1-ST5, U1, L5, W8, W9).

Everything is a single-pass aggregate or a window over an already aggregated
(small) table; nothing is sampled to make it cheap (the reference samples 5,000
rows for plots only — ``corr`` / ``regr_*`` are one-pass aggregates here).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_distribution(df: DataFrame, col: str, lo=None, hi=None, *, lo_open: bool = False,
                       count_distinct: str | None = None, name: str = "n") -> DataFrame:
    """Frequencies of ``col`` (``value_counts`` / ``GROUP BY x``), NULLs dropped,
    optionally limited to lo ≤ x ≤ hi (lo < x with ``lo_open``)."""
    x = F.col(col)
    d = df.where(x.isNotNull())
    if lo is not None:
        d = d.where(x > lo if lo_open else x >= lo)
    if hi is not None:
        d = d.where(x <= hi)
    agg = F.countDistinct(count_distinct) if count_distinct else F.count(F.lit(1))
    return d.groupBy(col).agg(agg.alias(name))


def histogram(df: DataFrame, col: str, width: float, lo: float, hi: float) -> DataFrame:
    """Equal-width bins over [lo, hi]: bin index, bounds and count."""
    x = F.col(col).cast("double")
    nbins = int(math.ceil((hi - lo) / width))
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(nbins - 1)).cast("int")
    return (df.where(x.between(lo, hi)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("bin_lo", F.lit(lo) + F.col("bin") * F.lit(width))
            .withColumn("bin_hi", F.lit(lo) + (F.col("bin") + 1) * F.lit(width)))


def box_stats(df: DataFrame, by: Sequence[str] | None, col: str) -> DataFrame:
    """Quartiles (linear interpolation), mean, sample sd, min, max."""
    x = F.col(col).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs = [F.count(x).alias("n"), q.alias("_q"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
            F.min(x).alias("min"), F.max(x).alias("max")]
    d = df.where(x.isNotNull())
    out = d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)
    return (out.withColumn("q1", F.col("_q")[0]).withColumn("median", F.col("_q")[1])
            .withColumn("q3", F.col("_q")[2]).drop("_q"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix after dropping rows with any NULL (ST1), long form (var1, var2, r).

    Two passes, both plain partial-then-final sums: the column means (one
    struct-valued scalar subquery), then the centred co-moments
    Σ(a−ā)(b−b̄) for every pair a ≤ b over one centring projection.  This is
    the textbook two-pass formula — as stable as a running ``corr`` per pair
    and far cheaper per row (one multiply-add per pair, not a running update
    with divisions; k = 9 columns would otherwise carry 36 × 6 buffers).
    r = C_ab / √(C_aa·C_bb); NaN when a column is constant or one row remains
    (as ``corr``; on the diagonal too), NULL on no rows.  The k×k result is unpivoted with
    ``stack`` (no self-join of the data).
    """
    # Per-pair expressions are SQL strings: one parse on the JVM per
    # projection instead of a driver round trip per column operator.
    q = {c: f"`{c}`" for c in cols}
    d = df.selectExpr(*[f"CAST({q[c]} AS DOUBLE) AS {q[c]}" for c in cols]).dropna()
    idx = {c: i for i, c in enumerate(cols)}
    mean = d.selectExpr("struct(" + ", ".join(f"avg({q[c]}) AS {q[c]}" for c in cols) + ") AS m").scalar()
    centred = d.select(*[(F.col(c) - mean[c]).alias(c) for c in cols])
    upper = [(a, b) for a in cols for b in cols if idx[a] <= idx[b]]  # symmetric
    sums = centred.selectExpr(*[f"sum({q[a]} * {q[b]}) AS `{a}__{b}`" for a, b in upper])

    def r(a, b):
        if a == b:
            return f"CASE WHEN `{a}__{a}` = 0 THEN CAST('NaN' AS DOUBLE) WHEN `{a}__{a}` IS NOT NULL THEN 1.0D END"
        x, y = (a, b) if idx[a] < idx[b] else (b, a)
        den = f"sqrt(`{x}__{x}` * `{y}__{y}`)"
        return f"CASE WHEN {den} = 0 THEN CAST('NaN' AS DOUBLE) ELSE try_divide(`{x}__{y}`, {den}) END"

    stack = ", ".join(f"'{a}', '{b}', {r(a, b)}" for a in cols for b in cols)
    return sums.selectExpr(f"stack({len(cols) ** 2}, {stack}) AS (var1, var2, r)")


def linreg(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares y ~ x in one aggregate (ST2): n, slope, intercept, r, stderr."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    d = df.where(xc.isNotNull() & yc.isNotNull())
    out = d.agg(F.regr_count(yc, xc).alias("n"), F.regr_slope(yc, xc).alias("slope"),
                F.regr_intercept(yc, xc).alias("intercept"), F.corr(xc, yc).alias("r"),
                F.var_samp(xc).alias("_vx"), F.var_samp(yc).alias("_vy"),
                F.min(xc).alias("x_min"), F.max(xc).alias("x_max"))
    stderr = F.when(F.col("n") > 2, F.sqrt((F.lit(1.0) - F.col("r") * F.col("r")) * F.col("_vy")
                                           / F.col("_vx") / (F.col("n") - 2)))
    return out.withColumn("stderr", stderr).drop("_vx", "_vy")


# ------------------------------------------------------------------ p-value
P_STEPS = 4000  # even; Simpson's rule
P_REACH = 40.0  # how far a tail is followed, in standard deviations (beyond: below 1e-300 of it)


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, as the ratio of two integrals.

    With t = sqrt(v) tan(u / sqrt(v)) the density is cos(u / sqrt(v)) ** (v - 1), so
    p is its integral from u(t) on over the one from 0 on.  Both run over a
    bounded range, need no gamma function and tend to the normal tail for large
    v; log cos is taken by its series for small arguments.
    """
    v = dof.cast("double")
    root = F.sqrt(v)
    end = root * F.lit(math.pi / 2)
    start = root * F.atan(F.abs(t) / root)

    def log_cos(x):
        return F.when(x < 1e-2, -x * x / 2 - F.pow(x, F.lit(4.0)) / 12 - F.pow(x, F.lit(6.0)) / 45).otherwise(F.log(F.greatest(F.cos(x), F.lit(1e-300))))

    def integral(a):
        h = (F.least(end, a + P_REACH) - a) / P_STEPS

        def add(acc, i):
            w = F.when((i == 0) | (i == P_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return acc + w * F.exp((v - 1) * log_cos((a + h * i) / root))

        return F.aggregate(F.sequence(F.lit(0), F.lit(P_STEPS)), F.lit(0.0), add) * h

    return integral(start) / integral(F.lit(0.0))


def with_p_value(model: DataFrame) -> DataFrame:
    """Attach the two-sided p-value of r (t test, n-2 dof) to a one-row model:
    NaN for fewer than 3 rows or no r, 0 for |r| = 1."""
    r, dof = F.col("r"), F.col("n").cast("double") - 2
    t = r * F.sqrt(dof / (1 - r * r))
    known = r.isNotNull() & ~F.isnan(r) & (dof > 0)
    return model.withColumn("p_value", F.when(~known | F.col("n").isNull(), F.lit(float("nan")))
                            .when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided_p(t, dof)))


def heatmap(df: DataFrame, row: str, col: str, measure: Column, name: str = "value",
            wide: bool = False, columns: Sequence | None = None) -> DataFrame:
    """Pivot of ``measure`` by (row, col) (ST5).  Long form (row, col, value) by
    default; ``wide=True`` gives one column per ``col`` value (``pivot``; pass
    ``columns`` to skip the extra job that finds the distinct values)."""
    if not wide:
        return df.groupBy(row, col).agg(measure.alias(name))
    return df.groupBy(row).pivot(col, list(columns) if columns is not None else None).agg(measure)


def cohort_profile(df: DataFrame, cohorts: Mapping[str, Column], metrics: Mapping[str, Column],
                   label: str = "group_type") -> DataFrame:
    """One labelled aggregate row per cohort in a single scan.

    Each row carries the labels of every cohort it belongs to (cohorts may
    overlap), so the data is read once instead of once per UNION ALL branch.
    Every cohort yields a row, also an empty one (as a keyless aggregate does).
    """
    labels = F.array_compact(F.array(*[F.when(pred, F.lit(name)) for name, pred in cohorts.items()]))
    tagged = df.withColumn(label, F.explode(labels))
    agg = tagged.groupBy(label).agg(*[c.alias(n) for n, c in metrics.items()])
    spark = df.sparkSession
    order = spark.createDataFrame([(i, n) for i, n in enumerate(cohorts)], f"_ord int, {label} string")
    return F.broadcast(order).join(agg, label, "left").orderBy("_ord").drop("_ord")


def sample_hash(key: Sequence[str], seed: int = 42) -> Column:
    """MD5 of the seed and the key's text (any key type; NULL as empty): 128 bits in
    hexadecimal, whose text order is a random order any SQL engine can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).cast("binary"))


def repeatable_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest seeded hash of ``key`` (L5): the same rows every run.

    A threshold on the hash's first 32 bits, taken from the row count, lets only
    about ``2 n + 200`` rows of the whole table through (never fewer than n in
    practice: that is more than 50 standard deviations away), so the final
    top-n merges about that many rows however many tasks there are.  Ties of the
    hash are broken by the key itself.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double")
    near = head * total <= F.lit(float((2 * n + 200) * 2 ** 32))
    return df.withColumn("_h", sample_hash(key, seed)).where(near).orderBy("_h", *key).limit(n).drop("_h")


def growth(df: DataFrame, period: str, measure: str, scale: float = 100.0) -> DataFrame:
    """Latest-period growth vs the previous period (W8); 0 when the previous is
    ≤ 0 or there are fewer than 2 periods.  ``df`` has one row per period."""
    w = Window.orderBy(period)
    prev = F.lag(measure).over(w)
    ranked = df.select(period, measure, prev.alias("_prev"),
                       F.row_number().over(Window.orderBy(F.col(period).desc())).alias("_rk"))
    latest = ranked.where(F.col("_rk") == 1)
    g = F.when(F.col("_prev").isNull() | (F.col("_prev") <= 0), F.lit(0.0)).otherwise(
        (F.col(measure).cast("double") - F.col("_prev").cast("double")) / F.col("_prev").cast("double")
        * F.lit(scale))
    return latest.select(F.col(period).alias("latest_period"), g.alias("growth_pct"))


def funnel(df: DataFrame, stage: str, id_col: str) -> DataFrame:
    """Distinct ids per stage, largest first, with the ratio to the previous stage."""
    counts = df.groupBy(stage).agg(F.countDistinct(id_col).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col(stage).asc())
    return counts.withColumn("pct_previous", F.col("n").cast("double") / F.lag("n").over(w) * F.lit(100.0))
