"""Operator 5: quality classifier, a sparse rule ensemble compiled to Spark columns.

Statistics of the whole text are Spark expressions.  On at most ``FIT_ROWS``
labelled training rows (documented bound) small boosted trees are grown over
them, every path from a root becomes a conjunctive rule, and lasso logistic
regression keeps a few weighted rules.  The kept rules are compiled into one
column expression, so scoring is a single scan without shuffle or Python.

Defined cases: null and empty texts get the statistics of an empty text and a
score like any other; null ids are scored, never held out and never learnt from;
without labels, or with labels of one class only, the score is the smoothed share
of label 1 (0.5 without labels); repeated documents each keep their row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import held_out, labelled_sample

FIT_ROWS = 20_000
TREES, DEPTH, BINS, LEARN = 30, 3, 32, 0.3
LASSO = 2e-3
STATS = ["n_chars", "n_words", "unique_words", "word_chars", "upper", "symbols", "digits", "n_lines", "unique_lines", "line_chars"]


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``s`` of statistics of ``text``; shares are 0 for an empty text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.char_length(t)

    def share(pattern):  # characters that the pattern covers
        return (n - F.char_length(F.regexp_replace(t, pattern, ""))) / F.greatest(n, F.lit(1))

    base = docs.withColumn("_w", F.split(F.trim(t), r"\s+")).withColumn("_l", F.split(t, "\n"))
    words = F.when(F.trim(t) == "", F.lit(0)).otherwise(F.size("_w"))
    stats = {
        "n_chars": n, "n_words": words,
        "unique_words": F.size(F.array_distinct("_w")) / F.greatest(words, F.lit(1)),
        "word_chars": n / F.greatest(words, F.lit(1)),
        "upper": share(r"\p{Lu}+"), "symbols": share(r"[^\p{L}\p{N}\s]+"), "digits": share(r"\p{N}+"),
        "n_lines": F.size("_l"), "unique_lines": F.size(F.array_distinct("_l")) / F.size("_l"),
        "line_chars": n / F.size("_l"),
    }
    return base.withColumn("s", F.struct(*[stats[c].cast("double").alias(c) for c in STATS])).drop("_w", "_l")


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, path=()):
    """Rules (paths) and the leaf values of one second-order tree on binned cuts."""
    best = None
    g, h = grad.sum(), hess.sum()
    if depth and len(x) >= 20:
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            bins = np.searchsorted(c, x[:, f], side="left")  # x <= c[k]  <=>  bin <= k
            gl, hl = (np.cumsum(np.bincount(bins, w, len(c) + 1))[:-1] for w in (grad, hess))
            gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
            gain[(hl < 0.5) | (h - hl < 0.5)] = -1
            k = int(np.argmax(gain))
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, c[k])
    if best is None:
        return [], [(path, -g / (h + 1))]
    _, f, c = best
    left = x[:, f] <= c
    rules, leaves = [], []
    for side, op in ((left, "<="), (~left, ">")):
        p = (*path, (f, op, float(c)))
        r, v = grow(x[side], grad[side], hess[side], cuts, depth - 1, p)
        rules += [p, *r]
        leaves += v
    return rules, leaves


def covers(x: np.ndarray, path) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, op, c in path:
        on &= x[:, f] <= c if op == "<=" else x[:, f] > c
    return on


def simplify(path) -> tuple:
    """A path with one bound per statistic and side."""
    bound: dict[tuple, float] = {}
    for f, op, c in path:
        bound[f, op] = min(bound.get((f, op), c), c) if op == "<=" else max(bound.get((f, op), c), c)
    return tuple(sorted((f, op, c) for (f, op), c in bound.items()))


def fit_rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """(intercept, [(rule, weight)]): rules from boosted trees, weights by lasso logistic regression."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return base, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    score, found = np.full(len(y), base), {}
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        rules, leaves = grow(x, q - y, q * (1 - q), cuts, DEPTH)
        found |= dict.fromkeys(map(simplify, rules))
        for path, v in leaves:
            score[covers(x, path)] += LEARN * v
    rules = list(found)
    a = np.stack([covers(x, r) for r in rules], 1).astype(np.float64)
    keep = (a.mean(0) > 0.001) & (a.mean(0) < 0.999)
    rules, a = [r for r, k in zip(rules, keep, strict=True) if k], a[:, keep]
    if not rules:
        return base, []
    # FISTA on the mean logistic loss + LASSO * |w|, intercept free
    mean = a.mean(0)
    z = a - mean
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w = v = np.zeros(len(rules))
    b = bv = base
    t = 1.0
    for _ in range(400):
        err = 1 / (1 + np.exp(-(z @ v + bv))) - y
        nw = v - step * (z.T @ err) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0)
        nb = bv - step * err.mean()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, bv = nw + (old - 1) / t * (nw - w), nb + (old - 1) / t * (nb - b)
        w, b = nw, nb
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return float(b - mean[on] @ w[on]), [(rules[i], float(w[i])) for i in on]


def compile_rules(intercept: float, rules) -> Column:
    """The score as a column over the statistics struct ``s``."""
    total = F.lit(intercept)
    for path, w in rules:
        on = F.lit(True)
        for f, op, c in path:
            x = F.col(f"s.{STATS[f]}")
            on = on & (x <= c if op == "<=" else x > c)
        total = total + F.when(on, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_ROWS):
    y = F.broadcast(labelled_sample(labels, label, limit))  # at most about `limit` narrow rows
    rows = with_stats(docs.select("doc_id", "text").join(y, "doc_id")).select("s.*", "y").toPandas()
    return fit_rules(rows[STATS].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    intercept, rules = fit(docs, labels, limit=limit)
    scored = with_stats(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"),
                                                              compile_rules(intercept, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
