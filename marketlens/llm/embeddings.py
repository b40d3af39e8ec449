"""Operator 8: embedding near-dedup with randomised-rotation binary codes.

1. Equal vectors are one class (smallest id, number of distinct ids).
2. A seeded random rotation turns each unit vector into its sign code, an 8-bit
   copy and a stored correction factor <code, vector>; further rotations give the
   sign bits of the bucket tables.  The bits per table and the number of tables
   follow from the number of vectors: ``BUCKET`` vectors a bucket are aimed at, and
   a pair at the threshold is missed in all tables with probability ``MISS``.
3. Estimate: in every bucket the unbiased estimate <code(x), y> / factor(x) and its
   confidence bound (``EPS`` standard errors) decide which members have a partner
   that may reach the threshold; the others need no exact work.
4. Recompute: those members meet again with their full vectors; the pairs that the
   bound cannot rule out are recomputed in double precision.  A pair counts in the
   first table whose bucket it shares, so nothing is counted twice; tasks return
   each member's number of links and a spanning forest, never all pairs.

A bucket of more than ``TILE`` members is dealt into blocks and each pair of blocks
is a task, so the exact way holds for buckets of any size.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components is linked with nothing, and so is a row without id (its component is
null, kept is true); vectors of different lengths are never compared; rows with
the same id and vector are one vector, each row is returned; an empty table gives
no rows; other columns are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, connected_components
from marketlens.llm.runs import Forest

BUCKET = 256
MISS = 1e-3
EPS = 4.0
TILE = 2048
SEED = 20240


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits per table, tables) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(2, n / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of a dimension; the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit rotated copies, factors, bucket keys per table) of unit rows."""
    dim = x.shape[1]
    first = x @ rotation(dim, 0).T
    scale = np.abs(first).max(1, keepdims=True)
    small = (2 * np.floor(first / np.maximum(scale, 1e-300) * 63.49) + 1).astype(np.int8)  # odd: the sign is never lost
    factor = np.abs(first).sum(1) / math.sqrt(dim)
    keys = np.zeros((len(x), tables), np.int64)
    signs, k = np.zeros((len(x), 0), bool), 1
    for t in range(tables):
        while signs.shape[1] < bits:
            signs = np.hstack([signs, x @ rotation(dim, k).T > 0])
            k += 1
        keys[:, t] = signs[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
        signs = signs[:, bits:]
    return small, factor, keys


def may_reach(small: np.ndarray, factor: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose estimate plus its bound reaches the threshold, from either side's code."""
    dim = small.shape[1]
    if dim < 2:
        return np.ones((len(small),) * 2, bool)
    code = np.where(small > 0, 1.0, -1.0) / math.sqrt(dim)
    y = small.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    est = (code @ y.T) / factor[:, None]
    err = EPS * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / math.sqrt(dim - 1) + 0.02  # 0.02: the 8-bit copy
    ok = est + err[:, None] >= threshold
    return ok & ok.T


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def class_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): rows with usable vectors; ``vec`` holds the doubles' bytes."""

    def task(batches):
        for batch in batches:
            ids, vecs = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and np.abs(x).max() > 0:
                    ids.append(i)
                    vecs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in vecs], pa.int32()),
                                              pa.array([x.tobytes() for x in vecs], pa.binary())], names=["vec_id", "dim", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        task, "vec_id long, dim int, vec binary")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """classes with small, factor, keys."""

    def task(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for _, g in pdf.groupby("dim", sort=True):
                small, factor, keys = encode(_unit(_vectors(g["vec"])), bits, tables)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "id": g["id"].to_numpy(), "mult": g["mult"].to_numpy(), "dim": g["dim"].to_numpy(), "vec": g["vec"].to_numpy(),
                    "small": [s.tobytes() for s in small], "factor": factor, "keys": list(keys)}), preserve_index=False,
                    schema=pa.schema([("id", pa.int64()), ("mult", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()),
                                      ("small", pa.binary()), ("factor", pa.float64()), ("keys", pa.list_(pa.int64()))]))

    return classes.mapInArrow(task, "id long, mult long, dim int, vec binary, small binary, factor double, keys array<long>")


def tiled(members: DataFrame) -> DataFrame:
    """``members(t, key, dim, id, ...)`` with its tiles (i, j) and own block; large buckets are dealt into blocks."""
    at = ["t", "key", "dim"]
    parts = members.groupBy(*at).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")).where("parts > 1")
    return (members.join(parts, at, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "parts"))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding)``."""
    scratch = Scratch(spark, "embeddings")
    usable = scratch.table(class_vectors(vectors).distinct())
    classes = usable.groupBy("dim", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult"))
    bits, tables = plan_tables(usable.count(), threshold)
    codes = scratch.table(coded(classes, bits, tables))

    tile = ["t", "key", "dim", "i", "j"]
    one = codes.select("id", "dim", "small", "factor", F.posexplode("keys").alias("t", "key"))

    def estimate(pdf):
        if len(pdf) < 2:
            return pdf[["t", "id"]][:0]
        small = np.stack([np.frombuffer(s, np.int8) for s in pdf["small"]])
        may = may_reach(small, pdf["factor"].to_numpy(), threshold)
        own = pdf["own"].to_numpy()
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            may &= own[:, None] != own[None, :]
        np.fill_diagonal(may, False)
        return pdf[["t", "id"]][may.any(1)]

    wanted = scratch.table(tiled(one).groupBy(*tile).applyInPandas(estimate, "t int, id long").distinct())
    again = wanted.join(codes, "id").withColumn("key", F.expr("keys[t]"))

    def recompute(pdf):
        empty = pd.DataFrame({"u": [], "v": [], "links": []})
        if len(pdf) < 2:
            return empty
        pdf = pdf.sort_values("id")
        t, cross, own = int(pdf["t"].iloc[0]), pdf["i"].iloc[0] != pdf["j"].iloc[0], pdf["own"].to_numpy()
        ids, mult = pdf["id"].to_numpy(), pdf["mult"].to_numpy()
        small, factor = np.stack([np.frombuffer(s, np.int8) for s in pdf["small"]]), pdf["factor"].to_numpy()
        x, keys = _unit(_vectors(pdf["vec"])), np.stack(pdf["keys"].to_numpy())
        may = np.triu(may_reach(small, factor, threshold), 1)
        if cross:
            may &= own[:, None] != own[None, :]
        a, b = np.nonzero(may)
        forest, links, ties = Forest(len(ids)), np.zeros(len(ids), np.int64), []
        for s in range(0, len(a), 100_000):
            p, q = a[s:s + 100_000], b[s:s + 100_000]
            fresh = ~(keys[p, :t] == keys[q, :t]).any(1)  # not met in an earlier table
            p, q = p[fresh], q[fresh]
            on = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            p, q = p[on], q[on]
            np.add.at(links, p, mult[q])
            np.add.at(links, q, mult[p])
            ties += [(ids[m], ids[n]) for m, n in zip(p.tolist(), q.tolist(), strict=True) if forest.tie(m, n)]
        has = links > 0
        return pd.DataFrame({"u": [*ids[has], *(m for m, _ in ties)], "v": [*ids[has], *(n for _, n in ties)],
                             "links": [*links[has], *[0] * len(ties)]})

    found = scratch.table(tiled(again).groupBy(*tile).applyInPandas(recompute, "u long, v long, links long"))
    counts = found.groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    named = usable.join(classes, ["dim", "vec"]).select("vec_id", "id", "mult")
    ties = found.where("u <> v").select("u", "v").unionByName(named.where("vec_id <> id").select(F.col("id").alias("u"), F.col("vec_id").alias("v")))
    comp = connected_components(spark, ties, scratch)
    # an id may have several vectors: its links add up
    per = named.join(counts, "id", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = (vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(per, "vec_id", "left")
           .join(comp, F.col("vec_id") == F.col("node"), "left"))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
