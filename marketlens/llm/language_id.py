"""Operator 4: language ID by nearest clustered centroids of TF-IDF n-gram vectors.

Texts become vectors of hashed character 2- and 3-grams (letters lower-cased,
everything else one blank), weighted ``(1 + log tf) idf`` and scaled to length 1.
Document frequencies come from all training documents.  For each language at most
about ``FIT_DOCS`` training texts (documented bound) are clustered by spherical
k-means (seeded by spread) into at most ``CENTROIDS`` centroids, one language per task.
Clusters of less than ``LEAST_SHARE`` of the fit texts are kept as well (a second script,
short or code-like texts), unless their texts are on average nearer to a main centroid of
another language than to those of their own, and as near as its own texts are
(mislabelled ones).
A text gets the language of the centroid with the largest cosine, its score.

Rejection by distance: a text is rejected if its cosine is under a share of the
lowest 1 % of its language's own fit texts (or it has no letter).  The share is what
``OUTSIDE`` of the texts stay under that no centroid was learnt from: each language's
fit texts against the centroids of the others, and noise of the same lengths and
letters; it is never over 1, so that about 1 % of a language's own texts go at most.

Long texts are counted in slices; a task holds one batch of vectors at a time.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; null ids are never held out and never learnt from; null languages are
not learnt; without training rows every text is ``und``; repeated documents each
keep their row; other columns pass through (those named like a result are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, crc_mod, fields, held_out, small_batches

DIM = 4096
FIT_DOCS = 300
CENTROIDS = 3
LEAST_SHARE = 0.15
OUTSIDE = 0.95
NOISE_CHARS = 2000
MAX_LANGUAGES = 1000
ROWS, CHARS = 64, 1 << 18
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: bytes | None) -> str:
    """Lower-cased letters and blanks; empty if there is no letter."""
    if not text:
        return ""
    s = text.translate(_KEEP).decode("utf-8", "replace")
    if not s.isascii():
        s = s.lower()
        if not any(c.isalpha() for c in s):
            return ""
    return s if s.strip() else ""


def _grams(codes: np.ndarray, row: np.ndarray, out: np.ndarray) -> None:
    """Add the counts of 2- and 3-grams of code points to ``out[row, bin]``; grams stay inside a row."""
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    c, r = codes[keep].astype(np.uint64), row[keep]
    if len(c) < 2:
        return
    two = (c[:-1] * np.uint64(0x9E3779B1)) ^ (c[1:] * np.uint64(0x85EBCA77C2B2AE63))
    same = r[:-1] == r[1:]
    flat = []
    for h, ok, at in ((two, same, r[1:]), (two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9), same[:-1] & same[1:], r[2:])):
        h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)  # 12 bits = DIM
        flat.append(at[ok] * DIM + h[ok].astype(np.int64))
    out += np.bincount(np.concatenate(flat), minlength=out.size).reshape(out.shape)


def count_grams(texts: list):
    """(rows, counts): count matrices of up to ROWS texts at a time; very long texts are counted in slices."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and len(part) < ROWS and (not part or size < CHARS):
            part.append(" " + s + " " if (s := plain(texts[at + len(part)])) else "")
            size += len(part[-1])
        out = np.zeros((len(part), DIM))
        joined, lens = "".join(part), np.array([len(p) for p in part])
        row = np.repeat(np.arange(len(part)), lens)
        for a in range(0, len(joined), CHARS):
            b = max(0, a - 2)  # grams across the cut; the two overlap characters give one 2-gram twice
            codes = np.frombuffer(joined[b:a + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
            _grams(codes, row[b:a + CHARS], out)
        yield range(at, at + len(part)), out
        at += len(part)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _texts(column) -> list:
    return column.cast(pa.large_binary()).to_pylist()


def learn_idf(train: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all training texts: one row of DIM counts a task, summed in Spark."""

    def task(batches):
        df, n = np.zeros(DIM), 0
        for batch in batches:
            for rows, counts in count_grams(_texts(batch.column("text"))):
                df += (counts > 0).sum(0)
                n += len(rows)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(DIM + 1), pa.int32()), "df": pa.array(np.append(df, n))})

    rows = train.select("text").mapInArrow(task, "bin int, df double").groupBy("bin").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM + 1)
    for r in rows:  # DIM + 1 rows
        df[r.bin] = r.df
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def kmeans(x: np.ndarray, k: int, rounds: int = 15, tries: int = 4) -> np.ndarray:
    """Spherical k-means, the best of a few greedy k-means++ starts; seeded, so it is the same on every run."""
    best, found = -np.inf, x[:0]
    for seed in range(tries):
        rng = np.random.default_rng(seed)
        c = x[[rng.integers(len(x))]]
        while len(c) < min(k, len(x)):
            top = (x @ c.T).max(1).astype(float)
            far = np.maximum(1 - top, 0)
            far[far < 1e-6] = 0  # copies of a seed
            if not far.any():
                break
            some = rng.choice(len(x), min(8, len(x)), p=far / far.sum())
            c = np.concatenate([c, x[[max(some, key=lambda j: np.maximum(top, x @ x[j]).sum())]]])
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            new = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c, atol=1e-6):
                break
            c = new
        if (fit := float((x @ c.T).max(1).sum())) > best:
            best, found = fit, c
    return found


def keep_minorities(model: list) -> list:
    """``model`` rows without the small clusters that another language's main centroids explain better.

    ``tight * cosine(cluster, centroid)`` is the mean cosine of the cluster's texts with a centroid.
    """
    main = [r for r in model if r.main]
    c = np.array([r.vector for r in main], np.float32).reshape(-1, DIM)
    langs, floors = np.array([r.lang for r in main], object), np.array([r.floor for r in main])

    def stray(r):
        cos, own = r.tight * (c @ np.array(r.vector, np.float32)), langs == r.lang
        return bool(((cos > cos[own].max()) & (cos >= floors) & ~own).any())
    return [r for r in model if r.main or not stray(r)]


def fit_sample(train: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(lang, doc_id, text): the texts that are learnt from, written once."""
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError("more languages than MAX_LANGUAGES")
    sizes = F.broadcast(train.sparkSession.createDataFrame([tuple(r) for r in sizes], "lang string, n long"))
    span = 1 << 30
    some = (train.join(sizes, "lang").where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(span)) < fit_docs * span / F.col("n"))
            .select("lang", "doc_id", "text"))
    return Scratch(train.sparkSession, "language-fit").table(some)


def fit_vectors(texts: list, idf: np.ndarray) -> np.ndarray:
    x = [vectors(c, idf) for _, c in count_grams(texts)]
    x = np.concatenate(x) if x else np.zeros((0, DIM), np.float32)
    return x[np.linalg.norm(x, axis=1) > 0.5]


def learn_centroids(some: DataFrame, idf: np.ndarray) -> DataFrame:
    """(lang, floor, main, tight, vector): the centroids of each language, the distance bound of its main ones, whether a
    centroid is one, and the mean cosine of its texts with it."""

    def fit(pdf):
        import pandas as pd
        pdf = pdf.sort_values("doc_id")
        x = fit_vectors([t.encode("utf-8", "surrogatepass") for t in pdf["text"] if t], idf)
        if not len(x):
            return pd.DataFrame({"lang": [], "floor": [], "main": [], "tight": [], "vector": []})
        c = kmeans(x, CENTROIDS)
        near = (x @ c.T).argmax(1)
        share = np.bincount(near, minlength=len(c)) / len(x)
        c, share, near = c[share > 0], share[share > 0], (np.cumsum(share > 0) - 1)[near]
        main = share >= min(LEAST_SHARE, share.max())
        tight = [float(np.linalg.norm(x[near == i].mean(0))) for i in range(len(c))]
        floor = float(np.quantile((x @ c[main].T).max(1), 0.01))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "floor": [floor] * len(c), "main": main, "tight": tight,
                             "vector": [v.astype(np.float32).tolist() for v in c]})

    return some.groupBy("lang").applyInPandas(fit, "lang string, floor double, main boolean, tight double, vector array<float>")


def outside_share(some: DataFrame, shared, langs: np.ndarray, floors: np.ndarray) -> float:
    """The share of its language's floor that ``OUTSIDE`` of the texts of unlearnt languages and of noise stay under.

    The largest over all languages and their noise counts; one task per language, two numbers from each.
    """

    def task(pdf):
        import pandas as pd
        pdf = pdf.sort_values("doc_id")
        idf, c = shared.value
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"] if t]
        rng, heads = np.random.default_rng(0), [plain(t)[:NOISE_CHARS] for t in texts]
        letters = sorted(set("".join(heads)) - {" "})
        letters += [" "] * (1 + len(letters) // 5)
        noise = ["".join(rng.choice(letters, len(t))).encode("utf-8", "surrogatepass") for t in heads]
        others, found = langs != pdf["lang"].iloc[0], []
        for x, which in ((fit_vectors(texts, idf), others), (fit_vectors(noise, idf), np.ones(len(c), bool))):
            if len(x) and which.any():
                cos = x @ c[which].T
                best = cos.argmax(1)
                ratio = cos[np.arange(len(x)), best] / np.maximum(floors[which][best], 1e-9)
                found.append(float(np.quantile(ratio, OUTSIDE)))
        return pd.DataFrame({"share": found})

    shares = [r.share for r in some.groupBy("lang").applyInPandas(task, "share double").collect()]
    return min(1.0, max(shares, default=0.0))


def identify(spark: SparkSession, docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` with held_out, lang_pred, score, rejected."""
    train = small_batches(docs).select("doc_id", "text", "lang").where(
        (F.coalesce(crc_mod(F.col("doc_id"), 3), F.lit(1)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = learn_idf(train)
    model = keep_minorities(learn_centroids(some := fit_sample(train, fit_docs), idf).collect())  # at most CENTROIDS rows for each of MAX_LANGUAGES
    model.sort(key=lambda r: (r.lang, r.vector))
    langs = np.array([r.lang for r in model], object)
    floors = np.array([r.floor for r in model])
    shared = spark.sparkContext.broadcast((idf, np.array([r.vector for r in model], np.float32).reshape(-1, DIM)))
    bounds = floors * (outside_share(some, shared, langs, floors) if len(model) else 0)
    base = docs.drop("held_out", "lang_pred", "score", "rejected")
    names = base.columns
    schema = fields(base, "lang_pred string, score double, rejected boolean")

    def task(batches):
        idf, c = shared.value
        for batch in batches:
            pred, score, rejected = [], [], []
            for _, counts in count_grams(_texts(batch.column("text"))):
                seen = counts.any(1)
                if not len(c):
                    seen[:] = False
                cos = vectors(counts, idf) @ c.T if len(c) else np.zeros((len(counts), 1))
                best = cos.argmax(1)
                top = np.clip(cos[np.arange(len(cos)), best], 0, 1).astype(float)
                for ok, i, s in zip(seen, best, top, strict=True):
                    pred.append(langs[i] if ok else "und")
                    score.append(s if ok else 0.0)
                    rejected.append(not ok or bool(s < bounds[i]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in names], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*names, "lang_pred", "score", "rejected"])

    return base.mapInArrow(task, schema).withColumn(
        "held_out", held_out(F.col("doc_id"), 3, 1))
