"""Operator 3: toxicity by weak supervision.

1. Lexicon: on at most ``FIT_ROWS`` labelled training rows (documented bound) the
   word openings (4 to 6 letters, or a whole shorter word) whose document
   frequency among label-1 rows far exceeds that among label-0 rows, and more than
   chance among so many terms explains, at most ``LEXICON`` of them.
2. Voters: the lexicon is dealt into ``LEXICON_VOTERS`` lexicon voters (any hit)
   beside pattern voters (several distinct hits, dense hits, shouting, runs of
   marks, symbol noise); each votes 0 or 1 on every whole text of the corpus.
3. Label model: vote patterns of all documents are counted in Spark (at most
   2**voters rows) and a generative model P(y) prod P(vote | parent vote, y) is
   fitted to them by EM; the tree of parents is the maximum spanning tree of the
   voters' conditional mutual information, so it holds each voter's accuracy and
   the correlations between voters.
4. Classifier: logistic regression over votes and hit counts, trained on the
   label model's posteriors of the fit rows, scores every document.

Texts are read twice (fit rows, then all); the votes and counts of all documents
are written once to the scratch folder (a few numbers a row) and reused.

Defined cases: null and empty texts have no hits and get the score of such texts;
null ids are scored, never held out and never learnt from; without label-1 rows
the lexicon is empty and the score is near 0; repeated documents each keep their
row; other columns are not returned.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, held_out, labelled_sample, small_batches

FIT_ROWS = 20_000
LEXICON, LEXICON_VOTERS = 240, 6
OPENINGS = (4, 5, 6)
LIFT, LEAST_SHARE = 8.0, 0.01
EVIDENCE = 24.0  # least log-likelihood ratio of a term (twice the log of about 100,000 terms tried)
PATTERNS = ["several", "dense", "shouting", "marks", "symbols"]
VOTERS = [f"lexicon_{i}" for i in range(LEXICON_VOTERS)] + PATTERNS
FEATURES = VOTERS + [f"hits_{i}" for i in range(LEXICON_VOTERS)] + ["distinct", "total", "rate"]

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_UPPER, _MARK, _SYMBOL = (bytes(sorted(s)) for s in (range(65, 91), b"!?", b"#$%&*@|<>{}[]~^=+_\\/"))


def plain(text: bytes) -> str:
    """Lower-cased letters, everything else (in ASCII) a blank."""
    s = text.translate(_LETTERS).decode("utf-8", "replace")
    return s if s.isascii() else s.lower()


def openings(words) -> set[str]:
    out = set()
    for w in words:
        for n in OPENINGS:
            if len(w) > n:
                out.add(w[:n])
            else:
                out.add(w + "$")
                break
    return out


def _bytes(column) -> list:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def mine_lexicon(docs: DataFrame, sample: DataFrame, limit: int = LEXICON) -> list[str]:
    """Terms ordered by how much of label 1 they explain; ``w$`` is a whole word, others open a word."""
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y")

    def task(batches):
        count: dict[str, list] = {}
        for batch in batches:
            for text, y in zip(_bytes(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                for t in openings(set(plain(text).split())):
                    count.setdefault(t, [0, 0])[y] += 1
            if len(count) > 300_000:  # partial counts, combined by the aggregate below
                yield out(count)
                count = {}
        yield out(count)

    def out(count):
        return pa.RecordBatch.from_pydict({
            "term": pa.array(list(count), pa.string()), "n0": pa.array([c[0] for c in count.values()], pa.int64()),
            "n1": pa.array([c[1] for c in count.values()], pa.int64())})

    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos:
        return []
    terms = rows.mapInArrow(task, "term string, n0 long, n1 long").groupBy("term").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lift = ((F.col("n1") + 0.5) / (pos + 1)) / ((F.col("n0") + 0.5) / (neg + 1))
    n, p = F.col("n0") + F.col("n1"), pos / (pos + neg)
    evidence = 2 * (F.col("n1") * F.log(F.col("n1") / (n * p)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (n * (1 - p)))).otherwise(0.0))
    best = (terms.where(F.col("n1") >= max(3, int(LEAST_SHARE * pos))).withColumn("lift", lift)
            .where((F.col("lift") >= LIFT) & (evidence >= EVIDENCE))
            .orderBy((F.col("n1") * F.log("lift")).desc(), "term").limit(limit))
    return [r.term for r in best.collect()]  # at most `limit` terms


class Hits:
    """Counts lexicon terms in a plain text with one automaton pass."""

    def __init__(self, terms: list[str]):
        self.n = len(terms)
        self.voter = np.arange(max(1, self.n)) % LEXICON_VOTERS
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.auto.add_word(" " + (t[:-1] + " " if t.endswith("$") else t), i)
        if terms:
            self.auto.make_automaton()

    def __call__(self, text: bytes) -> np.ndarray:
        """One row of FEATURES."""
        s = plain(text)
        hit = np.bincount([i for _, i in self.auto.iter(f" {s} ")], minlength=self.n) if self.n else np.zeros(1)
        by = np.bincount(self.voter[: len(hit)], hit, LEXICON_VOTERS)
        distinct, total, n = int((hit > 0).sum()), float(hit.sum()), max(1, len(text))
        words = s.count(" ") + 1
        upper, mark, symbol = (n - len(text.translate(None, x)) for x in (_UPPER, _MARK, _SYMBOL))
        votes = [*(by > 0), distinct >= 3, total * 100 >= words, upper * 10 > 3 * n, mark * 50 > n, symbol * 20 > n]
        return np.array([*votes, *np.log1p(by), np.log1p(distinct), np.log1p(total), np.log1p(1000 * total / words)], np.float64)


def features(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, f): the FEATURES of every whole text."""

    def task(batches):
        hits = Hits(terms)
        for batch in batches:
            f = [hits(t) for t in _bytes(batch.column("text"))]
            f = np.stack(f) if f else np.zeros((0, len(FEATURES)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, f array<double>")


class LabelModel:
    """P(y) prod_j P(v_j | v_parent(j), y), fitted by EM to counted vote patterns."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 40):
        self.m = votes.shape[1]
        self.parent = np.full(self.m, -1)
        lex = votes[:, : LEXICON_VOTERS].sum(1)
        post = np.where(lex > 0, 0.9, 0.02)  # start: the lexicon voters' word
        for k in range(rounds):
            if k == 5:
                self.parent = self._tree(votes, counts, post)
            self._learn(votes, counts, post)
            post = self.posterior(votes)

    def _joint(self, votes, w, i, j):
        """2 x 2 weighted table of two voters."""
        return np.bincount(votes[:, i] * 2 + votes[:, j], w, 4).reshape(2, 2) + 0.25

    def _tree(self, votes, counts, post) -> np.ndarray:
        """Parents by the maximum spanning tree of conditional mutual information."""
        info = np.zeros((self.m, self.m))
        total = counts.sum() + 2.0
        for w in (counts * post, counts * (1 - post)):
            for i in range(self.m):
                for j in range(i):
                    t = self._joint(votes, w, i, j)
                    p = t / t.sum()
                    info[i, j] = info[j, i] = info[i, j] + t.sum() / total * (p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()
        parent, inside = np.full(self.m, -1), [0]
        while len(inside) < self.m:
            rest = [j for j in range(self.m) if j not in inside]
            i, j = max(((i, j) for i in inside for j in rest), key=lambda e: info[e])
            if info[i, j] > 1e-4:  # uncorrelated voters stay roots
                parent[j] = i
            inside.append(j)
        return parent

    def _learn(self, votes, counts, post):
        mass = np.array([(counts * (1 - post)).sum(), (counts * post).sum()])
        self.prior = (mass + 1) / (mass.sum() + 2)
        self.table = np.zeros((self.m, 2, 2))  # voter, class, parent vote -> P(vote = 1)
        for y, w in enumerate((counts * (1 - post), counts * post)):
            for j, p in enumerate(self.parent):
                up = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
                for u in (0, 1):
                    on = up == u
                    self.table[j, y, u] = (w[on] @ votes[on, j] + 0.1) / (w[on].sum() + 0.2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ll = np.zeros((2, len(votes)))
        for y in (0, 1):
            ll[y] = np.log(self.prior[y])
            for j, p in enumerate(self.parent):
                q = self.table[j, y][votes[:, p] if p >= 0 else np.zeros(len(votes), int)]
                ll[y] += np.log(np.where(votes[:, j] == 1, q, 1 - q))
        return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) of ridge logistic regression on soft targets, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - target) + pen * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scratch = Scratch(spark, "toxicity")
    sample = scratch.table(labelled_sample(labels, "toxic", limit))
    terms = mine_lexicon(docs, sample)
    every = scratch.table(features(docs, terms))
    votes = [F.col("f")[i].cast("int") for i in range(len(VOTERS))]
    counted = every.groupBy(F.array(*votes).alias("v")).agg(F.count("*").alias("n")).collect()  # at most 2**voters rows
    pattern = np.array([r.v for r in counted], int).reshape(-1, len(VOTERS))
    # a fixed order makes the fit the same on every run
    order = np.lexsort(pattern.T) if len(pattern) else []
    model = LabelModel(pattern[order], np.array([r.n for r in counted], float)[order]) if len(counted) else None
    fit = every.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("f").toPandas()  # at most about `limit` rows
    if model is None or not len(fit):
        w = np.array([*[0.0] * len(FEATURES), -5.0])
    else:
        x = np.stack(fit["f"].to_numpy())
        w = logistic(x, model.posterior(x[:, : len(VOTERS)].astype(int)))
    z = F.lit(float(w[-1]))
    for i, c in enumerate(w[:-1]):
        z = z + F.col("f")[i] * float(c)
    out = every.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
