"""Operator 9: benchmark decontamination with suffix arrays over the training text.

Each task turns its documents into shards of about ``SHARD_WORDS`` words, keeps
a suffix array of every shard, and binary-searches every benchmark suffix in it
(as far as a window reaches); equal ranges give the verbatim matches with their
locations, and matches that continue each other on one diagonal are joined into
the longest match.  A document is whole in its row, so nothing is shuffled.

The suffix array is sparse and exact: a suffix is stored only if it opens with
enough consecutive words of the benchmark vocabulary to hold the shortest
window; any other suffix cannot equal a window.

The benchmark is the stated query set.  It is read in blocks of at most
``BLOCK_WORDS`` words (checked while the blocks are cut); each block is sent to
the tasks once and all documents are searched against it, and results of several
blocks are united per document.

Defined cases: null or wordless texts have no words, are never hit and never
contaminated; items without words are ignored; repeated item ids count once; an
item with a null id can hit words but is not counted or listed; an empty
benchmark hits nothing; repeated documents each keep their row; other columns
pass through (those named like a result are replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import textkernel as tk
from marketlens.llm.common import fields, fresh, small_batches

WINDOW = 13
SHARD_WORDS = 400_000
BLOCK_WORDS = 4_000_000
MATCH = "array<struct<item_id:bigint,doc_word:bigint,item_word:bigint,n_words:bigint>>"


class Block:
    """A block of the query set: vocabulary, and its distinct windows as sortable keys."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        col = pa.array([t for _, t in items], pa.large_string())
        toks = []
        for _, h, n in tk.word_rows(col, tk.WORDS_ALNUM):
            toks += np.split(h, np.cumsum(n)[:-1])
        self.window = window
        self.vocab = np.unique(np.concatenate([*toks, np.zeros(0, np.uint64)]))
        seen: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.where: list[list[tuple]] = []  # window -> (item number, item word)
        self.size: list[int] = []
        for item, h in enumerate(toks):
            ids = (np.searchsorted(self.vocab, h) + 1).astype(">u4")
            w = min(window, len(ids))
            for j in range(len(ids) - w + 1 if w else 0):
                k = seen.setdefault(ids[j:j + w].tobytes(), len(seen))
                if k == len(self.where):
                    self.where.append([])
                    self.size.append(w)
                self.where[k].append((item, j))
        width = 4 * window
        self.low = np.array([k.ljust(width, b"\0") for k in seen], dtype=f"S{width}")
        self.high = np.array([k.ljust(width, b"\xff") for k in seen], dtype=f"S{width}")
        self.least = min(self.size, default=0)

    @classmethod
    def of(cls, state: dict) -> Block:
        b = cls.__new__(cls)
        b.__dict__ = state
        return b

    def search(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence in a shard of documents."""
        if not len(h) or not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        ids = np.where(self.vocab[at] == h, at + 1, 0).astype(np.uint32)
        # words of the vocabulary in a row from each position on, inside its document
        n = len(ids)
        stop = ids == 0
        ends = np.cumsum(counts)
        gap = np.full(n, n, np.int64)
        gap[stop] = np.flatnonzero(stop)
        gap = np.minimum.accumulate(gap[::-1])[::-1]
        run = np.minimum(gap, np.repeat(ends, counts)) - np.arange(n)
        suffix = np.flatnonzero(run >= self.least)
        if not len(suffix):
            return suffix, suffix
        padded = np.concatenate([ids, np.zeros(self.window, np.uint32)])
        deep = np.minimum(run[suffix], self.window)
        keys = np.empty((len(suffix), self.window), ">u4")
        for j in range(self.window):
            keys[:, j] = np.where(j < deep, padded[suffix + j], 0)
        keys = keys.view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys, suffix = keys[order], suffix[order]
        lo = np.searchsorted(keys, self.low, side="left")
        hi = np.searchsorted(keys, self.high, side="right")
        got = np.flatnonzero(hi > lo)
        pos = [suffix[lo[k]:hi[k]] for k in got]
        return (np.concatenate(pos), np.repeat(got, hi[got] - lo[got])) if pos else (np.zeros(0, np.int64),) * 2


def _shards(column):
    """(rows, hashes, words per row): slices joined until a shard is full."""
    hs, ns, words = [], [], 0
    for _, h, n in tk.word_rows(column, tk.WORDS_ALNUM):
        hs.append(h)
        ns.append(n)
        words += len(h)
        if words >= SHARD_WORDS:
            yield np.concatenate(hs), np.concatenate(ns)
            hs, ns, words = [], [], 0
    if hs:
        yield np.concatenate(hs), np.concatenate(ns)


def _spans(block: Block, doc_pos: np.ndarray, win: np.ndarray) -> list[dict]:
    """Maximal verbatim matches of one document."""
    runs: dict[tuple, list] = {}
    for p, k in sorted(zip(doc_pos.tolist(), win.tolist(), strict=True)):
        for item, j in block.where[k]:
            r = runs.setdefault((item, p - j), [])
            if r and p <= r[-1][1]:
                r[-1][1] = max(r[-1][1], p + block.size[k])
            else:
                r.append([p, p + block.size[k]])
    found = {(block.ids[item], a, a - d, b - a) for (item, d), spans in runs.items() for a, b in spans}
    return [dict(zip(("item_id", "doc_word", "item_word", "n_words"), m, strict=True)) for m in sorted(found, key=lambda m: (m[1], m[2], str(m[0]), m[3]))]


def find_matches(docs: DataFrame, block) -> DataFrame:
    """``docs`` with n_words, the hit word positions, the item ids and the matches against one block (a broadcast of its state)."""
    schema = fields(docs, f"n_words bigint, hits array<bigint>, items array<bigint>, matches {MATCH}")
    names = docs.columns

    def task(batches):
        b = Block.of(block.value)
        for batch in batches:
            n_words, hits, items, matches = [], [], [], []
            for h, counts in _shards(batch.column("text")):
                pos, win = b.search(h, counts)
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, pos, side="right")
                order = np.argsort(doc, kind="stable")
                pos, win, doc = pos[order], win[order], doc[order]
                cut = np.searchsorted(doc, np.arange(len(counts) + 1))
                for i, n in enumerate(counts.tolist()):
                    p, w = pos[cut[i]:cut[i + 1]] - (ends[i] - n), win[cut[i]:cut[i + 1]]
                    n_words.append(n)
                    hit = np.unique(np.concatenate([np.arange(x, x + b.size[k]) for x, k in zip(p.tolist(), w.tolist(), strict=True)])) if len(p) else p
                    hits.append(hit.tolist())
                    items.append(sorted({b.ids[i] for k in set(w.tolist()) for i, _ in b.where[k] if b.ids[i] is not None}))
                    matches.append(_spans(b, p, w) if len(p) else [])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.int64())), pa.array(matches, pa.list_(pa.struct([
                     ("item_id", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])))],
                names=[*names, "n_words", "hits", "items", "matches"])

    return small_batches(docs).mapInArrow(task, schema)


def blocks(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS):
    """Broadcast blocks of the query set, in item order, each of at most ``limit`` words (or one item)."""
    part, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        part.append((r.item_id, r.text))
        words += len(r.text) // 2 + 1  # a bound: a word takes two characters with its separator
        if words >= limit:
            yield spark.sparkContext.broadcast(vars(Block(part, window)))
            part, words = [], 0
    yield spark.sparkContext.broadcast(vars(Block(part, window)))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items, matches, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    cut = list(blocks(spark, benchmark, window, block_words))
    base = docs.drop("n_words", "hits", "items", "matches", "n_hit", "contaminated")
    if len(cut) == 1:
        found = find_matches(base, cut[0])
    else:  # several blocks: unite the hits of equal (id, text)
        i, sha = fresh(base, "id", "sha")
        key = [F.col("doc_id").alias(i), F.sha2("text", 256).alias(sha)]
        every = None
        for b in cut:
            part = find_matches(base.select("doc_id", "text"), b).where("size(hits) > 0").select(*key, "hits", "items", "matches")
            every = part if every is None else every.unionByName(part)
        every = every.distinct().groupBy(i, sha).agg(
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
        counted = find_matches(base, spark.sparkContext.broadcast(vars(Block([], window)))).drop("hits", "items", "matches")
        found = counted.join(every, F.col("doc_id").eqNullSafe(F.col(i)) & F.sha2("text", 256).eqNullSafe(F.col(sha)), "left").select(
            *[F.col(f"`{c}`") for c in base.columns], "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (
                ("hits", "array<bigint>"), ("items", "array<bigint>"), ("matches", MATCH))])
    hit = F.size("hits").cast("long")
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")).drop("hits")


def items_digest(items) -> "F.Column":
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",").cast("binary"), 256)


def sha256_of(ids) -> str:
    """The digest of a list of item ids, as ``items_digest`` gives it (for tests)."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
