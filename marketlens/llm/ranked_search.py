"""Operator 12: ranked lexical search by Block-Max MaxScore over document shards.

Index: tasks read documents and cut them into shards of at most ``SHARD_POSTINGS`` postings (or
``SHARD_DOCS`` documents); no text and no posting is shuffled.  Inside a shard documents ascend by id,
and a term's postings are blocks of ``BLOCK``: offsets from the first document and occurrences, each in as
few bytes as the block needs.  Beside a block stand the least document lengths by classes of
occurrences, from which a bound of its scores follows for any corpus statistics.  A shard's last
row lists its documents and their lengths.

Search: the document frequencies of the queries' terms are summed over all shards; only blocks of these
terms move (a fixed 2 MB filter, then an equi-join), to one task per shard and block of queries.  There
each query runs MaxScore: the terms are ordered by their global bound, those whose bounds together
cannot pass the 20th score so far are non-essential, and candidates come from the essential lists only.
On the others a candidate is rejected by its block's bound before the block is decompressed.
Documents are taken in growing windows, so that the threshold rises early.  The shards' best
documents are merged by a ranked window, of which each task passes on its best ``k`` a query.

A score is an integer: per query term (repeats count) its weight times
``(1000000000 * tf) div (1000 * tf + 12 * m)``, as ``impact`` says.  Terms are 64-bit hashes of
``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; q query terms meet a false one of v terms of
the corpus with probability q * v / 2**64 (1e-6 at 20,000 and 10**9).

Defined cases: null and empty texts have no term and are never found; a query without terms, or whose
terms no document holds, has no rows; equal scores rank by ascending doc_id, null ids last; rows of equal
id are ranked as documents of their own; queries of equal item_id likewise; an empty table gives no
rows; other columns are not read.  A long text is one document of its shard, cut into
slices as its words are read; a task holds one shard's blocks of its queries' terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm import textkernel as tk
from marketlens.llm.common import IdSketch, Scratch, small_batches

TOP = 20
BLOCK = 128
SHARD_POSTINGS, SHARD_DOCS = 1_500_000, 100_000
#: Query terms of one block of queries (a block is one task per shard).
QUERY_TERMS = 50_000
#: First and largest number of documents taken at once.
WINDOW = (256, 8192)
#: Classes of occurrences whose least document length is kept per block: 1, 2-3, 4-7, 8 and more.
CLASS_TOPS = (1, 3, 7)
_NONE = np.iinfo(np.int64).max

_INDEX = ("shard long, term long, block int, n long, first int, last int, tf long, n1 long, n2 long, n3 long, n4 long, data binary, "
          "ids array<bigint>, lens array<bigint>")
_FIELDS = [f.split()[0] for f in _INDEX.split(", ")]


def _postings(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the words of consecutive rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _bytes_needed(x: np.ndarray) -> np.ndarray:
    """1, 2 or 4."""
    return 1 + (x > 0xFF).astype(np.int64) + 2 * (x > 0xFFFF)


def _put(buf: np.ndarray, at: np.ndarray, width: np.ndarray, value: np.ndarray) -> None:
    for b in range(4):
        some = width > b
        buf[at[some] + b] = (value[some] >> (8 * b)) & 0xFF


def _shard(number: int, ids: list, lens: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.Table:
    """The rows of one shard: its blocks, then its documents."""
    line = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), np.int64)
    place[line] = np.arange(len(ids))
    doc = place[doc]
    lens = lens[line]
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order]
    size = len(doc)
    new = np.append(True, term[1:] != term[:-1])[:size]
    start = np.maximum.accumulate(np.where(new, np.arange(size), 0)) if size else np.zeros(0, np.int64)
    nth = (np.arange(size) - start) // BLOCK
    at = np.flatnonzero(new | ((np.arange(size) - start) % BLOCK == 0))
    count = np.diff(np.append(at, size))
    first = doc[at]
    off = doc - np.repeat(first, count)
    top_tf = np.maximum.reduceat(tf, at) if size else tf
    w_doc, w_tf = _bytes_needed(off[at + count - 1]), _bytes_needed(top_tf)
    begin = np.append(0, np.cumsum(2 + count * (w_doc + w_tf)))
    buf = np.zeros(begin[-1], np.uint8)
    buf[begin[:-1]], buf[begin[:-1] + 1] = w_doc, w_tf
    i = np.arange(size) - np.repeat(at, count)
    wd, wt, base = (np.repeat(x, count) for x in (w_doc, w_tf, begin[:-1] + 2))
    _put(buf, base + i * wd, wd, off)
    _put(buf, base + np.repeat(count, count) * wd + i * wt, wt, tf)
    n = lens[doc]
    low = [0, *CLASS_TOPS]
    least = []
    for c, lo in enumerate(low):
        inside = (tf > lo) & (tf <= CLASS_TOPS[c]) if c < len(CLASS_TOPS) else tf > lo
        v = np.minimum.reduceat(np.where(inside, n, _NONE), at) if size else n
        least.append(pa.array(v, pa.int64(), mask=v == _NONE))
    blocks = len(at)
    if begin[-1] >= 1 << 31:
        raise OverflowError("a shard of more than 2 GB")
    data = pa.Array.from_buffers(pa.binary(), blocks, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(buf)])
    whole = [pa.array(np.full(blocks, number)), pa.array(term[at].view(np.int64)), pa.array(nth[at].astype(np.int32)), pa.array(count),
             pa.array(first.astype(np.int32)), pa.array(doc[at + count - 1].astype(np.int32)), pa.array(top_tf), *least, data,
             pa.nulls(blocks, pa.list_(pa.int64())), pa.nulls(blocks, pa.list_(pa.int64()))]
    last = [[number], [None], [None], [int((lens > 0).sum())], [None], [None], [int(lens.sum())], [None], [None], [None], [None], [None],
            [[ids[j] for j in line]], [lens.tolist()]]
    t = pa.Table.from_arrays(whole, names=_FIELDS)
    return pa.concat_tables([t, pa.Table.from_arrays([pa.array(v, c.type) for v, c in zip(last, t.columns, strict=True)], names=_FIELDS)])


def _build(batches):
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32
    ids, lens, parts, held = [], [], [], 0

    def flush():
        doc, term, tf = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        return _shard(number, ids, np.array(lens, np.int64), doc, term.astype(np.uint64), tf.astype(np.int64)).to_batches(max_chunksize=20_000)
    for batch in batches:
        who = batch.column(0).to_pylist()
        for lo, h, n in tk.word_rows(batch.column(1), tk.WORDS_ALNUM):
            row, term, tf = _postings(h, n)
            parts.append((row + len(ids), term, tf))
            ids += who[lo:lo + len(n)]
            lens += n.tolist()
            held += len(row)
            if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                yield from flush()
                number, ids, lens, parts, held = number + 1, [], [], [], 0
    if ids:
        yield from flush()


def _query_terms(batches):
    for batch in batches:
        who = batch.column(0).to_numpy()
        for lo, h, n in tk.word_rows(batch.column(1), tk.WORDS_ALNUM):
            row, term, tf = _postings(h, n)
            yield pa.RecordBatch.from_arrays([pa.array(who[lo + row]), pa.array(term.view(np.int64)), pa.array(tf)], names=["q", "term", "times"])


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Lists:
    """The posting lists of one shard that its queries use; blocks are decompressed when first needed."""

    def __init__(self, table: pa.Table, n_docs: int, n_terms: int):
        table = table.combine_chunks()
        docs = table.filter(table.column("term").is_null())
        self.ids = docs.column("ids")[0].values
        lens = docs.column("lens")[0].values.to_numpy()
        table = table.filter(table.column("term").is_valid()).sort_by([("term", "ascending"), ("block", "ascending")])

        def column(name):
            return table.column(name).to_numpy()
        self.m = 75 + (25 * lens * n_docs) // n_terms
        self.first, self.last, self.n, tf = column("first").astype(np.int64), column("last").astype(np.int64), column("n"), column("tf")
        self.data = table.column("data").to_pylist()
        self.bound = np.zeros(len(self.n), np.int64)  # the best impact of a block
        for c, top in enumerate((*CLASS_TOPS, _NONE)):
            least = table.column(f"n{c + 1}").fill_null(-1).to_numpy()
            most = impact(np.minimum(tf, top), 75 + (25 * least * n_docs) // n_terms)
            self.bound = np.where(least < 0, self.bound, np.maximum(self.bound, most))
        term = column("term")
        self.start = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.end = np.append(self.start[1:], len(term))
        self.best = np.maximum.reduceat(self.bound, self.start)
        self.weight = column("w")[self.start]
        asked = table.column("asked").take(pa.array(self.start))
        self.queries: dict[int, list[tuple[int, int]]] = {}
        for t, entries in enumerate(asked.to_pylist()):
            for e in entries:
                self.queries.setdefault(e["q"], []).append((t, e["times"]))
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if b not in self._open:
            raw, n = self.data[b], int(self.n[b])
            wd, wt = raw[0], raw[1]
            off = _narrow(raw, 2, n, wd)
            doc = off + self.first[b]
            self._open[b] = doc, impact(_narrow(raw, 2 + n * wd, n, wt), self.m[doc])
        return self._open[b]

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        got = [self.block(int(b)) for b in which]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def _narrow(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: "<u2", 4: "<u4"}[width], n, at).astype(np.int64)


def max_score(lists: _Lists, terms: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (documents, scores) of a shard for one query's (list, times)."""
    weighed = sorted(((int(lists.weight[t]) * times, t) for t, times in terms if lists.weight[t] > 0), key=lambda x: x[0] * int(lists.best[x[1]]))
    best_doc, best_score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not weighed:
        return best_doc, best_score
    upto = np.cumsum([w * int(lists.best[t]) for w, t in weighed])  # what the first lists can add together
    lo, step, docs = 0, WINDOW[0], len(lists.m)
    while lo < docs:
        essential = int(np.searchsorted(upto, floor, side="right"))
        if essential == len(weighed):
            break
        hi, acc = min(docs, lo + step), np.zeros(min(docs, lo + step) - lo, np.int64)
        for w, t in weighed[essential:]:
            s, e = lists.start[t], lists.end[t]
            a, b = s + np.searchsorted(lists.last[s:e], lo), s + np.searchsorted(lists.first[s:e], hi)
            if a < b:
                doc, gain = lists.blocks(range(a, b))
                inside = slice(*np.searchsorted(doc, (lo, hi)))
                acc[doc[inside] - lo] += w * gain[inside]
        cand = np.flatnonzero(acc)
        score, cand = acc[cand], cand + lo
        for i in range(essential - 1, -1, -1):
            keep = score + upto[i] > floor
            cand, score = cand[keep], score[keep]
            if not len(cand):
                break
            w, t = weighed[i]
            s, e = lists.start[t], lists.end[t]
            b = s + np.searchsorted(lists.last[s:e], cand)
            held = np.minimum(b, e - 1)
            inside = (b < e) & (lists.first[held] <= cand)
            keep = score + np.where(inside, w * lists.bound[held], 0) + (upto[i - 1] if i else 0) > floor  # by the block's bound
            cand, score, b, inside = cand[keep], score[keep], b[keep], inside[keep]
            if inside.any():
                doc, gain = lists.blocks(np.unique(b[inside]))
                at = np.minimum(np.searchsorted(doc, cand), len(doc) - 1)
                score = score + np.where(doc[at] == cand, w * gain[at], 0)
        keep = score > floor  # a later document of an equal score never enters
        if keep.any():
            best_doc, best_score = np.append(best_doc, cand[keep]), np.append(best_score, score[keep])
            line = np.lexsort((best_doc, -best_score))[:k]
            best_doc, best_score = best_doc[line], best_score[line]
            floor = int(best_score[-1]) if len(line) == k else 0
        lo, step = hi, min(2 * step, WINDOW[1])
    return best_doc, best_score


def _searcher(n_docs: int, n_terms: int, k: int):
    def search(table: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0, np.int64))]
        if table.column("term").null_count < table.num_rows:
            lists = _Lists(table, n_docs, n_terms)
            for q, terms in lists.queries.items():
                doc, score = max_score(lists, terms, k)
                found.append((np.full(len(doc), q), lists.ids.take(pa.array(doc)), score))
        return pa.table({"q": np.concatenate([f[0] for f in found]), "doc_id": pa.concat_arrays([f[1] for f in found]),
                         "score": np.concatenate([f[2] for f in found])})
    return search


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs(doc_id, text)``: write it once, search it often."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_build, _INDEX)


def term_weight(df: Column, n_docs: int) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2.0 * df + 1))).cast("long")


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of a written index for each row of ``queries(item_id, text)``."""
    scratch = Scratch(spark, "search")
    asked = scratch.table(queries.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"))
    terms = scratch.table(asked.select("q", "text").mapInArrow(_query_terms, "q long, term long, times long"))
    docs = index.where("term is null")
    n_docs, n_terms, n_asked = docs.agg(F.sum("n"), F.sum("tf")).crossJoin(terms.agg(F.count("*"))).first()  # three numbers
    packs = max(1, -(-n_asked // QUERY_TERMS))
    pack = F.pmod(F.xxhash64("q"), F.lit(packs)).cast("int")
    asking = terms.groupBy("term", pack.alias("pack")).agg(F.collect_list(F.struct("q", "times")).alias("asked"))
    asking = scratch.table(asking)
    blocks = index.where("term is not null").where(IdSketch(terms, "term").may_hold(F.col("term")))
    blocks = scratch.table(blocks.join(terms.select("term").distinct(), "term", "left_semi").drop("ids", "lens"))
    weight = blocks.groupBy("term").agg(term_weight(F.sum("n"), n_docs or 0).alias("w"))
    hits = blocks.join(weight.where("w > 0").join(asking, "term"), "term").withColumn("asked", F.when(F.col("block") == 0, F.col("asked")))
    lengths = docs.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    best = (hits.unionByName(lengths, allowMissingColumns=True).groupBy("shard", "pack")
            .applyInArrow(_searcher(n_docs or 0, n_terms or 0, k), "q long, doc_id long, score long"))
    line = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return best.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
