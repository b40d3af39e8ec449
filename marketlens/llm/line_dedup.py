"""Operator 6: reversible line dedup, sharded cuckoo filters over exact reference counts.

State (Parquet, one folder per version):

* ``postings`` (h1, h2, doc_id): the distinct keys of every document, the exact
  record that makes deletions possible;
* ``refs`` (h1, h2, n_docs, max_doc): documents per key and the largest of them;
* ``filters`` (shard, bytes): per shard of the key space a cuckoo filter over the
  keys whose reference count has reached ``min_docs``.

``insert`` adds documents, ``delete`` takes documents away again: counts go down
and keys that fall under ``min_docs`` are removed from their shard's filter, so
the state equals one that never saw them.  ``decide`` probes the filters for
every line (no false negatives), and confirms the lines that may be repeated in
the exact table, so only those cross the network before the decision.

The filters are sent to the tasks only if their summed size is under
``FILTER_BYTES``; beyond it every key goes to the exact join instead.  A key held
by a third of all documents is combined before the shuffle when counted, and is
a skewed join key that adaptive execution splits when decided.

Line keys follow the contract: the line without ``[\\x20\\x09-\\x0D]`` at its ends,
A-Z lower-cased; a key of at least ``min_chars`` code points is hashed to 128 bits.

Defined cases: a null or empty text is one empty line; a null doc_id is not
counted as a document and never the largest holder; rows with the same doc_id
count as one document and share its decisions; an empty table gives no rows;
other columns pass through (those named like a result are replaced).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import IdSketch, Scratch, fields, fresh, small_batches
from marketlens.llm.cuckoo import Cuckoo, Shards

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SHARDS = 64
FILTER_BYTES = 64 << 20


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() folds A-Z only


def long_key(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def digests(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    out = []
    for line in lines:
        k = line_key(line)
        out.append(xxhash.xxh3_128_digest(k) if long_key(k, min_chars) else None)
    return out


def _texts(column) -> list:
    return column.cast(pa.large_binary()).to_pylist()


def line_keys(docs: DataFrame, min_chars: int, filters=None) -> DataFrame:
    """(doc_id, h1, h2): the distinct long keys of each document; with ``filters`` only those that may be repeated."""

    def task(batches):
        probe = Shards(*filters.value) if filters is not None else None
        for batch in batches:
            owner, keys = [], []
            for i, text in enumerate(_texts(batch.column("text"))):
                if text:
                    got = {d for d in digests(text.split(b"\n"), min_chars) if d is not None}
                    owner += [i] * len(got)
                    keys += got
            h = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
            owner = np.array(owner, np.int64)
            if probe is not None and len(h):
                may = probe.contains(h[:, 0], h[:, 1])
                h, owner = h[may], owner[may]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64))],
                names=["doc_id", "h1", "h2"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, h1 long, h2 long")


def build_filters(refs: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """(shard, bytes): one task per shard builds the filter of its repeated keys."""
    shard = F.pmod(F.shiftrightunsigned("h1", 40), F.lit(n_shards)).cast("int")
    keys = refs.where(F.col("n_docs") >= min_docs).select(shard.alias("shard"), "h1", "h2")

    def task(batches):
        # batches come sorted by shard: keys are gathered until the shard changes
        held: dict[int, list] = {}
        for batch in batches:
            s = batch.column("shard").to_numpy()
            h = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], 1).view(np.uint64)
            for x in np.unique(s):
                held.setdefault(int(x), []).append(h[s == x])
            for x in sorted(held)[:-1]:
                yield one(x, held.pop(x))
        for x in sorted(held):
            yield one(x, held[x])

    def one(shard, parts):
        h = np.concatenate(parts)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "bytes": [Cuckoo.of(h[:, 0], h[:, 1]).to_bytes()]})

    return keys.repartition("shard").sortWithinPartitions("shard").mapInArrow(task, "shard int, bytes binary")


class LineIndex:
    """The incremental index; every change writes a new version, the old ones stay readable."""

    def __init__(self, spark: SparkSession, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 n_shards: int = SHARDS, filter_bytes: int = FILTER_BYTES):
        self.spark, self.scratch = spark, scratch
        self.min_chars, self.min_docs, self.n_shards, self.filter_bytes = min_chars, min_docs, n_shards, filter_bytes
        self.postings = self.refs = self.filters = None

    def _commit(self, postings: DataFrame) -> LineIndex:
        self.postings = self.scratch.table(postings)
        self.refs = self.scratch.table(self.postings.groupBy("h1", "h2").agg(
            F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")))
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        new = line_keys(docs, self.min_chars).distinct()
        if self.postings is not None:
            new = self.postings.unionByName(new).distinct()
        self._commit(new)
        self.filters = self.scratch.table(build_filters(self.refs, self.n_shards, self.min_docs))
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents away (rows of ``doc_ids(doc_id)``); keys that lose their last holders leave the filters."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        before = self.refs
        self._commit(self.postings.join(gone, self.postings.doc_id.eqNullSafe(gone.doc_id), "left_anti"))
        was = before.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        now = self.refs.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        fallen = was.join(now, ["h1", "h2"], "left_anti").withColumn(
            "shard", F.pmod(F.shiftrightunsigned("h1", 40), F.lit(self.n_shards)).cast("int"))

        def remove(_, left, right):
            import pandas as pd
            out = []
            for shard, data in zip(left["shard"], left["bytes"], strict=True):
                f = Cuckoo.from_bytes(data)
                h = right[["h1", "h2"]].to_numpy().astype(np.int64).view(np.uint64)
                f.remove(h[:, 0], h[:, 1])
                out.append((shard, f.to_bytes()))
            return pd.DataFrame(out, columns=["shard", "bytes"])

        self.filters = self.scratch.table(self.filters.groupBy("shard").cogroup(fallen.groupBy("shard")).applyInPandas(
            remove, "shard int, bytes binary"))
        return self

    def _probe(self):
        """The stacked filters as a broadcast, or None beyond the size bound."""
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
        if size > self.filter_bytes:
            return None
        rows = {r.shard: bytes(r.bytes) for r in self.filters.collect()}  # checked: at most filter_bytes
        return self.spark.sparkContext.broadcast((rows, self.n_shards))

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, drop): for each document the digests (16 bytes each, joined) of the keys it must lose."""
        may = line_keys(docs, self.min_chars, self._probe())
        hot = self.refs.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "max_doc")
        lost = may.join(hot, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))

    def decide(self, docs: DataFrame, with_text: bool = True) -> DataFrame:
        """``docs`` with n_lines, n_dropped, kept_sha256 and, if wanted, kept_text (else without text)."""
        base = docs.drop("n_lines", "n_dropped", "kept_text", "kept_sha256")
        doc, drop = fresh(base, "doc", "drop")
        lost = self.scratch.table(self.drops(docs).select(F.col("doc_id").alias(doc), F.col("drop").alias(drop)))
        key = F.col("doc_id").cast("long")
        # texts that lose nothing are not shuffled
        both = IdSketch(lost, doc).left_join(small_batches(base), lost, key.eqNullSafe(F.col(doc)), key).drop(doc)
        return _rewrite(both, drop, base if with_text else base.drop("text"), self.min_chars, with_text)


def _rewrite(both: DataFrame, drop_name: str, base: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
    names = base.columns
    schema = fields(base, "n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text string" * with_text)

    def task(batches):
        for batch in batches:
            n_lines, n_dropped, kept, sha = [], [], [], []
            drops = batch.column(drop_name).to_pylist()
            for text, drop in zip(_texts(batch.column("text")), drops, strict=True):
                text = text or b""
                n_lines.append(text.count(b"\n") + 1)
                gone = 0
                if drop:
                    held = {np.array([d["h1"], d["h2"]], np.int64).tobytes() for d in drop}
                    lines = text.split(b"\n")
                    stay = [x for x, d in zip(lines, digests(lines, min_chars), strict=True) if d not in held]
                    gone, text = len(lines) - len(stay), b"\n".join(stay)
                n_dropped.append(gone)
                if with_text:
                    kept.append(text)
                sha.append(hashlib.sha256(text).hexdigest())
            columns = [*[batch.column(c) for c in names], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha)]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text])

    return both.mapInArrow(task, schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, with_text: bool = True, **params) -> DataFrame:
    """Index ``docs`` and drop their repeated lines: insert, then decide."""
    return LineIndex(spark, Scratch(spark, "line-dedup"), **params).insert(docs).decide(docs, with_text)
