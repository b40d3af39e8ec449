"""Operator 11: document fingerprints by SimHash, and search within a Hamming radius by permuted block tables.

A text's terms are its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and its shingles of
``SHINGLE`` words.  A term that occurs tf times weighs 1 + log2(tf), in sixteenths, and votes with
this weight for or against each of ``BITS`` bits, as its hash has them; the signs of the sums
are the fingerprint.  Weights are integers, so equal texts have equal fingerprints in any order.
Likeness is 1 - Hamming distance / BITS.

``within_radius`` cuts a fingerprint into radius + 2 blocks: fingerprints that differ in at most
``radius`` bits agree in two blocks at least.  One table per pair of blocks is keyed by these
blocks; a pair is taken from the first table it meets in, and its distance is computed in full.
Equal fingerprints are one class with a count, so copies never meet each other.  Only
fingerprints whose key a query may have (a fixed 2 MB filter) are shuffled.

``neighbour_fingerprints`` fingerprints every text and its edited text (the last third of the
code points replaced by the beginning of the next document, descending ids).  Texts are compressed
one by one, dealt once into sorted ranges of ids and read as a stream in which each row meets
its successor; only the last row of a range waits for the first row of the next one, in a
join of one row per range.

Defined cases: null and empty texts are the empty text with the zero fingerprint; ids descend, null
ids last, rows of one id by a hash of the text; a single document is its own successor;
an empty table gives no rows; other columns are not read.  Long texts are held one at a
time in the stream.  Rows of one id stay in one range (ids are keys).
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm import textkernel as tk
from marketlens.llm.common import IdSketch, Scratch, small_batches

BITS, SHINGLE, RADIUS = 128, 5, 4
#: Terms whose votes are counted at once (a numpy matrix of so many rows and BITS columns).
VOTES = 1 << 15
U64 = np.uint64


def _terms(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words and shingles of consecutive rows."""
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return row, h
    sh = np.zeros(n, U64)
    for i in range(SHINGLE):
        sh += tk.mix(h[i:i + n] + U64(i + 1)) * (tk.mix(np.array([i + 101], U64))[0] | U64(1))
    inside = row[:n] == row[SHINGLE - 1:]
    return np.concatenate([row, row[:n][inside]]), np.concatenate([h, tk.mix(sh[inside])])


#: For each byte its eight bits as the bytes of one 64-bit word, so that one addition counts eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64)[:, 0]


def _bits(term: np.ndarray) -> np.ndarray:
    """(terms, BITS // 8) bytes: the bits that each term votes for."""
    return np.stack([tk.mix(term + seed) for seed in tk.mix(np.arange(1, BITS // 64 + 1, dtype=U64))], axis=1).view(np.uint8).reshape(len(term), -1)


def _starts(row: np.ndarray, most: int) -> np.ndarray:
    """First places of runs of equal rows, of at most ``most`` places each."""
    new = np.append(True, row[1:] != row[:-1])[:len(row)]
    since = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    return np.flatnonzero(since % most == 0)


def votes(row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """(rows, BITS // 8) bytes: the signs of the weighted votes of each row's terms."""
    order = np.argsort(term)
    line = row[order].astype(np.uint16) if rows <= 1 << 16 else row[order]
    order = order[np.argsort(line, kind="stable")]
    row, term = row[order], term[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(first)
    tf = np.diff(np.append(at, len(row)))
    row, term = row[at], term[at]
    total = np.zeros((rows, BITS), np.int64)
    for lo in range(0, len(row), VOTES):
        r, t, n = row[lo:lo + VOTES], term[lo:lo + VOTES], tf[lo:lo + VOTES]
        once = n == 1  # nearly all terms: their votes are counted in bytes, at most 255 at a time
        if once.any():
            ro = r[once]
            starts = _starts(ro, 255)
            ones = np.add.reduceat(_LANES[_bits(t[once])], starts, axis=0).view(np.uint8).astype(np.int64)
            np.add.at(total, ro[starts], 16 * (2 * ones - np.diff(np.append(starts, len(ro)))[:, None]))
        if not once.all():
            ro, w = r[~once], np.rint(16 + 16 * np.log2(n[~once])).astype(np.int64)
            starts = _starts(ro, len(ro))
            total[ro[starts]] += np.add.reduceat(np.where(np.unpackbits(_bits(t[~once]), axis=1), w[:, None], -w[:, None]), starts, axis=0)
    return np.packbits(total > 0, axis=1)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(len(texts), BITS // 8) bytes."""
    out = [votes(*_terms(h, n), len(n)) for _, h, n in tk.word_rows(pa.array(texts, pa.large_binary()), tk.WORDS_BLANK)]
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


_PACKED = "id long, h long, size long, z binary"
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pack(batches):
    for batch in batches:
        raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big", signed=True) for x in raw], pa.int64()),
            pa.array([len(x) for x in raw], pa.int64()),
            pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())], names=["id", "h", "size", "z"])


def _unpack(z: bytes, size: int) -> bytes:
    return pa.decompress(z, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _pairs(ids: list, texts: list[bytes], follow: list[bytes], own: np.ndarray, nxt: np.ndarray) -> list[pa.Array]:
    plain = [t.decode() for t in texts]
    new = [edited(t, f.decode()).encode() for t, f in zip(plain, follow, strict=True)]
    fp = fingerprints(new)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in plain], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in new]),
            pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in fp]),
            pa.array(likeness(own, fp)), pa.array(likeness(own, nxt))]


_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def _walk(batches):
    """Rows of one sorted range: all but the last meet their successor; the first and the last row go out with their texts."""
    def edge(kind, part, id_, text, fp):
        flat = [[id_], [None], [None], [fp.tobytes().hex()], [None], [None], [None], [kind], [part], [len(text)], [pa.compress(text, codec="zstd", asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(flat, types, strict=True)], names=names)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = [*_NAMES, "kind", "part", "size", "z"]
    held, part = None, None
    for whole in batches:
        for lo, hi in tk.slices(np.append(0, np.cumsum(whole.column("size").to_numpy()))):  # so that few texts are unpacked at once
            batch = whole.slice(lo, hi - lo)
            part = batch.column("part")[0].as_py()
            ids = batch.column("id").to_pylist()
            texts = [_unpack(z, n) for z, n in zip(batch.column("z").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            fp = fingerprints(texts)
            if held is None:
                yield edge(1, part, ids[0], texts[0], fp[0])
            else:
                ids, texts, fp = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], fp])
            held = ids[-1], texts[-1], fp[-1]
            n = len(ids) - 1
            if n:
                done = _pairs(ids[:-1], texts[:-1], texts[1:], fp[:-1], fp[1:])
                yield pa.RecordBatch.from_arrays([*done, pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()),
                                                  pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
    if held is not None:
        yield edge(2, part, *held)


def _meet(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            text, follow = _unpack(r["z"], r["size"]), _unpack(r["z2"], r["size2"])
            fp = fingerprints([text, follow])
            yield pa.RecordBatch.from_arrays(_pairs([r["doc_id"]], [text], [follow], fp[:1], fp[1:]), names=_NAMES)


def neighbour_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document (``_ROW``) of ``docs(doc_id, text)``."""
    scratch = Scratch(spark, "simhash")
    packed = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_pack, _PACKED)
    line = [F.col("id").desc_nulls_last(), F.col("h")]
    ranges = packed.repartitionByRange(*line).sortWithinPartitions(*line).withColumn("part", F.spark_partition_id())
    rows = scratch.table(ranges.mapInArrow(_walk, f"{_ROW}, kind int, part int, size long, z binary"))
    first, last = rows.where("kind = 1"), rows.where("kind = 2")
    # the next range that holds rows; one row per range
    turn = first.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("then"))
    meet = (last.select("doc_id", "part", "size", "z").join(turn, "part")
            .join(first.select(F.col("part").alias("then"), F.col("size").alias("size2"), F.col("z").alias("z2")), "then")
            .select("doc_id", "size", "z", "size2", "z2").mapInArrow(_meet, _ROW))
    return rows.where("kind = 0").select(*_NAMES).unionByName(meet)


def block_tables(radius: int, bits: int = BITS, agree: int = 2) -> list[list[tuple[int, int]]]:
    """Tables as lists of (first hex digit, digits): all choices of ``agree`` out of radius + ``agree`` blocks."""
    blocks, digits = radius + agree, bits // 4
    if not 0 <= radius or blocks > digits:
        raise ValueError(f"a radius of 0 to {digits - agree}, please")
    ends = [digits * i // blocks for i in range(blocks + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)], agree)]


def _key(fp: str, table: list[tuple[int, int]]) -> str:
    return "concat(" + ", ".join(f"substr({fp}, {at + 1}, {n})" for at, n in table) + ")"


def distance(a: str, b: str, bits: int = BITS) -> str:
    """SQL: the Hamming distance of two fingerprints in hex."""
    part = "cast(conv(substr({}, {}, 8), 16, 10) as bigint)".format
    return " + ".join(f"bit_count({part(a, i)} ^ {part(b, i)})" for i in range(1, bits // 4, 8))


def within_radius(rows: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q, fingerprint, members, distance): for each distinct fingerprint of ``queries`` all distinct fingerprints
    of ``rows`` within ``radius``, with the number of rows that have it."""
    tables = block_tables(radius)
    keys = ", ".join(f"struct({i} as t, {_key('fingerprint', t)} as k)" for i, t in enumerate(tables))
    scratch = Scratch(rows.sparkSession, "simhash-tables")
    classes = scratch.table(rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("members")))
    ask = scratch.table(queries.where("fingerprint is not null").select("fingerprint").distinct()
                        .selectExpr("fingerprint as q", f"inline(array({keys}))"))
    may = IdSketch(ask.select(F.xxhash64("t", "k").alias("at")), "at")
    table = classes.selectExpr("fingerprint", "members", f"inline(array({keys}))").where(may.may_hold(F.xxhash64("t", "k")))
    # of the tables that a pair shares, the first one gives it
    first = "t = case " + " ".join(f"when {_key('q', t)} = {_key('fingerprint', t)} then {i}" for i, t in enumerate(tables)) + " end"
    return (ask.join(table.hint("merge"), ["t", "k"]).where(first).selectExpr("q", "fingerprint", "members", f"{distance('q', 'fingerprint')} as distance")
            .where(F.col("distance") <= radius))


def near_counts(rows: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """``rows`` with ``n_near``: for the rows ``asked`` for, how many other rows lie within ``radius``; else null."""
    queries = rows.where(asked)
    near = within_radius(rows, queries, radius).groupBy("q").agg((F.sum("members") - 1).alias("n_near"))
    found = queries.join(near, F.col("fingerprint") == F.col("q"), "left").select(*rows.columns, "n_near")
    return found.unionByName(rows.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long")))
