"""Operator 7: MinHash near-duplicates with tensored banding, confirmed on full sets.

1. Signatures: one scan turns each text into its set of distinct word shingles
   (64-bit hashes), a 128-bit digest of the set and two small collections A and B
   of ``COLLECTION`` hashes, each joining two minhashes.  The table keys are all
   pairs (A_i, B_j): ``COLLECTION**2`` tables of four minhashes each from only
   ``4 * COLLECTION`` minhash computations.
2. Documents with equal sets are one class, represented by the smallest id.
3. The smallest representative that holds a key leads the key's bucket
   (aggregate with map-side combine); every member is tied to its leader's group.
   No bucket is expanded into pairs.
4. In a leader's group the full sets meet in tasks of at most two blocks of
   ``BLOCK`` members.  Members are encoded as differences from the leader, which
   gives an upper bound on every overlap from bitmaps (no true link is lost); the
   pairs whose bound reaches the threshold are confirmed on the full sets unless
   already joined, and only the links of a spanning forest leave the task.
5. Components of the links and the copies.

A pair of similarity J shares a table unless one collection fails completely:
probability below ``2 (1 - J*J)**COLLECTION``, 7e-5 at J = 0.8 and 6e-8 at J = 0.9
(the missing pair alone matters only if no other chain joins its documents).

Defined cases: null and wordless texts have the empty set and are linked with
nothing; a text of fewer than ``shingle`` words is one shingle; null ids are
linked with nothing and kept; rows of one id are one node; repeated rows each
keep their row; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import textkernel as tk
from marketlens.llm.common import IdSketch, Scratch, connected_components, small_batches
from marketlens.llm.runs import Forest, grouped

COLLECTION = 10
BLOCK = 4096
U64 = np.uint64


def _multipliers(n: int) -> np.ndarray:
    return tk.mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def minhashes(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """The minimum of the set under each hash function, for sets of any size."""
    best = np.full(len(mult), ~U64(0))
    for a in range(0, len(s), 4096):
        y = s[a:a + 4096, None] * mult
        np.minimum(best, (y ^ (y >> U64(32))).min(0), out=best)
    return best


def signatures(docs: DataFrame, shingle: int, collection: int = COLLECTION) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, a, b) of every text."""

    def task(batches):
        mult = _multipliers(4 * collection)
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for _, h, counts in tk.word_rows(batch.column("text"), tk.WORDS_BLANK):
                for s in tk.shingle_sets(h, counts, shingle):
                    n.append(len(s))
                    m = tk.mix(s)
                    d1.append(m.sum(dtype=U64))
                    d2.append(np.bitwise_xor.reduce(m * U64(0x9E3779B97F4A7C15) ^ (m >> U64(7))) if len(s) else U64(0))
                    sig.append(minhashes(s, mult))
            sig = np.array(sig, U64).reshape(-1, 2 * collection, 2)
            pair = tk.mix(sig[:, :, 0] + U64(0x632BE59BD9B4E019) * tk.mix(sig[:, :, 1])).view(np.int64)
            off = pa.array(np.arange(len(n) + 1, dtype=np.int32) * collection)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(np.array(d, U64).view(np.int64)) for d in (d1, d2)],
                 *[pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(x).ravel())) for x in (pair[:, :collection], pair[:, collection:])]],
                names=["doc_id", "n_shingles", "d1", "d2", "a", "b"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        task, "doc_id long, n_shingles long, d1 long, d2 long, a array<long>, b array<long>")


def _bits(hashes: np.ndarray, n_bits: int) -> tuple[np.ndarray, int]:
    """Bitmap of hash values, and how many values fell on a taken bit."""
    at = (hashes % U64(n_bits)).astype(np.int64)
    bits = np.zeros(n_bits, np.uint8)
    bits[at] = 1
    return np.packbits(bits).view(U64), len(at) - int(bits.sum())


def link_group(ids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one task's group: sorted ids, their blocks and full sets.

    ``cross``: only pairs from two different blocks are this task's.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    forest, links = Forest(n), []

    def confirm(x: int, y: int) -> None:
        if forest.root(x) != forest.root(y):
            both = size[x] if sets[x] is sets[y] else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= percent * (size[x] + size[y] - both):
                forest.tie(x, y)
                links.append((int(ids[x]), int(ids[y])))

    if n <= 6:
        for x in range(n):
            for y in range(x + 1, n):
                if not cross or blocks[x] != blocks[y]:
                    confirm(x, y)
        return links
    lead = sets[0]
    n_bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(16, np.median(size)))), 11, 16))
    lost, gain = np.zeros((n, n_bits // 64), U64), np.zeros((n, n_bits // 64), U64)
    n_lost, lost_dup, gain_dup = (np.zeros(n, np.int64) for _ in range(3))
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(lead, s), len(lead) - 1)
        inside = lead[at] == s
        away = np.ones(len(lead), bool)
        away[at[inside]] = False
        n_lost[i] = away.sum()
        lost[i], lost_dup[i] = _bits(lead[away], n_bits)
        gain[i], gain_dup[i] = _bits(s[~inside], n_bits)
    rows = max(1, (1 << 21) // (n * n_bits // 64))
    for a in range(0, n, rows):
        x = slice(a, min(n, a + rows))
        bound = (np.bitwise_count(lost[x, None] & lost[None, a:]).sum(2, dtype=np.int64) + np.minimum(lost_dup[x, None], lost_dup[None, a:])
                 + np.bitwise_count(gain[x, None] & gain[None, a:]).sum(2, dtype=np.int64) + np.minimum(gain_dup[x, None], gain_dup[None, a:])
                 + len(lead) - n_lost[x, None] - n_lost[None, a:])
        total = size[x, None] + size[None, a:]
        bound = np.minimum(bound, np.minimum(size[x, None], size[None, a:]))
        may = (100 + percent) * bound >= percent * total
        if cross:
            may &= blocks[x, None] != blocks[None, a:]
        for i, j in zip(*np.nonzero(np.triu(may, 1)), strict=True):
            confirm(a + int(i), a + int(j))
    return links


def near_links(spark: SparkSession, docs: DataFrame, sig: DataFrame, scratch: Scratch, shingle: int, percent: int, block: int) -> DataFrame:
    """(u, v): links that join all linked documents (copies to their representative, then confirmed links)."""
    member = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = member.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    named = scratch.table(member.join(classes, ["d1", "d2", "n_shingles"]))
    copies = named.where("doc_id <> rep").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))

    table = "flatten(transform(a, (x, i) -> transform(b, (y, j) -> xxhash64(i, j, x, y))))"
    keys = named.where("doc_id = rep").select(F.explode(F.expr(table)).alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    follow = scratch.table(keys.join(shared, "key").where("rep <> leader").select("leader", "rep").distinct())
    group = follow.unionByName(follow.select("leader", F.col("leader").alias("rep")).distinct())

    # tiles: a group of up to `block` members is one task, a larger one a task per pair of blocks
    parts = group.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    tiles = (group.join(parts, "leader").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
             .select(F.col("rep").alias("id"), F.struct("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").alias("tile")))
    places = scratch.table(tiles.groupBy("id").agg(F.collect_list("tile").alias("tiles")))  # a document's tables bound its tiles
    asked = IdSketch(places, "id")  # texts without a place are not shuffled
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where(asked.may_hold(F.col("id"))).join(places.hint("merge"), "id")

    def spread(batches):
        for batch in batches:
            tiles = batch.column("tiles").to_pylist()
            row, ids = 0, batch.column("id").to_numpy()
            for _, h, counts in tk.word_rows(batch.column("text"), tk.WORDS_BLANK):
                out = []
                for s in tk.shingle_sets(h, counts, shingle):
                    data = s.tobytes()
                    out += [(t["leader"], t["i"], t["j"], t["own"], int(ids[row]), data) for t in tiles[row]]
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[k] for o in out], ty) for k, ty in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["leader", "i", "j", "own", "id", "set"])

    def confirm(batches):
        u, v = [], []
        for t in grouped(batches, ["leader", "i", "j"]):
            ids, own = t.column("id").to_numpy(), t.column("own").to_numpy()
            # the leader is the pivot wherever it is present
            order = np.argsort(ids, kind="stable")
            data = t.column("set").to_pylist()
            sets = [np.frombuffer(data[k], U64) for k in order]
            keep = [k for k, s in enumerate(sets) if len(s)]
            if len(keep) > 1:
                order = order[keep]
                for x, y in link_group(ids[order], own[order], [sets[k] for k in keep], t.column("i")[0] != t.column("j")[0], percent):
                    u.append(x)
                    v.append(y)
            if len(u) > 50_000:
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})
                u, v = [], []
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    sets = texts.mapInArrow(spread, "leader long, i int, j int, own int, id long, set binary")
    links = (sets.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "id")
             .mapInArrow(confirm, "u long, v long"))
    return copies.unionByName(links)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 4, percent: int = 80,
                    collection: int = COLLECTION, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    scratch = Scratch(spark, "minhash")
    sig = scratch.table(signatures(docs, shingle, collection))
    links = near_links(spark, docs, sig, scratch, shingle, percent, block)
    comp = connected_components(spark, links, scratch)
    out = sig.select("doc_id", "n_shingles").join(comp, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
