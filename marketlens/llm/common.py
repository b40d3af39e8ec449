"""Shared pieces of the corpus operators: input tables, scratch tables, samples, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many leading underscores as no column of ``df`` needs (for columns that must not clash)."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


#: Arrow batches of whole texts: at most so many rows and bytes (Spark's own defaults are 10,000 and 64 MB).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after bounding the session's Arrow batches for texts of any length.

    Batches live in the task's JVM and in its Python worker at once, beside the
    heap; smaller limits that the session already has are kept.
    """
    conf = docs.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if (now := conf.get(size)).rstrip("b").lstrip("-").isdigit() and not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(size, f"{BATCH_BYTES}b")
    return docs


class Scratch:
    """Tables written once under the cluster's shared checkpoint folder.

    A written table cuts lineage and outlives lost executors; the folder is the
    one named in ``spark.checkpoint.dir`` (set by us only where it is unset).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` alone would also fold other letters)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    only_ascii = F.octet_length(c) == F.char_length(c)
    return F.when(only_ascii, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def held_out(doc_id: Column, m: int, remainder: int) -> Column:
    """The contract's fold rule; a null id is never held out and never learnt from."""
    return F.coalesce(crc_mod(doc_id, m) == remainder, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, limit: int, seed: int = 11) -> DataFrame:
    """(doc_id, y) of at most about ``limit`` labelled training rows.

    The only bounded step of the supervised operators: ``limit`` is their
    documented fit parameter.  Rows enter by a seeded hash of the id against a
    threshold taken from the row count, so no task merges more than the sample.
    Ids are unique in the result (max label wins), hence the broadcast that
    uses it is bounded by ``limit`` plus a few per cent.
    """
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .where(crc_mod(F.col("doc_id"), 5) != 0)
            .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y")))
    n = rows.count()
    if n <= limit:
        return rows
    span = 1 << 30
    cut = int(span * limit / n)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(span)) < cut)


def numbered(rows: DataFrame, group: list[str], order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... inside each group, ascending by ``order``, nulls first) and ``n`` (the group's size).

    Rows are dealt into sorted ranges and written with their range and place; a row's
    place in its group is its place in the range plus the group's rows in earlier
    ranges.  What is counted over all ranges has one row per range and group in it, so a
    group that holds most rows takes many tasks.  ``rows`` is read twice (ranges are
    sampled): pass a written table.
    """
    part, at, first = fresh(rows, "part", "at", "first")
    line = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = scratch.table(rows.repartitionByRange(*line).sortWithinPartitions(*line)
                          .withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = dealt.groupBy(part, *group).agg(F.count("*").alias("n"), F.min(at).alias(first))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col(first)
    sizes = scratch.table(sizes.select(part, *group, shift.alias(first), F.sum("n").over(Window.partitionBy(*group)).alias("n")))
    same = [dealt[part] == sizes[part], *[dealt[c].eqNullSafe(sizes[c]) for c in group]]
    return dealt.join(sizes, same).select(*[dealt[c] for c in rows.columns], (dealt[at] + sizes[first]).alias("pos"), sizes["n"])


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(u, v)``; component = smallest node reachable.

    Alternating large-star / small-star rounds: every round is two
    aggregate-and-join steps over the edges, so a node with millions of
    neighbours is a hash key of an aggregate with map-side combine and of a join
    that adaptive execution can split.  Stops when the edges are stars.
    """
    def signature(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = scratch.table(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = signature(edges)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: u and its smaller neighbours are tied to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        edges = scratch.table(small)
        now = signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not settle")
    # stars: each non-root node has exactly one edge, to its root
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


#: Bits of an ``IdSketch``; its size does not follow the data.
SKETCH_BITS = 1 << 24


class IdSketch:
    """A one-hash Bloom filter of ids in SQL: a filter in front of a join, so that rows which cannot
    match are not shuffled.  Fixed at SKETCH_BITS (2 MB) however many ids there are; more ids let more
    rows through, and the join behind it decides exactly."""

    def __init__(self, ids: DataFrame, column: str):
        spark, at = ids.sparkSession, self._at(F.col(column))
        words = ids.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("b"))
        words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        full = spark.range(SKETCH_BITS // 64).withColumnRenamed("id", "w").join(words, "w", "left")
        self.bits = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                                         lambda x: x.bits)).scalar()

    @staticmethod
    def _at(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SKETCH_BITS).cast("long"))

    def may_hold(self, c: Column) -> Column:
        at = self._at(c)
        word = F.get(self.bits, F.shiftright(at, 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0

    def left_join(self, rows: DataFrame, few: DataFrame, on: Column, key: Column) -> DataFrame:
        """``rows`` left join ``few`` (the sketch's own table): only rows that may match are shuffled, the others
        get nulls as they are read."""
        hit = rows.where(self.may_hold(key)).join(few.hint("merge"), on, "left")  # `few` grows with the data: never broadcast
        rest = rows.where(~self.may_hold(key)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in few.dtypes])
        return hit.unionByName(rest)
