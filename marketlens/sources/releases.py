"""Published loads: tables in immutable load folders, and one small manifest per release, written last.

A load writes every table into a folder of its own (``table/load=<id>``, partitions below it)
and touches nothing that exists.  A release is a manifest: for each table, and each partition of
it (a load day, a month of the fact), the load that holds it, its rows and what it was computed
from.  It is one file of one task, so it is there as a whole or not at all; until it is,
readers see the release before.  A partition that a load does not write is taken over from the last
release by name, so replacing one month or one day rewrites nothing else (S6, S9, S13, S15).

Row counts come from the writing jobs themselves (``Observation``), so an audit reads no data
file (S7, S8).  A manifest has one row per table and kept partition; it is metadata, and the only
thing that is read by the driver.  One build at a time publishes into a folder; should two
publish one release, readers raise instead of mixing them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FOLDER = "releases"
_STAGING = "staging"
_ENTRY = ("name string, part string, load string, rows bigint, day string, basis string, digest string, column string, "
          "schema string, publisher string, cluster string, buckets int")

#: Codec of the warehouse's files: a quarter to a third smaller than snappy on these tables.
CODEC = "zstd"
#: At most so many tasks (or two a core, if that is more) stage a table: so many small files has a partition.
STAGE_TASKS = 32
#: A staging task keeps a file of each partition open, up to so many; beyond it sorts the rest.
OPEN_PARTS = 256
#: A partition is merged into files of about so many rows; so many partitions are merged at the same time.
ROWS_A_FILE, PART_WRITERS = 1_000_000, 8


@contextmanager
def open_files(spark: SparkSession):
    """Let a writing task hold partitions open instead of sorting its rows by them; a session's own setting stays."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    if int(before) == 0:
        spark.conf.set(key, OPEN_PARTS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bucketed(spark: SparkSession, path: str, schema: StructType, column: str, buckets: int) -> str:
    """The session's name of a folder whose files lie in buckets; the folder is named once, so its name is the path's hash."""
    name = f"marketlens_{hashlib.md5(path.encode()).hexdigest()}"
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet OPTIONS (compression '{CODEC}') "
              f"CLUSTERED BY (`{column}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def write_bucketed(df: DataFrame, path: str, column: str, buckets: int) -> None:
    """Rows into Parquet buckets by the hash of ``column``, the hash that shuffles use: rows that lie so already (read from as
    many buckets, or partitioned by that column) are written as they lie, without shuffle or sort."""
    with open_files(df.sparkSession):
        df.write.insertInto(_bucketed(df.sparkSession, path, df.schema, column, buckets))


def read_bucketed(spark: SparkSession, path: str, schema: StructType, column: str, buckets: int) -> DataFrame:
    return spark.table(_bucketed(spark, path, schema, column, buckets))


@dataclass(frozen=True)
class Entry:
    """One partition of a table (``part`` is empty for a table without partitions)."""

    name: str
    part: str
    load: str
    rows: int
    day: str        # load day of the build that wrote or confirmed it
    basis: str      # content of the fact that it was computed from
    digest: str     # content of the partition, where months are compared
    column: str     # partition column, or empty
    schema: str
    publisher: str = ""
    cluster: str | None = None  # column by whose hash the rows lie in ``buckets`` buckets, if they do
    buckets: int | None = None


class Release:
    """What one manifest names; ``number`` 0 is the empty state before the first one."""

    def __init__(self, spark: SparkSession, root: str, number: int = 0, entries: tuple[Entry, ...] = ()):
        self.spark, self.root, self.number = spark, root.rstrip("/"), number
        self.by_name: dict[str, dict[str, Entry]] = {}
        for e in entries:
            self.by_name.setdefault(e.name, {})[e.part] = e

    @classmethod
    def open(cls, spark: SparkSession, root: str, number: int | None = None) -> "Release":
        """The newest release under ``root``, or the one of ``number``."""
        folder = f"{root.rstrip('/')}/{_FOLDER}"
        try:
            found = spark.read.schema(f"{_ENTRY}, release int").json(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            if number is not None:
                raise LookupError(f"no release under {root}") from e
            return cls(spark, root)
        newest = number if number is not None else found.agg(F.max("release")).first()[0]  # one value
        rows = [] if newest is None else found.where(F.col("release") == newest).drop("release").collect()  # metadata
        if number is not None and not rows:
            raise LookupError(f"no release {number} under {root}")
        if len({r.publisher for r in rows}) > 1:
            raise RuntimeError(f"release {newest} under {root} was published by two builds at once")
        return cls(spark, root, newest or 0, tuple(Entry(**r.asDict()) for r in rows))

    def parts(self, name: str) -> dict[str, Entry]:
        return self.by_name.get(name, {})

    def days(self, name: str) -> list[str]:
        return sorted(self.parts(name))

    def entry(self, name: str, day: str | None = None) -> Entry | None:
        """The entry of a table without partitions, or of its load day."""
        parts = self.parts(name)
        return parts.get("") or parts.get(day or "")

    def rows(self, name: str, parts=None) -> int:
        return sum(e.rows for p, e in self.parts(name).items() if parts is None or p in parts)

    def content(self, name: str) -> str:
        """What a table's partitions hold, as one text (equal texts mean equal rows)."""
        return ";".join(f"{p}:{e.rows}:{e.digest}" for p, e in sorted(self.parts(name).items()))

    def buckets(self, names, part: str) -> int | None:
        """The number of buckets that this partition of all the tables has, if it is one number."""
        found = {e.buckets if (e := self.parts(n).get(part)) else None for n in names}
        return found.pop() if len(found) == 1 else None

    def table(self, name: str, parts=None) -> DataFrame | None:
        """The table, or some of its partitions; None if the release has no such table.  One partition in buckets is
        read as such, so joins and groupings by its column need no shuffle."""
        entries = self.parts(name)
        if not entries:
            return None
        schema = StructType.fromJson(json.loads(next(iter(entries.values())).schema))
        chosen = [e for p, e in entries.items() if (parts is None or p in parts) and (e.rows or not e.column)]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        if len(chosen) == 1 and (e := chosen[0]).buckets:
            rows = StructType([f for f in schema if f.name != e.column])
            df = read_bucketed(self.spark, f"{base}/load={e.load}/{e.column}={e.part}", rows, e.cluster, e.buckets)
            return df.withColumn(e.column, F.lit(e.part).cast(schema[e.column].dataType)).select(*schema.fieldNames())
        paths = [f"{base}/load={e.load}" + (f"/{e.column}={e.part}" if e.column else "") for e in chosen]
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.fieldNames())

    def unused_folders(self, folders: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Of (table, load) pairs those that this release does not name, for the cluster's own clean-up."""
        used = {(n, e.load) for n, parts in self.by_name.items() for e in parts.values()}
        return [f for f in folders if f not in used]


class Load:
    """A build in progress: new tables beside those of the last release, published together or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.base = Release.open(spark, root)
        self.spark, self.root, self.id = spark, root.rstrip("/"), uuid.uuid4().hex[:16]
        self.state = Release(spark, root, self.base.number + 1,
                             tuple(e for parts in self.base.by_name.values() for e in parts.values()))

    def _write(self, name: str, df: DataFrame, column: str = "", part: str = "", cluster: str = "", buckets: int = 0) -> int:
        """Rows written, of a table or of one known partition (``part``) into its folder, as they lie or into buckets."""
        seen = Observation(f"rows of {name}")
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        path = f"{self.root}/{name}/load={self.id}"
        if part:
            df, path = df.drop(column), f"{path}/{column}={part}"
        if buckets:
            write_bucketed(df, path, cluster, buckets)
        else:
            df.write.option("compression", CODEC).parquet(path)
        return seen.get["rows"]

    def _stage(self, name: str, df: DataFrame, column: str) -> str:
        """Rows of all partitions, dealt to a folder of each by the tasks that made them, without shuffle or sort: many
        small files in a folder that no release names."""
        path = f"{self.root}/{_STAGING}/{name}/load={self.id}"
        tasks = max(STAGE_TASKS, 2 * self.spark.sparkContext.defaultParallelism)
        with open_files(self.spark):
            df.coalesce(tasks).write.partitionBy(column).option("compression", CODEC).parquet(path)
        return path

    def _enter(self, name: str, df: DataFrame, column: str = "", part: str = "", **kw) -> None:
        entry = Entry(name, part, self.id, kw.pop("rows"), kw.pop("day"), kw.pop("basis", ""), kw.pop("digest", ""), column,
                      df.schema.json(), cluster=kw.pop("cluster", None), buckets=kw.pop("buckets", None))
        parts = self.state.by_name.setdefault(name, {})
        if not column or "" in parts:
            parts.clear()
        parts[part] = entry

    def replace(self, name: str, df: DataFrame, day: str, basis: str = "") -> DataFrame:
        """A table as a whole; returns what was written."""
        self._enter(name, df, rows=self._write(name, df), day=day, basis=basis)
        return self.state.table(name)

    def replace_day(self, name: str, df: DataFrame, column: str, day: str, basis: str = "", cluster: str = "", buckets: int = 0) -> DataFrame:
        """One load day of a table (``df`` holds that day only), in ``buckets`` buckets by ``cluster`` if given; returns that day."""
        rows = self._write(name, df, column, day, cluster, buckets)
        self._enter(name, df, column, day, rows=rows, day=day, basis=basis, cluster=cluster or None, buckets=buckets or None)
        return self.state.table(name, [day])

    def replace_changed(self, name: str, base: DataFrame, column: str, day: str, derive, ignore=()) -> dict[str, list[str]]:
        """Of a table partitioned by ``column`` only the partitions whose rows differ from the last release.

        ``derive(base)`` is the table as it should be: ``base`` has its rows and the partition column, ``derive``
        adds, row by row, the columns that follow from others.  Partitions are compared by row count and two sums of
        row hashes (columns in ``ignore`` apart).  ``base`` is evaluated once, into a staging folder by partition; each
        changed partition is written from its small files there, some partitions at a time, so no row is
        shuffled to its partition.  Returns the changed, vanished and kept partitions.
        """
        whole = derive(base)
        had = {p: e for p, e in self.state.parts(name).items() if e.rows}
        stage, schema = self._stage(name, base, column), whole.schema.json()
        read = self.spark.read.schema(base.schema).option("basePath", stage)
        now = _digests(derive(read.parquet(stage)), column, [c for c in whole.columns if c not in ignore])
        changed = sorted(p for p, (n, d) in now.items() if p not in had or (had[p].rows, had[p].digest, had[p].schema) != (n, d, schema))

        def merge(part: str) -> None:
            rows = derive(read.parquet(f"{stage}/{column}={part}"))
            self._write(name, rows.coalesce(-(-now[part][0] // ROWS_A_FILE)), column, part)
        with ThreadPool(PART_WRITERS) as pool:
            pool.map(inheritable_thread_target(self.spark)(merge), changed, chunksize=1)
        vanished = sorted(set(had) - set(now))
        kept = {p: e for p, e in had.items() if p not in changed and p not in vanished}
        self.state.by_name[name] = {p: Entry(**{**e.__dict__, "day": day, "publisher": ""}) for p, e in kept.items()}
        for p in changed:
            self._enter(name, whole, column, p, rows=now[p][0], digest=now[p][1], day=day)
        if not now:  # a table without rows still has its schema
            self._enter(name, whole, column, rows=0, day=day)
        return {"changed": changed, "vanished": vanished, "kept": sorted(kept)}

    def publish(self) -> Release:
        rows = [(e.name, e.part, e.load, e.rows, e.day, e.basis, e.digest, e.column, e.schema, self.id, e.cluster, e.buckets)
                for parts in self.state.by_name.values() for e in parts.values()]
        manifest = self.spark.createDataFrame(rows, _ENTRY).coalesce(1)
        manifest.write.json(f"{self.root}/{_FOLDER}/release={self.state.number}")  # raises if it is there
        return self.state


def _digests(df: DataFrame, column: str, compare: list[str]) -> dict[str, tuple[int, str]]:
    """partition -> (rows, digest); as many rows as partitions reach the driver."""
    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *compare).cast("decimal(38,0)")).cast("string")
    got = df.groupBy(F.col(column).alias("part")).agg(F.count("*").alias("n"), F.concat_ws("/", total(1), total(2)).alias("d")).collect()
    return {r.part: (r.n, r.d) for r in got}
