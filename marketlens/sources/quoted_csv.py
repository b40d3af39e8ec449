"""CSV with quoted newlines, read by many tasks.

A line end inside quotes ends no record, so where a record begins depends on all quotes before it, and
Spark's ``multiLine`` reader therefore gives a whole file to one task.  Here a file is read as
lines, which Spark splits by byte ranges.  A line either starts inside a quoted field or not; what it
leads to is a function of these two states, and a split's function is the composition of its lines'
functions.  A first pass gives one such pair per split; folding the pairs in file order tells the
state in which each split begins.  In the second pass every split then cuts its lines into
records by itself.  Only a record that crosses a split's end travels: its pieces (at most two per
split) are joined in order.  Records are parsed by Spark's own CSV parser (``from_csv``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Arrow rows are lines; a batch is bounded by Spark's own Arrow settings.
_PIECES = "file string, block long, place int, closed boolean, value string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, if one was open (``inside``) or none at its start."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:  # at the start of a field: a quote elsewhere in a bare field means itself
            if line[at:at + 1] == '"':
                inside, at = True, at + 1
        if inside:
            close = line.find('"', at)
            while close >= 0 and line[close + 1:close + 2] == '"':  # a doubled quote
                close = line.find('"', close + 2)
            if close < 0:
                return True
            inside, at = False, close + 1
        comma = line.find(",", at)
        if comma < 0 or comma >= n:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def _runs(batches):
    """((file, block), lines) of consecutive rows of one split."""
    for batch in batches:
        files, blocks, values = (batch.column(i).to_pylist() for i in range(3))
        lo = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[lo], blocks[lo]):
                yield (files[lo], blocks[lo]), values[lo:i]
                lo = i


def _functions(batches):
    """One row per run of a split: the end state from outside, and from inside."""
    for (file, block), lines in _runs(batches):
        out, ins = False, True
        for line in lines:
            if '"' in line:
                out, ins = ends_inside(line, out), ends_inside(line, ins)
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([out]), pa.array([ins])],
                                         names=["file", "block", "outside", "inside"])


def _cutter(begins: dict):
    def cut(batches):
        held, lines, state, first, header = None, [], False, False, False

        def row(place, closed, value):
            return held[0], held[1], place, closed, value

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                names=["file", "block", "place", "closed", "value"])

        for split, values in _runs(batches):
            rows = []
            if split != held:
                if lines:
                    rows.append(row(0 if first else 2, False, "\n".join(lines)))
                held, lines, state = split, [], begins[split]
                first = state  # the split begins inside a record of an earlier one
                header = split[1] == 0
            for line in values:
                lines.append(line)
                state = ends_inside(line, state)
                if not state:
                    if not header:
                        rows.append(row(0 if first else 1, True, "\n".join(lines)))
                    lines, first, header = [], False, False
            if rows:
                yield batch_of(rows)
        if lines:
            yield batch_of([row(0 if first else 2, False, "\n".join(lines))])
    return cut


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the records of the files at ``path``, without each file's header and empty lines.

    ``block`` is the byte range that a record begins in."""
    lines = _lines(spark, path)
    found = lines.mapInArrow(_functions, "file string, block long, outside boolean, inside boolean").collect()  # a row per Arrow batch of a split
    begins, state = {}, {}
    for r in sorted(found, key=lambda r: (r.file, r.block)):  # stable: runs of one split stay in their order
        begins.setdefault((r.file, r.block), state.get(r.file, False))
        state[r.file] = r.inside if state.get(r.file, False) else r.outside
    pieces = lines.mapInArrow(_cutter(begins), _PIECES)
    whole = pieces.where("place = 1").select("file", "block", "value")
    # place 2 opens a record that later splits carry on (place 0)
    parts = pieces.where("place <> 1").withColumn("opener", F.last(F.when(F.col("place") == 2, F.col("block")), True).over(
        Window.partitionBy("file").orderBy("block", "place")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "value"))), lambda x: x["value"]), "\n")
    crossing = parts.groupBy("file", F.col("opener").alias("block")).agg(text.alias("value"))
    every = whole.unionByName(crossing)
    # a CRLF file leaves the carriage return of the last line
    every = every.withColumn("value", F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    return every.where("value <> ''")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header; equal to ``spark.read.csv`` with header, multiLine and doubled quotes."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    columns = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in columns)
    return records(spark, path).select(F.from_csv("value", schema, options).alias("r")).select("r.*")
