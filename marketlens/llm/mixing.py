"""Operator 2 [native]: mix sources to target weights by Pfair scheduling.

Each source's rows are dealt into blocks of ``block_rows`` in a fixed random
order (MD5 of the id).  A source of weight ``q`` out of ``Q`` (sum over the
sources present) gets for its block j = 1, 2, ... the release slot
``floor((j-1) Q/q)`` and the deadline ``ceil(j Q/q)``; each slot goes to the
released block with the earliest deadline.  With one block a slot this keeps
every source within less than one block of its share ``t q/Q`` at every slot t.
Weights are whole numbers, so the schedule repeats after Q slots: one frame of Q
rows is scheduled, and block j of a source falls at ``Q * ((j-1) div q)`` plus the
slot of its ``(j-1) mod q``-th turn in the frame.  Rows never pass through one
task: only the frame (Q slots, the sum of the sources' weights) is made in one place, by a fold that looks at
each distinct weight once a slot; sources of equal weight take their group's turns round-robin.

Row numbers inside a source come from hash ranges: the MD5 order is cut into as
many ranges as eight per shuffle partition, rows are numbered inside (source,
range) and lifted by the counts of the ranges before, so a source with a third
of all rows is spread over all tasks.

Defined cases: all rows stay.  When a source runs out its slots stay empty and
the others keep their relative rates (``on_target`` marks slots before any source
runs out; the deviation bound holds there).  A null source is a source of its
own (weight key None); an unlisted source has ``default_weight``; null ids come
first in their source; equal ids are ordered by their other columns; an empty
table gives no rows.  ``slot`` and ``pos`` order the mixture.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Target weights of the registered query and the pipeline stage; others have weight 1.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2}
BLOCK_ROWS = 16
#: A frame of at most so many slots (some MB) is broadcast; a longer one is joined like any table.
BROADCAST_SLOTS = 100_000


def quantise(weights: dict, frame: int = 1000) -> dict:
    """Real weights to whole turns in a frame (largest remainder, at least one turn each)."""
    total = float(sum(weights.values()))
    exact = {k: w * frame / total for k, w in weights.items()}
    turns = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[: max(0, frame - sum(turns.values()))]:
        turns[k] += 1
    g = gcd(*turns.values())
    return {k: v // g for k, v in turns.items()}


def frame_slots(quota: DataFrame) -> DataFrame:
    """(src, q, frame, turn, frame_slot): one frame for ``quota(src, q)``, the EDF rule as a fold over its slots.

    Sources of equal weight are one group: the rule takes them in turn, so a group's next source
    follows from its number of turns, and a slot costs a look at each distinct weight."""
    one = quota.agg(F.sort_array(F.collect_list(F.struct("src", "q"))).alias("s"), F.sum("q").alias("frame")).where("frame > 0")
    one = (one.select("frame", F.col("s.src").alias("names"), F.col("s.q").alias("q"), F.expr("array_sort(array_distinct(s.q))").alias("w"))
           .withColumn("ks", F.expr("transform(w, x -> filter(sequence(0, size(q) - 1), i -> q[i] = x))"))  # by weight, the places of its sources
           .withColumn("stride", F.ceil(F.sqrt("frame")).cast("long")))
    # state: turns taken per group; a group's next source has turns div size blocks done, is released at slot t when
    # done * frame <= t * w, and its next deadline is ceil((done + 1) frame / w); ties go to the first source by name
    pick = """array_min(transform(st.taken, (n, g) -> struct(
        if((n div size(ks[g])) * frame <= t * w[g], ((n div size(ks[g]) + 1) * frame + w[g] - 1) div w[g], 9223372036854775807L) as deadline,
        ks[g][cast(n % size(ks[g]) as int)] as k, g as g)))"""
    slot = f"""transform(array({pick}), x -> struct(
        transform(st.taken, (n, g) -> if(g = x.g, n + 1L, n)) as taken, concat(st.won, array(x.k)) as won))[0]"""
    # strides of sqrt(frame) slots keep the lists that a slot is appended to short
    stride = f"""aggregate(sequence(a, least(a + stride, frame) - 1), struct(whole.taken as taken, cast(array() as array<int>) as won),
        (st, t) -> {slot})"""
    fold = f"""aggregate(sequence(0L, frame - 1, stride), struct(transform(w, x -> 0L) as taken, cast(array() as array<array<int>>) as won),
        (whole, a) -> transform(array({stride}), r -> struct(r.taken as taken, concat(whole.won, array(r.won)) as won))[0],
        whole -> flatten(whole.won))"""
    slots = (one.select("names", "q", "frame", F.posexplode(F.expr(fold)).alias("at", "k"))
             .select(F.expr("names[k]").alias("src"), F.expr("q[k]").alias("q"), "frame", F.col("at").cast("long").alias("frame_slot")))
    turn = Window.partitionBy("src").orderBy("frame_slot")  # over one frame only
    return slots.withColumn("turn", F.row_number().over(turn).cast("long") - 1)


def mix_sources(spark: SparkSession, docs: DataFrame, weights: dict = WEIGHTS, default_weight: int = 1,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with block, slot, pos and on_target added; order by (slot, pos) to read the mixture."""
    if any(int(w) != w or w < 1 for w in [*weights.values(), default_weight]):
        raise ValueError("weights are whole numbers of at least 1; use quantise() for real ones")
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = {"block", "slot", "pos", "on_target"}
    keep = [c for c in docs.columns if c not in made]
    # columns travel under neutral names, so that none clashes with a column made here
    plain = [f"c{i}" for i in range(len(keep))]
    docs = docs.select(*[f"`{c}`" for c in keep]).toDF(*plain)
    doc_id, source = (F.col(plain[keep.index(c)]) for c in ("doc_id", "source"))
    others = [c for c, t in docs.dtypes if "map<" not in t]
    md5 = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    at = F.floor(F.conv(F.substring(md5, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32))
    name = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # "" is the null source
    rows = docs.select(*plain, name.alias("src"), md5.alias("md5"), at.alias("part"))

    # counts of (source, range): at most sources x ranges rows, then prefix sums inside a source
    counts = docs.select(name.alias("src"), at.alias("part")).groupBy("src", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("src").orderBy("part")
    before = counts.select("src", "part", (F.sum("n").over(by) - F.col("n")).alias("before"))

    w = F.lit(default_weight).cast("long")
    for key, x in weights.items():
        w = F.when(F.col("src") == ("" if key is None else "=" + key), F.lit(int(x)).cast("long")).otherwise(w)
    totals = counts.groupBy("src").agg(F.sum("n").alias("n")).withColumn("q", w)
    turns = frame_slots(totals)
    # the slot of the first last block of any source
    until = (totals.select("src", F.expr(f"(n + {block_rows} - 1) div {block_rows}").alias("blocks")).join(turns, "src")
             .where("turn = (blocks - 1) % q").agg(F.min(F.expr("((blocks - 1) div q) * frame + frame_slot"))).scalar())

    order = Window.partitionBy("src", "part").orderBy(F.col("md5"), doc_id.asc_nulls_first(), *others)
    numbered = (rows.withColumn("at", F.row_number().over(order).cast("long") - 1)
                .join(before, ["src", "part"]).withColumn("j", F.col("at") + F.col("before"))
                .withColumn("block", F.expr(f"j div {block_rows}")).withColumn("pos", F.expr(f"j % {block_rows}")))
    slots = totals.agg(F.sum("q")).first()[0] or 0  # one value
    t = F.broadcast(turns) if slots <= BROADCAST_SLOTS else turns
    placed = numbered.join(t, (numbered.src == t.src) & (F.col("turn") == F.expr("block % q"))).withColumn(
        "slot", F.expr("(block div q) * frame + frame_slot"))
    return placed.select(*plain, "block", "slot", "pos", (F.col("slot") <= until).alias("on_target")).toDF(
        *keep, "block", "slot", "pos", "on_target")


def write_mixture(mixed: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the mixture in reading order: files hold consecutive slot ranges."""
    n = [partitions] if partitions else []
    mixed.repartitionByRange(*n, "slot", "pos").sortWithinPartitions("slot", "pos").write.parquet(path)
