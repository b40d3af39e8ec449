"""Selection of order statistics by counting: tile cuts and exact percentiles without a sort.

A tile is decided by a few cuts: the rows that stand at its last positions in the total order
(value, key).  Each cut is found by counting passes.  A pass deals the values of a bracket into at most
``BINS`` bins (an aggregate with map-side combine), and the bin that holds the wanted position
becomes the next bracket, by its own least and greatest value, until one value is left.  Rows that tie at
that value are counted by the beginning of their key in the same way, until few enough
are left to read.  All cuts advance in one job a pass; the driver sees bins, never rows.

The tiles themselves are then one column expression: how many cuts a row lies behind.  Nothing is
range-partitioned, sorted or numbered, whatever the number of rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from marketlens.session import ensure_checkpoint_dir

#: Bins of a pass, and rows of a tie that are read instead of counted again.
BINS, FEW = 4096, 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once, read by each pass."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Order:
    """A total order of rows: a numeric column, descending or not, then a key ascending (a null key first)."""

    column: str
    key: str | None = None
    desc: bool = False
    nulls_first: bool = True

    def value(self) -> Column:
        return -F.col(self.column) if self.desc else F.col(self.column)


@dataclass
class Cut:
    """The row at ``position`` (1-based) of an order; found when ``left`` holds."""

    order: Order
    position: int
    null: bool = False          # the position is among the null values
    value: str | None = None    # as text of the column's own type
    key: str | None = None      # None: the cut ends its tie, so no key is needed
    bracket: tuple[str, str] | None = None
    rows: int = 0               # rows in the bracket
    prefix: str = ""
    key_null: bool = False      # the cut's row has no key (it comes first in its tie)
    stage: str = field(default="value")


class Selection:
    """Finds cuts of a written table; ``weight`` is a column of row counts (default: each row counts once)."""

    def __init__(self, table: DataFrame, weight: str | None = None):
        self.table, self.n = table, F.sum(F.col(weight)) if weight else F.count(F.lit(1))

    def _type(self, cut: Cut):
        return self.table.select(cut.order.value().alias("x")).schema["x"].dataType

    def _tie(self, cut: Cut) -> Column:
        x = cut.order.value()
        return x.isNull() if cut.null else x == F.lit(cut.value).cast(self._type(cut))

    def _run(self, branches: list[DataFrame]) -> dict[int, list]:
        got = reduce(DataFrame.unionByName, branches).collect() if branches else []  # bins, or at most FEW keys a cut
        out: dict[int, list] = {}
        for r in got:
            out.setdefault(r.at, []).append(r)
        return out

    def find(self, wanted: list[tuple[Order, int]]) -> list[Cut]:
        """Cuts for (order, position) pairs; positions lie within 1 and the number of rows."""
        cuts = [Cut(o, p) for o, p in wanted]
        orders = list(dict.fromkeys(c.order for c in cuts))
        ends = self._run([self.table.groupBy(o.value().isNull().alias("null")).agg(
            self.n.alias("n"), F.min(o.value()).cast("string").alias("lo"), F.max(o.value()).cast("string").alias("hi"))
            .withColumn("at", F.lit(i)) for i, o in enumerate(orders)])
        for c in cuts:
            sides = {r.null: r for r in ends.get(orders.index(c.order), [])}
            nulls, rest = (sides[k].n if k in sides else 0 for k in (True, False))
            before = nulls if c.order.nulls_first else 0
            c.null = c.position <= nulls if c.order.nulls_first else c.position > rest
            if c.null:
                c.position, c.rows, c.stage = c.position - (0 if c.order.nulls_first else rest), nulls, "tie"
            else:
                c.position, c.rows, c.bracket = c.position - before, rest, (sides[False].lo, sides[False].hi)
            self._settle(c)
        while any(c.stage != "done" for c in cuts):
            self._pass([c for c in cuts if c.stage != "done"])
        return cuts

    def _settle(self, c: Cut) -> None:
        """Move a cut on as far as its bracket allows."""
        if c.stage == "value" and c.bracket[0] == c.bracket[1]:
            c.value, c.stage, c.bracket = c.bracket[0], "tie", None
        if c.stage == "tie" and (c.order.key is None or c.position == c.rows):
            c.stage = "done"  # the whole tie lies before the cut

    def _pass(self, cuts: list[Cut]) -> None:
        branches, shared = [], {}
        for i, c in enumerate(cuts):
            what = (c.order, c.stage, c.bracket, c.value, c.null, c.prefix)
            if what in shared:  # cuts in one bracket share its bins
                continue
            shared[what] = i
            branches.append((self._value_bins(c) if c.stage == "value" else self._key_bins(c)).withColumn("at", F.lit(i)))
        got = self._run(branches)
        for c in cuts:
            what = (c.order, c.stage, c.bracket, c.value, c.null, c.prefix)
            c_rows = got[shared[what]]
            self._advance(c, c_rows)

    def _value_bins(self, c: Cut) -> DataFrame:
        x, t = c.order.value(), self._type(c)
        lo, hi = (F.lit(v).cast(t) for v in c.bracket)
        span = F.lit(float(c.bracket[1]) - float(c.bracket[0]))
        place = F.when(span > 0, F.floor((x.cast("double") - lo.cast("double")) / span * (BINS - 2))).otherwise(F.lit(0))
        bin_ = F.when(x <= lo, F.lit(0)).otherwise(1 + place).cast("long").cast("string")  # the least value apart: each pass narrows
        return (self.table.where(x.between(lo, hi)).groupBy(bin_.alias("bin"))
                .agg(self.n.alias("n"), F.min(x).cast("string").alias("lo"), F.max(x).cast("string").alias("hi")))

    def _key_bins(self, c: Cut) -> DataFrame:
        key = F.col(c.order.key)
        tie = self.table.where(self._tie(c))
        if not isinstance(self.table.schema[c.order.key].dataType, StringType):
            key = key.cast("decimal(38,0)")
            if c.bracket is None:
                return tie.groupBy(key.isNull().cast("string").alias("bin")).agg(self.n.alias("n"), F.min(key).cast("string").alias("lo"), F.max(key).cast("string").alias("hi"))
            lo, hi = (F.lit(v).cast("decimal(38,0)") for v in c.bracket)
            span = max(int(c.bracket[1]) - int(c.bracket[0]), 1)
            bin_ = F.floor((key - lo).cast("double") / F.lit(float(span)) * (BINS - 2)).cast("string")
            if c.rows <= FEW:
                bin_ = key.cast("string")
            tie = tie.where(key.between(lo, hi))
        else:
            bin_ = key if c.rows <= FEW else F.substring(key, len(c.prefix) + 1, 2)
            tie = tie.where(F.substring(key, 1, len(c.prefix)) == F.lit(c.prefix)) if c.prefix else tie
        return tie.groupBy(bin_.alias("bin")).agg(self.n.alias("n"), F.min(key).cast("string").alias("lo"), F.max(key).cast("string").alias("hi"))

    def _advance(self, c: Cut, bins: list) -> None:
        text = c.stage == "tie" and isinstance(self.table.schema[c.order.key].dataType, StringType)
        for r in sorted(bins, key=lambda r: (r.lo is not None, (r.lo or "") if text else float(r.lo or 0))):
            if c.position <= r.n:
                break
            c.position -= r.n
        c.rows = r.n
        if c.stage == "value":
            c.bracket = (r.lo, r.hi)
            self._settle(c)
        elif r.lo is None:
            c.key_null, c.stage = True, "done"
        elif r.lo == r.hi:
            c.key, c.stage = r.lo, "done"
        elif text:
            same = next((i for i, (a, b) in enumerate(zip(r.lo, r.hi, strict=False)) if a != b), min(len(r.lo), len(r.hi)))
            c.prefix = r.lo[:same]
        else:
            c.bracket = (r.lo, r.hi)

    def behind(self, c: Cut) -> Column:
        """Whether a row comes after the cut."""
        x = c.order.value()
        if c.key_null:
            tied = F.col(c.order.key).isNotNull()
        elif c.key is None:
            tied = F.lit(False)
        else:
            tied = F.coalesce(F.col(c.order.key) > F.lit(c.key).cast(self.table.schema[c.order.key].dataType), F.lit(False))
        if c.null:
            return F.coalesce(x.isNotNull() | tied if c.order.nulls_first else x.isNull() & tied, F.lit(False))
        at = F.lit(c.value).cast(self._type(c))
        after = (x > at) | ((x == at) & tied)
        return F.coalesce(after, F.lit(not c.order.nulls_first))


def tile_ends(n: int, k: int) -> list[int]:
    """Last positions of the tiles 1 .. k-1 of ``NTILE(k)`` over n rows (no empty tiles: they end at n)."""
    q, r = divmod(n, k)
    return [min(n, i * q + min(i, r)) for i in range(1, k)]


def rank_bin_ends(n: int, k: int) -> list[int]:
    """Last positions of the bins 1 .. k-1 of ``qcut`` over the ranks 1 .. n: the greatest rank with k (rank - 1) <= i (n - 1)."""
    return [i * (n - 1) // k + 1 for i in range(1, k)]


def tiles(table: DataFrame, asks: dict[str, tuple[Order, list[int]]]) -> DataFrame:
    """``table`` (written) with a tile number per name: one more than the cuts (at given last positions) that a row lies behind."""
    found = Selection(table)
    wanted = [(o, p) for o, ends in asks.values() for p in ends if p > 0]
    cuts = iter(found.find(wanted) if wanted else [])
    out = {}
    for name, (_, ends) in asks.items():
        number = F.lit(1)
        for p in ends:
            number = number + (found.behind(next(cuts)).cast("int") if p > 0 else F.lit(1))
        out[name] = number.cast("int")
    return table.withColumns(out)


def values_at(df: DataFrame, column: str, shares: Sequence[float]) -> list[tuple[float, float, float]] | None:
    """(lower, upper, fraction) around position share * (n - 1) of a numeric column's values, for linear percentiles;
    None if there is no value.  Values are counted first, so each pass reads a row per distinct value."""
    x = F.col(column).cast("double")
    counted = written(df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n")), "values")
    n = counted.agg(F.sum("n")).first()[0]  # one value
    if not n:
        return None
    at = [s * (n - 1) for s in shares]
    order = Order("x")
    cuts = Selection(counted, "n").find([(order, p) for a in at for p in (math.floor(a) + 1, math.ceil(a) + 1)])
    return [(float(cuts[2 * i].value), float(cuts[2 * i + 1].value), a - math.floor(a)) for i, a in enumerate(at)]
