"""Operator 13: Merkle manifest of a dataset by slot pivots.

Every row is a leaf: the SHA-256 of its fields, each written with its length.  Inside a
group (a language) the leaves ascend by their id and every ``fanout`` consecutive nodes
become the digest of their concatenation, until one node is left: the group's subroot.  The
subroots, ordered by group, give the root in the same way.

A level is one aggregate.  Conditional aggregates spread the children of a parent into
``fanout`` slot columns; the digest of all slot columns is the parent, and all columns but the
own one are a child's siblings.  Proofs come down from the top: a parent's row, with the path
above it, is expanded into its children again, so a document's proof takes no join of its
own; joins are between a level's nodes and their slots, an eighth of the level below.

Digests travel as 32 bytes; hashes are taken of their lowercase hex text.  Texts are read
twice by hash expressions and never shuffled.  A leaf's place in its group is its place in
a range partition (sorted by group, id and digest) plus the sizes of the partitions before, so a
group holding most rows is spread over many tasks.  Sorted leaves, slots and counts are
written once to the shared folder.

Defined cases: a null id comes before all others; of equal ids the smaller leaf digest comes
first; repeated rows are leaves of their own (equal digests, any order gives the same tree); null
and empty texts differ (``-`` against ``0:``); an empty table gives no rows; a table of one row
has its leaf as subroot and root and the digest of nothing as proof.  Other columns are not read,
so their names cannot clash.  A text of any length is hashed as it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, ascii_lower, crc_mod, numbered

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(c: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else byte count, colon, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


class Forest:
    """One tree per group over ``nodes(grp, pos, n, d, c)``: place in the group, size of the group, digest, payload."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a parent needs at least two children")
        self.nodes, self.fanout, self.levels = nodes, fanout, []
        self.tops = [nodes.where("n = 1")]  # per level the nodes that are alone in their group
        most = nodes.agg(F.max("n")).first()[0] or 0  # one value: the largest group decides the number of levels
        slots = [f"any_value(case when pos % {fanout} = {k} then struct(d, c) end, true) as s{k}" for k in range(fanout)]
        self.slot = [f"coalesce(s{k}.d, X'')" for k in range(fanout)]
        while most > 1:
            level = scratch.table(nodes.where("n > 1").selectExpr("grp", "pos", "n", "d", "c", f"pos div {fanout} as parent", f"(n + {fanout - 1}) div {fanout} as parents")
                                  .groupBy("grp", F.col("parent").alias("pos"), F.col("parents").alias("n")).agg(*map(F.expr, slots)))
            self.levels.append(level)
            nodes = level.selectExpr("grp", "pos", "n", f"unhex(sha2(lower(hex(concat({', '.join(self.slot)}))), 256)) as d", "cast(null as string) as c")
            self.tops.append(nodes.where("n = 1"))
            most = -(-most // fanout)

    def roots(self) -> DataFrame:
        """(grp, d): the root of each group."""
        return reduce(DataFrame.unionByName, [t.select("grp", "d") for t in self.tops])

    def proofs(self, above: DataFrame, scratch: Scratch) -> DataFrame:
        """(grp, d, c, path) per leaf; ``path`` is an array, leaf level first, of the siblings (left, right) as bytes.

        ``above(grp, path)`` holds the path that starts at each group's root."""
        f, down = self.fanout, None
        for depth in range(len(self.levels), 0, -1):
            level = self.levels[depth - 1]
            # paths of this level's nodes: groups whose root is here, and children of the level above
            here = self.tops[depth].select("grp", "pos").join(above, "grp").select("grp", "pos", "path")
            if down is not None:
                here = here.unionByName(down.select("grp", "pos", "path"))
            def beside(slots):
                return f"concat({', '.join(slots) or 'X' + chr(39) * 2})"
            children = ", ".join(
                f"case when s{k} is not null then struct(pos * {f} + {k} as pos, s{k}.d as d, s{k}.c as c, "
                f"struct({beside(self.slot[:k])} as left, {beside(self.slot[k + 1:])} as right) as own) end" for k in range(f))
            down = (here.join(level.drop("n"), ["grp", "pos"]).selectExpr("grp", "path", f"explode(array_compact(array({children}))) as e")
                    .selectExpr("grp", "e.pos", "e.d", "e.c", "concat(array(e.own), path) as path"))
            if depth > 1:
                down = scratch.table(down.select("grp", "pos", "path"))
        lone = self.tops[0].join(above, "grp").select("grp", "d", "c", "path")
        return lone if down is None else lone.unionByName(down.select("grp", "d", "c", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.unhex(F.sha2(F.lower(F.hex(F.concat(x["left"], acc, x["right"]))), 256)))


def proof_bytes(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.aggregate(path, F.lit(b""), lambda acc, x: F.concat(acc, x["left"], x["right"]))


def merkle_manifest(spark: SparkSession, rows: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id",
                    claim=None, fanout: int = FANOUT) -> DataFrame:
    """(order, leaf, subroot, root, path, claimed) per row; digests as bytes.

    ``claim`` (list of columns -> Column digest) is what somebody else claims the row's leaf to
    be, read in the same pass; without it ``claimed`` is the leaf itself.
    """
    scratch = Scratch(spark, "merkle")
    given = [F.col(f"`{c}`") for c in fields]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = scratch.table(rows.select(key.alias("grp"), F.col(f"`{order}`").alias("id"), leaf_hash(given).alias("d"),
                                       (claim(given) if claim else F.lit(None).cast("binary")).alias("claim")))
    placed = numbered(leaves, ["grp"], ["id", "d"], scratch)
    inner = Forest(placed.select("grp", "pos", "n", "d", F.struct("id", "claim").alias("c")), scratch, fanout)
    subroots = scratch.table(inner.roots())
    outer = Forest(numbered(subroots.select(F.lit("").alias("all"), "grp", "d"), ["all"], ["grp"], scratch)
                   .select(F.col("all").alias("grp"), "pos", "n", "d", F.struct("grp", F.col("d").alias("subroot")).alias("c")), scratch, fanout)
    top = outer.roots().first()  # one row; none for an empty table
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    start = spark.range(1).select(F.lit("").alias("grp"), none.alias("path"))
    above = scratch.table(outer.proofs(start, scratch).select("c.grp", "c.subroot", "path"))
    root = F.lit(bytes(top["d"]) if top else None).cast("binary")
    leaves = inner.proofs(above.select("grp", "path"), scratch)
    return (leaves.join(above.select("grp", "subroot"), "grp")
            .select(F.col("c.id").alias(order), F.col("d").alias("leaf"), "subroot", root.alias("root"), "path",
                    F.coalesce("c.claim", "d").alias("claimed")))


def changed_copy(fields: list[Column]) -> Column:
    """The leaf of a row whose text was tampered with (A-Z lower-cased) where 3 divides the id's CRC-32; else null."""
    doc_id, *rest, text = fields
    return F.when(crc_mod(doc_id, 3) == 0, leaf_hash([doc_id, *rest, ascii_lower(text)]))
