"""Operator 10: substring dedup by hashed units (sentences of lines, lines or paragraphs) and word windows.

Every text is cut into units with their original offsets (code points); a unit is
normalised (lower case, white space as one blank) and hashed to 128 bits.  The
digests are grouped globally, the earliest ranked occurrence (smallest rank, then
offset) is kept, and the others are repeats.  Repeats that touch or overlap in a
document form a run; runs of at least ``min_words`` words are removed, so common
short lines stay while long repeated passages go.  The removal is a table of spans;
``remove`` applies it.

Units default to ``"passage"``: the sentences of each line (a sentence of fewer than
``GLUE_WORDS`` words is read together with the next one of its line) and every window
of ``min_words`` words, so a repeated passage of ``min_words`` words is found wherever it
starts and ends.  Windows are not shuffled one by one: every window names the smallest hash
of the half-windows in it (its seed, winnowing), and neighbouring windows that name the same
one are a chunk, one row.  Inside a repeated passage the chunks repeat too, so

* keys (of units, seeds of chunks) that occur twice are counted first; a filter of them keeps most other rows
  from being shuffled again;
* chunks are grouped by seed; a chunk equal to the first one of its seed is a repeat as a whole;
* the unequal ones (the ends of passages, shared half-windows) are grouped by content; all but the first of
  equal ones are repeats, and only of these first ones every window is hashed, from the texts that hold one,
  and grouped.

A window that overlaps its own kept occurrence is no repeat.  In scripts written without
blanks every character counts as a word of a window, and so does a run of ``CHUNK`` characters
without a blank.  ``unit="sentence"``, ``"line"`` and ``"paragraph"`` hash only whole sentences,
lines or blank-line paragraphs.

A digest held by a third of all units is combined before the shuffle; the decision goes
back to the units of frequent digests by a broadcast, of the others by a merge join.
A document's runs are found among its own repeats only.

Defined cases: null and empty texts have no units; a document is a row's id and text, told
apart by a hash of the text, so rows without an id, or of one id with other texts, are documents of
their own and are never cut by each other's offsets; of equal ids the smaller hash ranks first, null
ids rank before all (and are no member of ``kept_doc_ids``); of equal ranks the smaller offset is kept,
so a repeat inside one document goes too; repeated rows (equal id and text) are one document and
never remove each other; empty tables give no spans; a long text is read in pieces of ``CHUNK``
characters; other columns are not returned by ``repeated_spans`` and pass through ``remove``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, fresh, small_batches

MIN_WORDS = 40
GLUE_WORDS = 4
CUT = {
    "sentence": re.compile(r"(?<=[.!?])[^\S\n]+|\n+"),
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[^\S\n]*\n+"),
}
CUT["passage"] = CUT["sentence"]
#: Thai to Tibetan, Burmese, Khmer, kana, Han: written without blanks.
SOLID = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
WORD = re.compile(rf"[{SOLID}]|[^\s{SOLID}]+")
#: Characters that are cut into words at a time, and windows that are looked at together.
CHUNK, PIECE = 1 << 16, 1 << 15
#: Bits of the largest filter of repeated keys (64 MB) and of the blocks it is made of.
FILTER_BITS, FILTER_BLOCK = 1 << 29, 1 << 19
#: A key with more than one in HOT_SHARE of all rows is joined by broadcast; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 10_000


def cut_units(text: str, unit: str):
    """(start, end, words, digest) of each unit of a text; offsets count code points."""
    at, head, size, held = 0, 0, 0, []
    glue = GLUE_WORDS if unit in ("sentence", "passage") else 0
    cuts = CUT[unit].finditer(text)
    while True:
        m = next(cuts, None)
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        w = text[at:stop].split()
        if w:
            if not held:
                head = at
            held += w
            size, end = len(held), stop
            # short sentences wait for the next one of the same line
            if len(w) >= glue or m is None or "\n" in m[0]:
                yield head, end, size, xxhash.xxh3_128_digest(" ".join(held).lower().encode("utf-8", "surrogatepass"))
                held = []
        elif held and (m is None or "\n" in m[0]):
            yield head, end, size, xxhash.xxh3_128_digest(" ".join(held).lower().encode("utf-8", "surrogatepass"))
            held = []
        if m is None:
            return
        at = after


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 white space, 1 letter of a word, 2 a word of its own; and its lower case."""
    kind, lower = np.ones(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for a, b in re.findall("(.)-(.)", SOLID):
        kind[ord(a):ord(b) + 1] = 2
    for c in range(0x1F000):  # no code point above has white space or case
        x = chr(c)
        if x.isspace():
            kind[c] = 0
        elif len(low := x.lower()) == 1:
            lower[c] = ord(low)
    return kind, lower


_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Sums:
    """Hashes of ranges of a sequence of numbers, from running sums."""

    def __init__(self, values: np.ndarray, which: int):
        n = 1 << max(17, len(values).bit_length())
        self.up, self.down = _powers(which, n)
        self.total = np.append(np.uint64(0), np.cumsum(values * self.up[:len(values)], dtype=np.uint64))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.total[hi] - self.total[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def _words(text: str) -> tuple[np.ndarray, ...]:
    """(start, end, hash, other hash) of the words of a text, lower-cased; offsets count code points."""
    kind_of, lower = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.concatenate([[0], kind_of[points], [0]]).astype(np.uint8)
    here, one = kind[1:-1], kind == 1
    start = np.flatnonzero((here == 2) | (one[1:-1] & ~one[:-2]))
    end = np.flatnonzero((here == 2) | (one[1:-1] & ~one[2:])) + 1
    values = lower[points].astype(np.uint64) + np.uint64(1)
    return start, end, _Sums(values, 0).of(start, end), _Sums(values, 1).of(start, end)


def read_words(texts: list[str], keep: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, number in the row, start, end, hash, other hash) of the words of all texts, in turn.

    Texts are read ``CHUNK`` characters at a time, short ones together; when a text goes on, its last ``keep``
    words come again at the beginning of the next arrays, so every window of keep + 1 words is in exactly one.
    """
    parts, size, carry = [], 0, None  # parts: (row, number of its first word, offset of its first character, text)

    def flush(goes_on: bool):
        nonlocal parts, size, carry
        begins = np.cumsum([0] + [len(p[3]) + 1 for p in parts])
        start, end, h, g = _words("\n".join(p[3] for p in parts))
        part = np.searchsorted(begins, start, side="right") - 1
        before = np.searchsorted(start, begins[:-1])
        row, number, offset = (np.array([p[k] for p in parts], np.int64)[part] for k in range(3))
        shift = offset - begins[part]
        out = [row, number + np.arange(len(start)) - before[part], start + shift, end + shift, h, g]
        last = len(start) - before[-1]  # words of the last part
        if carry is not None:
            out = [np.concatenate([c, o]) for c, o in zip(carry, out, strict=True)]
        carry = [o[max(0, len(o) - keep):][out[0][max(0, len(o) - keep):] == parts[-1][0]] for o in out] if goes_on else None
        parts, size = [], 0
        return out, last

    for i, text in enumerate(texts):
        at = number = 0
        text = text or ""
        while len(text) - at > CHUNK:  # a long text: cut before its last word that may go on
            stop = at + CHUNK
            while stop > at and not text[stop - 1].isspace():
                stop -= 1
            stop = stop if stop > at else at + CHUNK
            if parts:
                yield flush(False)[0]
            parts = [(i, number, at, text[at:stop])]
            out, n = flush(True)
            yield out
            at, number = stop, number + n
        parts.append((i, number, at, text[at:]))
        size += len(text) - at
        if size > CHUNK or carry is not None:
            yield flush(False)[0]
    if parts:
        yield flush(False)[0]


def _windows(words: tuple[np.ndarray, ...], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(lo, hi, seed, content) of each chunk: the words that it covers, by index into ``words``."""
    row, half = words[0], (size + 1) // 2
    n, few = len(row) - size + 1, size - half + 1
    if n <= 0:
        return
    first, second = _Sums(words[4], 0), _Sums(words[5], 1)
    at = np.arange(n + few - 1)
    seeds = first.of(at, at + half)
    inside = row[:n] == row[size - 1:]
    for a in range(0, n, PIECE):
        b = min(n, a + PIECE)
        seed_at = np.lib.stride_tricks.sliding_window_view(seeds[a:b + few - 1], few).argmin(1) + np.arange(a, b)
        w = np.flatnonzero(inside[a:b]) + a
        if not len(w):
            continue
        named = seed_at[w - a]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(named) != 0) | (np.diff(w) != 1)]))
        lo, hi = w[new], np.append(w[new[1:] - 1], w[-1]) + size
        yield lo, hi, seeds[named[new]], second.of(lo, hi)


def text_hash() -> Column:
    return F.hash(F.coalesce("text", F.lit("")))


UNITS = "doc_id long, t int, lo int, hi int, start int, end int, whole boolean, h1 long, h2 long"


def _rows(batch, owner, *columns) -> pa.RecordBatch:
    """Rows of ``UNITS``: id and text hash of the owners' rows in the batch, then columns."""
    names = [x.split()[0] for x in UNITS.split(", ")]
    types = [*[pa.int32()] * 4, pa.bool_(), pa.int64(), pa.int64()]
    row = [batch.column(c).take(pa.array(owner, pa.int64())) for c in ("doc_id", "t")]
    return pa.RecordBatch.from_arrays([*row, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), "text")


def units(docs: DataFrame, unit: str = "passage", size: int = MIN_WORDS, seen=None) -> DataFrame:
    """(doc_id, t, lo, hi, start, end, whole, h1, h2): t is a hash of the text, which tells rows of one id apart;
    the words and offsets of every unit (``whole``) and, for passages, of every chunk of windows, h1 being its seed.
    ``seen``: only rows whose h1 a (broadcast) filter may hold."""

    def task(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begins, held = {}, [[] for _ in range(6)]
            if unit == "passage":
                last = (-1, -1)
                for words in read_words(texts, size - 1):
                    row, number, start, end = words[:4]
                    fresh_words = (row != last[0]) | (number > last[1])  # pieces of a text overlap
                    if len(row):
                        last = (int(row[-1]), int(number[-1]))
                    of, cut = np.unique(row[fresh_words], return_index=True)
                    for i, part in zip(of.tolist(), np.split(start[fresh_words].astype(np.int32), cut[1:]), strict=True) if len(of) else ():
                        begins.setdefault(i, []).append(part)
                    for lo, hi, seed, content in _windows(words, size):
                        if seen:
                            lo, hi, seed, content = (x[may] for may in [_may_hold(seen.value, seed)] for x in (lo, hi, seed, content))
                        yield _rows(batch, row[lo], number[lo], number[hi - 1] + 1, start[lo], end[hi - 1], np.zeros(len(lo), bool),
                                    seed.view(np.int64), content.view(np.int64))

            def of_units():
                owner, lo, hi, start, end, keys = held
                h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                columns = [np.array(x, np.int64) for x in (owner, lo, hi, start, end)] + [np.ones(len(owner), bool), h[:, 0].copy(), h[:, 1].copy()]
                may = _may_hold(seen.value, columns[6]) if seen else slice(None)
                return _rows(batch, *[x[may] for x in columns])

            for i, text in enumerate(texts):
                cut = list(cut_units(text, unit)) if text else []
                if not cut:
                    continue
                start, end, n, keys = zip(*cut, strict=True)
                if unit == "passage":
                    at = np.concatenate(begins.pop(i))
                    lo, hi = np.searchsorted(at, start).tolist(), np.searchsorted(at, end).tolist()
                else:
                    hi = np.cumsum(n).tolist()
                    lo = [0, *hi[:-1]]
                for column, x in zip(held, ([i] * len(cut), lo, hi, start, end, keys), strict=True):
                    column.extend(x)
                if len(held[0]) > 50_000:  # bounded output batches
                    yield of_units()
                    held = [[] for _ in range(6)]
            yield of_units()

    return _keyed(docs).mapInArrow(task, UNITS)


def windows_of(docs: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """Every window inside ``ranges`` (doc_id, t, lo, hi) as rows of ``UNITS``; only texts that hold one are read out."""
    wanted = ranges.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "ranges").hint("merge")  # grows with the data: never broadcast
    few = _keyed(docs).alias("k").join(wanted, F.col("k.doc_id").eqNullSafe(F.col("d")) & (F.col("k.t") == F.col("dt"))).select("doc_id", "t", "text", "ranges")

    def task(batches):
        for batch in batches:
            ranges = batch.column("ranges")
            edges = ranges.flatten()
            lo, hi = edges.field("lo").to_numpy(), edges.field("hi").to_numpy()
            cut = np.append(0, np.cumsum(ranges.value_lengths().to_numpy(zero_copy_only=False)))
            for words in read_words(batch.column("text").to_pylist(), size - 1):
                row, number, start, end = words[:4]
                n = len(row) - size + 1
                if n <= 0:
                    continue
                keep = np.zeros(n + 1, np.int32)
                for i in np.unique(row).tolist():
                    a, b = np.searchsorted(row, [i, i + 1])
                    first = number[a]
                    # windows lo .. hi - size of each range, as far as these words go
                    x = np.clip(lo[cut[i]:cut[i + 1]] - first, 0, max(0, b - a - size + 1)) + a
                    y = np.clip(hi[cut[i]:cut[i + 1]] - size + 1 - first, 0, max(0, b - a - size + 1)) + a
                    if b - a >= size:
                        np.add.at(keep, x, 1)
                        np.add.at(keep, y, -1)
                w = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
                one, two = _Sums(words[4], 0).of(w, w + size), _Sums(words[5], 1).of(w, w + size)
                for a in range(0, len(w), PIECE):
                    v = w[a:a + PIECE]
                    yield _rows(batch, row[v], number[v], number[v] + size, start[v], end[v + size - 1], np.zeros(len(v), bool),
                                one[a:a + PIECE].view(np.int64), two[a:a + PIECE].view(np.int64))

    return few.mapInArrow(task, UNITS)


def _probes(keys, bits: int):
    """Two places of each key in a filter of ``bits`` bits (a power of two)."""
    k = np.asarray(keys).view(np.uint64)
    return [(_mix(k ^ np.uint64(salt)) & np.uint64(bits - 1)).astype(np.int64) for salt in (0, 0x5851F42D4C957F2D)]


def _may_hold(seen: np.ndarray, keys) -> np.ndarray:
    a, b = _probes(keys, 8 * len(seen))
    return ((seen[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (seen[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter (bits, packed) of a written table's column ``h1``, sized from its count up to ``FILTER_BITS``.

    It is put together in Spark in blocks; the driver joins the blocks.  It only saves shuffling rows that occur
    once: what passes is counted exactly, so beyond its largest size more rows are shuffled and results are the same.
    """
    bits = min(FILTER_BITS, max(FILTER_BLOCK, 1 << (8 * keys.count()).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_probes(batch.column("h1").to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_BLOCK), pa.array((at % FILTER_BLOCK).astype(np.int32))], names=["block", "at"])

    def fill(pdf):
        import pandas as pd
        block = np.zeros(FILTER_BLOCK, bool)
        block[pdf["at"].to_numpy()] = True
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bits": [np.packbits(block).tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(places, "block long, at int").groupBy("block").applyInPandas(fill, "block long, bits binary").toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)  # at most FILTER_BITS / FILTER_BLOCK rows of 64 KB
        out[r.block * len(part):(r.block + 1) * len(part)] = part
    return out


def _own(first: str, size: int) -> Column:
    """The occurrence is the kept one itself, or overlaps it."""
    stop = F.when(F.col("whole"), F.col(f"{first}.hi")).otherwise(F.col(f"{first}.lo") + size)
    return F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")) & (F.col("t") == F.col(f"{first}.t")) & (F.col("lo") < stop)


def _with_first(rows: DataFrame, keys: list[str], name: str, scratch: Scratch, *more: str, at_least: int = 2) -> DataFrame:
    """Rows of a written table whose keys occur ``at_least`` times, with their first occurrence as struct ``name``.

    Frequent keys (fewer than ``HOT_SHARE``, whatever the data) meet their rows by broadcast, so no task gets all rows
    of one; the others by a merge join, as both of its sides grow with the data."""
    least = F.min(F.struct("doc_id", "t", "lo", "hi", *more)).alias(name)
    groups = scratch.table(rows.groupBy(*keys).agg(least, F.count("*").alias("n")).where(F.col("n") >= at_least))
    limit = rows.count() // HOT_SHARE
    hot = F.broadcast(groups.where(F.col("n") > limit).drop("n"))
    few = groups.where(F.col("n") <= limit).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(few.hint("merge"), keys))


def repeats(docs: DataFrame, unit: str, size: int, scratch: Scratch) -> DataFrame:
    """(doc_id, t, lo, hi, start, end, whole, kept): every unit, chunk and window that has an earlier occurrence."""
    spark = docs.sparkSession
    keys = scratch.table(units(docs, unit, size).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    rows = scratch.table(units(docs, unit, size, spark.sparkContext.broadcast(key_filter(keys))))
    equal, own = F.col("h2") == F.col("first.h2"), _own("first", size)
    state = F.when(equal & ~own, 0).when(equal & (F.col("lo") == F.col("first.lo")), 1).otherwise(2)  # a repeat, the kept one, open
    open_only = [F.when(F.col("state") == 2, F.col(c)).alias(c) for c in ("h1", "h2", "first")]
    out = ["doc_id", "t", "lo", "hi", "start", "end", "whole"]
    marked = _with_first(rows, ["h1"], "first", scratch, "h2").withColumn("state", state).where("state <> 1")
    marked = scratch.table(marked.select(*out, "state", F.when(F.col("state") == 0, F.col("first.doc_id")).alias("kept"), *open_only))
    decided = marked.where("state = 0").select(*out, "kept")
    undecided = marked.where("state = 2").drop("state", "kept")
    differ = undecided.where(~equal)
    differ = scratch.table(_with_first(differ, ["h1", "h2"], "second", scratch, at_least=1).withColumn("own", _own("second", size)))
    decided = decided.unionByName(differ.where("not own").select(*out, F.col("second.doc_id").alias("kept")))
    if unit != "passage":
        return decided
    at, chunks = ["doc_id", "t", "lo", "hi"], undecided.where("not whole")
    ranges = differ.where("own and not whole").select(at).unionByName(chunks.where(equal).select(at)).unionByName(
        chunks.select([F.col(f"first.{c}").alias(c) for c in at]))
    w = scratch.table(windows_of(docs, ranges.distinct(), size))
    again = _with_first(w, ["h1", "h2"], "first", scratch).where(~own)
    return decided.unionByName(again.select(*out, F.col("first.doc_id").alias("kept")))


def repeated_spans(docs: DataFrame, unit: str = "passage", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, t, start, end, n_units, n_words, kept_doc_ids): the spans to remove, with the documents that hold the
    first occurrence of their units, chunks and windows; ``n_units`` counts whole units."""
    again = repeats(docs, unit, min_words, Scratch(docs.sparkSession, "passages"))
    by = Window.partitionBy("doc_id", "t").orderBy("lo", "hi", "whole")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    same = F.coalesce(F.lag(F.struct("lo", "hi", "whole")).over(by) == F.struct("lo", "hi", "whole"), F.lit(False))  # repeated rows
    runs = again.select(
        "*", F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True)).cast("int").alias("new"),
        (F.col("whole") & ~same).cast("int").alias("counted"))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return (runs.groupBy("doc_id", "t", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("counted").alias("n_units"),
                 (F.max("hi") - F.min("lo")).cast("long").alias("n_words"), F.array_sort(F.collect_set("kept")).alias("kept_doc_ids"))
            .where(F.col("n_words") >= min_words).drop("run"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with text rewritten without its spans and ``removed`` (the spans, by original offsets)."""
    by = spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    base = docs.drop("removed")
    doc, t = fresh(base, "doc", "t")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (text_hash() == F.col(t))
    both = base.join(by.withColumnsRenamed({"doc_id": doc, "t": t}), same, "left").drop(doc, t)
    # keep the gaps between spans: fold (text so far, position)
    gaps = F.expr("""aggregate(coalesce(removed, array()), struct('' as kept, 0 as at),
        (s, r) -> struct(concat(s.kept, substring(text, s.at + 1, r.start - s.at)) as kept, r.end as at),
        s -> concat(s.kept, substring(text, s.at + 1)))""")
    return both.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(gaps))
