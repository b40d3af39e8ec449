"""Operators 6, 7, 8 and 10."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import embeddings, minhash, substring_dedup
from marketlens.llm.common import Scratch, connected_components
from marketlens.llm.cuckoo import Cuckoo
from marketlens.llm.line_dedup import LineIndex, dedup_lines, line_key
from marketlens.llm.substring_dedup import cut_units, remove, repeated_spans
from tests.conftest import SF001
from tests.llm.conftest import odd_rows


def lines_brute(rows, min_docs=5):
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").encode().split(b"\n"):
            k = line_key(line)
            if len(k.decode()) >= 40:
                holders.setdefault(k, set()).add(i)
    hot = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v - {None}) >= min_docs}
    out = []
    for i, t, *_ in rows:
        ls = (t or "").encode().split(b"\n")
        kept = [x for x in ls if hot.get(line_key(x), i) == i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    pool = [f"  Line number {i} of the pool, long enough to count as one " + "é" * 3 for i in range(12)] + ["short", "é" * 40, "é" * 39]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    return rows + odd_rows() + [(3, rows[3][1]), (None, pool[0])]


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("filter_bytes", [64 << 20, 0])  # 0: beyond the filters' size bound
def test_line_dedup(spark, make_docs, filter_bytes):
    rows = line_rows()
    got = dedup_lines(spark, make_docs(rows, clash=True), filter_bytes=filter_bytes)
    assert result(got) == lines_brute(rows)
    assert "key" in got.columns
    assert dedup_lines(spark, make_docs([])).count() == 0


def test_line_dedup_is_incremental_and_reversible(spark, make_docs):
    rows = [r for r in line_rows() if r[0] is not None]
    first, second = rows[:25], rows[25:]
    index = LineIndex(spark, Scratch(spark, "t")).insert(make_docs(first)).insert(make_docs(second))
    assert result(index.decide(make_docs(rows))) == lines_brute(rows)
    gone = sorted({r[0] for r in second} - {r[0] for r in first})
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert result(index.decide(make_docs(left))) == lines_brute(left)
    clean = LineIndex(spark, Scratch(spark, "t")).insert(make_docs(left))
    for name in ("postings", "refs"):
        a, b = getattr(index, name), getattr(clean, name)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    f = Cuckoo.from_bytes(Cuckoo.of(h[:, 0], h[:, 1]).to_bytes())
    assert f.contains(h[:, 0], h[:, 1]).all()
    f.remove(h[:2500, 0], h[:2500, 1])
    assert f.contains(h[2500:, 0], h[2500:, 1]).all()
    assert f.contains(h[:2500, 0], h[:2500, 1]).mean() < 0.01


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10**9), " ".join(w).title() if rng.random() < 0.5 else "  ".join(w)))
    return rows


@pytest.mark.parametrize("block", [4096, 3])  # 3: groups dealt into many tiles
def test_near_duplicates(spark, make_docs, block):
    rows = near_rows() + odd_rows()
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, 4))
    ids = [i for i in sets if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = components(ids, linked)
    got = minhash.near_duplicates(spark, make_docs(rows, clash=True), block=block).collect()
    want = sorted(((i, len(shingles(t, 4)), comp.get(i), i is None or comp[i] == i) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want
    assert minhash.near_duplicates(spark, make_docs([])).count() == 0


def test_group_bound_loses_no_link():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(len(s), rng.integers(0, 40), replace=False)] = rng.integers(0, 2**63, 1).astype(np.uint64)[0]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])))
    ids = np.arange(60)
    linked = [(i, j) for i in range(60) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - n)]
    got = minhash.link_group(ids, np.zeros(60, int), sets, False, 80)
    assert components(ids.tolist(), got) == components(ids.tolist(), linked)


def test_connected_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = connected_components(spark, spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()
    nodes = {n for e in links if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in got} == components(nodes, [e for e in links if e[0] != e[1]])
    assert connected_components(spark, spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def vector_rows():
    rng = np.random.default_rng(4)
    rows = []
    for base in range(8):
        x = rng.standard_normal(64)
        for _ in range(20):
            rows.append((len(rows), (x + rng.standard_normal(64) * rng.choice([0.0, 0.05, 0.2, 0.35])).astype(np.float32).tolist()))
    n = len(rows)
    rows += [(n + i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [1.0, None] + [1.0] * 62), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64),
             (1005, [2.0]), (1006, [3.0]), (1007, [-1.0]), (1008, []), (None, rows[0][1]), rows[0], (1009, [1e-30] * 64), (1010, [1e30] * 64)]
    return rows


@pytest.mark.parametrize("tile", [2048, 4])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vector_rows()
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    unit = {i: (x := ok[i] / np.abs(ok[i]).max()) / np.linalg.norm(x) for i in ids}
    linked = [(a, b) for a in ids for b in ids if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    comp = components(ids, linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("keys", F.lit("y"))
    got = embeddings.near_vectors(spark, df).collect()
    assert len(got) == len(rows)
    links = {i: sum(i in e for e in linked) for i in ids}
    found = sum(r.n_links for r in got if r.vec_id != 0)
    assert all(r.n_links <= links.get(r.vec_id, 0) for r in got)
    assert found >= 0.99 * sum(n for i, n in links.items() if i)
    if found == sum(n for i, n in links.items() if i):
        assert {(r.vec_id, r.component_id, r.kept) for r in got} == {(i, comp.get(i, i), i is None or comp.get(i, i) == i) for i, _ in rows}
    assert embeddings.near_vectors(spark, df.limit(0)).count() == 0


def spans_brute(rows, unit, min_words):
    cut = [(i, k, *u) for i, t in rows for k, u in enumerate(cut_units(t or "", unit))]
    first = {}
    for i, k, *_, d in cut:
        key = (i is not None, i or 0, k)
        first[d] = min(first.get(d, key), key)
    out, docs = set(), {}
    for i, k, a, b, w, d in cut:
        if first[d] != (i is not None, i or 0, k):
            docs.setdefault(i, {})[k] = (a, b, w)
    for i, units in docs.items():
        run = []
        for k in [*sorted(units), None]:
            if run and (k is None or k != run[-1] + 1):
                words = sum(units[x][2] for x in run)
                if words >= min_words:
                    out.add((i, units[run[0]][0], units[run[-1]][1], len(run), words))
                run = []
            run.append(k)
    return out


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_repeated_spans(spark, make_docs, unit):
    rng = random.Random(9)
    passage = " ".join(f"Passage{i % 7} word{i}." if i % 9 == 8 else f"word{i}" for i in range(70))
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(30)) + ".\n" + (passage if i % 3 == 0 else "Own text. ")
             + "\n\n" + ("All rights reserved." if i % 2 else "x")) for i in range(20)]
    odd = [(i and i + 100, t) for i, t in odd_rows()]
    rows += odd
    spans = repeated_spans(make_docs(rows, clash=True), unit)
    got = {(r.doc_id, r.start, r.end, r.n_units, r.n_words) for r in spans.collect()}
    assert got == spans_brute(list(dict.fromkeys(rows)), unit, 40)
    caught = {r[0] for r in got}
    assert not {1, 2, 11, 13, 14} & caught
    text = {r.doc_id: r.text for r in remove(make_docs(rows, clash=True), spans).collect()}
    for i, t in rows:
        if i is not None and i not in caught:
            assert text[i] == t
    if unit != "paragraph":  # there the passage is one unit with the lines before it
        assert {3, 6, 9, 12, 15, 18} <= caught
        assert "word30" not in text[15]
    assert repeated_spans(make_docs([]), unit).count() == 0


def uncovered_windows(rows, spans, size):
    """Windows of ``size`` words (characters of Han) that have an earlier occurrence and a word outside the spans."""
    seen, missed = {}, []
    gone = {}
    for r in spans:
        gone.setdefault(r.doc_id, []).append((r.start, r.end))
    for i, t in sorted(rows):
        at = [m.span() for m in re.finditer(r"[一-鿿]|[^\s一-鿿]+", t or "")]
        words = [t[a:b].lower() for a, b in at]
        for k in range(len(words) - size + 1):
            d, q = seen.setdefault(tuple(words[k:k + size]), (i, k))
            if (d, q) != (i, k) and (d != i or k >= q + size) and not any(a <= at[k][0] and at[k + size - 1][1] <= b for a, b in gone.get(i, [])):
                missed.append((i, k))
    return missed


def test_rows_of_one_id_are_cut_by_their_own_spans_only(spark, make_docs):
    rng = random.Random(3)

    def own(n):
        return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage = own(60)
    for same_id in (None, 3):
        rows = [(same_id, passage + " " + own(150)), (same_id, own(100) + " " + passage), (9, own(10) + " " + passage)]
        docs = make_docs(rows, clash=True)
        left = [r.text for r in remove(docs, repeated_spans(docs)).collect()]
        assert sorted(len(t.split()) for t in left) in ([10, 100, 210], [10, 150, 160])  # one copy of the passage stays, and every other word
        assert sum(passage in t for t in left) == 1


def test_every_removed_word_has_an_earlier_copy(spark):
    """Each word of a span lies in a window of 40 words, or a unit, that occurs at an earlier place."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    spans = repeated_spans(docs).collect()
    first, pieces = {}, {}
    for i, t in rows:
        at = [m.span() for m in substring_dedup.WORD.finditer(t)]
        words = [t[a:b].lower() for a, b in at]
        cut = [(a, b, d) for a, b, _, d in cut_units(t, "passage")]
        cut += [(at[k][0], at[k + 39][1], tuple(words[k:k + 40])) for k in range(len(words) - 39)]
        for a, b, d in sorted(cut, key=lambda x: x[:2]):
            first.setdefault(d, (i, a))
        pieces[i] = at, cut
    assert spans
    for r in spans:
        at, cut = pieces[r.doc_id]
        again = [(a, b) for a, b, d in cut if first[d] < (r.doc_id, a) and r.start <= a and b <= r.end]
        assert all(any(a <= x and y <= b for a, b in again) for x, y in at if r.start <= x and y <= r.end)


@pytest.mark.parametrize("limits", [{}, {"PIECE": 7}, {"CHUNK": 64}, {"HOT_SHARE": 1, "FILTER_BITS": 1 << 10, "FILTER_BLOCK": 1 << 10}])
def test_passages_wherever_they_start(spark, make_docs, monkeypatch, limits):
    """Also with chunks cut by pieces, texts read in many parts, and no frequent keys under a filter that passes much."""
    for name, value in limits.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(12)

    def own(n):
        return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    inside, han = own(60), "".join(chr(0x4e00 + rng.randrange(5000)) for _ in range(90))
    two = own(25) + ". " + own(25) + "."
    rows = [(i, own(20) + " " + p + " " + own(15) + ".") for i, p in enumerate([inside, inside.upper(), "Oh no. " + two, "So. " + two, han, han + "。", own(60), own(39)])]
    rows += [(20, own(39) + " " + (part := own(39))), (21, part + " " + own(39)), (22, "again " * 100), (23, own(5) + " " + inside + "\n" + inside)]
    spans = repeated_spans(make_docs(rows, clash=True)).collect()
    assert uncovered_windows(rows, spans, 40) == []
    assert {r.doc_id for r in spans} == {1, 3, 5, 22, 23}
    text = dict(rows)
    assert {r.doc_id: text[r.doc_id][r.start:r.end] for r in spans if r.doc_id in (1, 5, 22)} == {1: inside.upper(), 5: han, 22: " ".join(["again"] * 60)}
    left = {r.doc_id: r.text for r in remove(make_docs(rows), repeated_spans(make_docs(rows))).collect()}
    assert left[0] == text[0] and left[22].split() == ["again"] * 40 and left[20] == text[20] and left[21] == text[21]


def test_no_repeated_window_of_the_tables_is_missed(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert uncovered_windows(rows, repeated_spans(docs).collect(), 50) == []


def test_periodic_texts_and_shared_half_windows(spark, make_docs):
    """Windows that overlap their own earlier copy, and passages that share words but not 40, against brute force."""
    rng = random.Random(21)

    def own(n):
        return " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    beat, stock = own(7), own(24)
    rows = [(i, own(rng.randrange(30)) + " " + stock + " " + own(rng.randrange(30))) for i in range(12)]
    rows += [(20, " ".join([beat] * 30)), (21, own(3) + " " + " ".join([beat] * 20)), (22, " ".join([beat] * 4))]
    edge = (stock + " " + own(80)).split()
    rows += [(30 + i, own(4) + " " + " ".join(edge[3 * i:60 + 5 * i]) + " " + own(9)) for i in range(5)]
    spans = repeated_spans(make_docs(rows)).collect()
    assert uncovered_windows(rows, spans, 40) == []
    assert not {r.doc_id for r in spans} & set(range(12)) | {20} - {r.doc_id for r in spans}
    text, seen = dict(rows), set()
    for i, t in sorted(rows):  # every word that goes lies in a window seen before
        words = t.split()
        at = [m.span() for m in re.finditer(r"\S+", t)]
        covered = set()
        for k in range(len(words) - 39):
            if tuple(words[k:k + 40]) in seen:
                covered |= set(range(k, k + 40))
            seen.add(tuple(words[k:k + 40]))
        gone = {k for k, (a, b) in enumerate(at) if any(r.doc_id == i and r.start <= a and b <= r.end for r in spans)}
        assert gone <= covered, (i, text[i])


def test_words_of_long_texts_are_read_once_and_in_order(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    rng = random.Random(4)
    texts = [" ".join("w" * rng.randrange(1, 20) + str(k) for k in range(n)) for n in (0, 1, 200, 3, 500)] + [None, "", "x" * 130 + " y", "字" * 120]
    for keep in (1, 4, 39):
        got = {}
        for row, number, start, end, _, _ in substring_dedup.read_words(texts, keep):
            for i, k, a, b in zip(row.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True):
                assert got.setdefault((i, k), (a, b)) == (a, b)
        for i in range(5):
            assert [got[i, k] for k in range(len(texts[i].split()))] == [m.span() for m in re.finditer(r"\S+", texts[i])]
        assert [got[7, k] for k in range(4)] == [(0, 50), (50, 100), (100, 130), (131, 132)]
        assert [got[8, k] for k in range(120)] == [(k, k + 1) for k in range(120)]
        assert len(got) == 0 + 1 + 200 + 3 + 500 + 4 + 120
