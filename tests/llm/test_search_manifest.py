"""SimHash fingerprints (11), ranked search (12) and Merkle manifest (13) against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from marketlens.llm import merkle, queries, ranked_search, simhash
from tests.conftest import SF001
from tests.llm.conftest import odd_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_last(doc_id, sign=1):
    return doc_id is None, sign * (doc_id or 0)


# ---------------------------------------------------------------- fingerprints
def brute_fingerprint(text):
    """Votes one term at a time, in Python integers."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    h, _ = simhash.tk.words(*simhash.tk.utf8(simhash.pa.array([" ".join(ws)])), 0, 1, simhash.tk.WORDS_BLANK)
    _, terms = simhash._terms(h, np.array([len(h)]))
    total = [0] * simhash.BITS
    for term, tf in Counter(terms.tolist()).items():
        words = [int(simhash.tk.mix(np.array([term], np.uint64) + s)[0]) for s in simhash.tk.mix(np.arange(1, simhash.BITS // 64 + 1, dtype=np.uint64))]
        bits = np.unpackbits(np.array(words, np.uint64).view(np.uint8)).tolist()
        for i, b in enumerate(bits):
            total[i] += round(16 + 16 * math.log2(tf)) * (1 if b else -1)
    return np.packbits(np.array(total) > 0).tobytes().hex()


def hamming(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def brute_neighbours(rows):
    """Expected rows for (doc_id, text) with distinct ids."""
    line = sorted(rows, key=lambda r: null_last(r[0], -1))
    out = []
    for i, (doc_id, text) in enumerate(line):
        text, nxt = text or "", line[(i + 1) % len(line)][1] or ""
        k = len(text) // 3
        new = text[:len(text) - k] + nxt[:k]
        a, b, c = brute_fingerprint(text), brute_fingerprint(new), brute_fingerprint(nxt)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, 1 - hamming(a, b) / 128, 1 - hamming(a, c) / 128))
    return sorted(out, key=lambda r: null_last(r[0]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: null_last(r[0]))


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_equal_votes_one_by_one(spark, make_docs, parts):
    rows = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "Éa b É x 😀 zz " * 9), (5, "a b c d e f g a b c d e"), (6, "A b C d e f g a b c d e"),
            (7, "one two three four"), (9, "tail of THE text " * 300), (12, "x" * 500_000)]
    df = simhash.neighbour_fingerprints(spark, make_docs(rows, clash=True).repartition(parts))
    assert got(df) == brute_neighbours(rows)


def test_fingerprints_of_few_rows(spark, make_docs):
    assert simhash.neighbour_fingerprints(spark, make_docs([])).collect() == []
    (one,) = simhash.neighbour_fingerprints(spark, make_docs([(5, "only one text of nine letters")])).collect()
    assert one.near_next == 1.0 and one.n_chars == 29 and one.edited_sha256 == hashlib.sha256(b"only one text of ninonly one ").hexdigest()
    same = simhash.neighbour_fingerprints(spark, make_docs([(5, "text a"), (5, "text b"), (5, "text b")])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 2


def test_long_text_in_slices_keeps_its_fingerprint(spark, make_docs):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 8) for _ in range(200_000))
    (r,) = simhash.neighbour_fingerprints(spark, make_docs([(1, text)])).collect()
    assert r.fingerprint == brute_fingerprint(text)


def flipped(rng, fp, bits):
    x = int(fp, 16)
    for i in rng.sample(range(128), bits):
        x ^= 1 << i
    return f"{x:032x}"


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_radius_finds_every_fingerprint(spark, radius):
    rng = random.Random(radius)
    base = [f"{rng.getrandbits(128):032x}" for _ in range(12)]
    rows = [(i, f) for i, f in enumerate(base)]
    rows += [(100 + i, flipped(rng, rng.choice(base), rng.randint(0, 9))) for i in range(400)] + [(1000 + i, base[0]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    found = {(r.q, r.fingerprint): (r.members, r.distance) for r in simhash.within_radius(df, df.where("doc_id < 12"), radius).collect()}
    count = Counter(f for _, f in rows)
    assert found == {(q, f): (n, hamming(q, f)) for q in base for f, n in count.items() if hamming(q, f) <= radius}
    near = {r.doc_id: r.n_near for r in simhash.near_counts(df, df.doc_id < 12, radius).collect()}
    assert len(near) == len(rows) and near[100] is None
    assert all(near[i] == sum(hamming(f, b) <= radius for b in (x for _, x in rows)) - 1 for i, f in enumerate(base))


def test_edited_texts_are_nearer_than_strangers(spark):
    rows = queries.op11_fingerprints(spark, SF001).collect()
    docs = dict(zip(*pq.read_table(f"{SF001}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert [tuple(r)[:-1] for r in sorted(rows, key=lambda r: r.doc_id)] == brute_neighbours(list(docs.items()))
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98


# --------------------------------------------------------------------- search
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=20):
    tfs = [Counter(TERM.findall((t or "").translate(FOLD))) for _, t in docs]
    n = sum(1 for c in tfs if c)
    total = sum(sum(c.values()) for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        ask = Counter(TERM.findall((text or "").translate(FOLD)))
        scored = []
        for (doc_id, _), c in zip(docs, tfs, strict=True):
            if c:
                m = 75 + 25 * sum(c.values()) * n // total
                s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in ask.items() if t in c)
                if s > 0:
                    scored.append((-s, null_last(doc_id), doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **kw):
    index = docs.sparkSession.createDataFrame(ranked_search.build_index(docs).toArrow())
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked_search.search(spark, index, asked, **kw).collect()), key=str)


def zipf_docs(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i * 3 % n, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard,window", [(1_500_000, (256, 8192)), (700, (4, 16)), (5000, (1, 1))])
def test_search_equals_scores_of_all_documents(spark, make_docs, monkeypatch, shard, window):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    monkeypatch.setattr(ranked_search, "BLOCK", 8)
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 20)
    monkeypatch.setattr(ranked_search.tk, "SLICE_BYTES", 2000)
    docs = zipf_docs(shard)
    docs += [(5000 + i, docs[7][1]) for i in range(40)]  # ties
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(300)], k=rng.randint(1, 12)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "never"), (93, "w0"), (94, "w299 W299 w0"), (93, "w1")]
    assert searched(spark, make_docs(docs).repartition(3), items) == brute_search(docs, items)


def test_search_on_odd_rows(spark, make_docs):
    rows = odd_rows() + [(20, "É é É"), (None, "SHORT text"), (21, "short"), (21, "short short")]
    items = [(1, "Word1 and short"), (2, "é"), (3, "É"), (4, "text"), (5, "x" * 3_000_000)]
    assert searched(spark, make_docs(rows, clash=True), items, k=5) == brute_search(rows, items, 5)
    assert searched(spark, make_docs([]), items) == [] and searched(spark, make_docs([(1, None)]), items) == []
    assert searched(spark, make_docs(rows), []) == []


def test_blocks_hold_wide_numbers(spark, make_docs):
    docs = [(i, "rare " * (70_000 if i == 5 else 300 if i == 7 else 1) + ("often" if i % 3 else "seldom")) for i in range(70)]
    items = [(1, "rare often"), (2, "seldom")]
    assert searched(spark, make_docs(docs).coalesce(1), items) == brute_search(docs, items)


def test_non_essential_blocks_stay_compressed(spark, make_docs):
    """A frequent term's blocks that cannot matter are never decompressed."""
    docs = [(i, "often " + ("rare rare rare" if i < 30 else " ".join(["pad"] * 50))) for i in range(4000)]
    index = ranked_search.build_index(make_docs(docs).coalesce(1)).toArrow()
    rows = index.append_column("w", simhash.pa.array([10] * len(index))).append_column(
        "asked", simhash.pa.array([[{"q": 1, "times": 1}]] * len(index)))
    often, rare, _ = (int(ranked_search._postings(*simhash.tk.words(*simhash.tk.utf8(simhash.pa.array([t])), 0, 1, simhash.tk.WORDS_ALNUM))[1].view(np.int64)[0])
                      for t in ("often", "rare", "pad"))
    mask = simhash.pa.array([t is None or t in (often, rare) for t in rows.column("term").to_pylist()])
    lists = ranked_search._Lists(rows.filter(mask), 4000, 200_000)
    lists.weight = lists.weight * np.array([1 if lists.n[s:e].sum() > 1000 else 500 for s, e in zip(lists.start, lists.end, strict=True)])
    doc, _ = ranked_search.max_score(lists, lists.queries[1], 20)
    assert doc.tolist() == list(range(20)) and len(lists._open) < 8 < len(lists.n)


# -------------------------------------------------------------------- manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fanout=8):
    """rows: (doc_id, text, lang, source, n_chars); (doc_id, leaf, subroot, root, proof, folded, verified)."""
    def leaf(r, text):
        vals = [r[0], r[3], r[2], r[4], text]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha(*last[i:i + fanout]) for i in range(0, len(last), fanout)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % fanout
            yield level[a:i], level[i + 1:a + fanout]
            i //= fanout
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(tree([d for _, d in groups[g]]))
    top = tree([t[-1][0] for t in trees]) if trees else [[None]]
    root, out = top[-1][0], []
    for gi, g in enumerate(names):
        for i, (r, d) in enumerate(groups[g]):
            steps = [*path(trees[gi], i), *path(top, gi)]
            acc = leaf(r, r[1].translate(FOLD) if r[1] is not None else None) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else d
            for lo, hi in steps:
                acc = sha(*lo, acc, *hi)
            out.append((r[0], d, trees[gi][-1][0], root, sha(*[x for lo, hi in steps for x in (*lo, *hi)]), acc, acc == root))
    return sorted(out, key=str)


def manifest(spark, df, **kw):
    from pyspark.sql import functions as F
    found = merkle.merkle_manifest(spark, df, claim=merkle.changed_copy, **kw)
    found = found.withColumn("folded", merkle.fold(F.col("claimed"), F.col("path")))
    h = [merkle.hex_text(F.col(c)) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(merkle.hex_text(merkle.proof_bytes(F.col("path"))), 256)
    out = found.select("doc_id", *h, proof, merkle.hex_text(F.col("folded")), F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("fanout", [8, 2, 3])
def test_manifest_of_groups_of_all_sizes(spark, make_docs, fanout):
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "é": 73, None: 7, "": 3, "zz": 130}
    rows = [(i * 7 % 131 + 1000 * g, f"Text {i} Of {lang}", lang, "S" if i % 2 else None) for g, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    df = make_docs(rows, clash=True).repartition(5)
    assert manifest(spark, df, fanout=fanout) == brute_manifest([(*r, len(r[1])) for r in rows], fanout)


def test_manifest_on_odd_rows(spark, make_docs):
    rows = [(*r, "en", "s") for r in odd_rows()]
    full = [(*r, len(r[1] or "")) for r in rows]
    assert manifest(spark, make_docs(rows)) == brute_manifest(full)
    assert manifest(spark, make_docs([])) == []
    assert manifest(spark, make_docs(rows[:1])) == brute_manifest(full[:1])


def test_a_changed_field_breaks_only_its_own_proof(spark, make_docs):
    from pyspark.sql import functions as F
    rows = [(i, f"lower case text {i}", "en" if i % 3 else "de") for i in range(100)]

    def claim(fields):
        doc_id, source, lang, n_chars, text = fields
        return F.when(doc_id == 41, merkle.leaf_hash([doc_id, source, lang, n_chars + 1, text]))
    found = merkle.merkle_manifest(spark, make_docs(rows), claim=claim)
    bad = found.where(merkle.fold(F.col("claimed"), F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in bad] == [41]


def test_manifest_query_on_given_tables(spark):
    t = pq.read_table(f"{SF001}/documents.parquet").to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in t]
    assert sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, SF001).collect()), key=str) == brute_manifest(rows)


def test_search_query_on_given_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF001}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF001}/benchmark.parquet").to_pylist()]
    assert sorted((tuple(r) for r in queries.op12_ranked_search(spark, SF001).collect()), key=str) == brute_search(docs, items)
