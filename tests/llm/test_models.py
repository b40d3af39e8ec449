"""Operators 3, 4, 5 (held-out accuracy) and 9 (brute force)."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import quality, toxicity
from marketlens.llm.common import held_out
from marketlens.llm.decontaminate import decontaminate, items_digest, sha256_of
from marketlens.llm.language_id import count_grams, identify
from tests.conftest import SF01
from tests.llm.conftest import odd_rows


def read(spark, table):
    return spark.read.parquet(f"{SF01}/{table}.parquet")


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    ties = {v: np.mean(order[s == v]) for v in np.unique(s)}
    rank = np.array([ties[v] for v in s])
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_quality_on_held_out_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    assert quality.score_quality(docs, labels).count() == docs.count()
    out = got[got.held_out]
    assert auc(out.quality.to_numpy(), out.score.to_numpy()) > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = toxicity.score_toxicity(spark, docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert ((out.predicted == out.toxic).mean() > 0.9) and got.score.between(0, 1).all()
    assert got[got.predicted == 1].toxic.mean() > 0.8


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    m = len(toxicity.VOTERS)
    y = rng.random(20000) < 0.1
    votes = np.zeros((len(y), m), int)
    for j in range(toxicity.LEXICON_VOTERS):
        votes[:, j] = np.where(y, rng.random(len(y)) < 0.5 + 0.05 * j, rng.random(len(y)) < 0.01)
    noise = rng.random(len(y)) < 0.3
    votes[:, -1], votes[:, -2] = noise, noise ^ (rng.random(len(y)) < 0.02)  # two correlated voters without information
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(pattern, counts.astype(float))
    post = model.posterior(votes)
    assert auc(y.astype(int), post) > 0.98
    assert model.parent[-1] == m - 2 or model.parent[-2] == m - 1
    assert abs(model.prior[1] - 0.1) < 0.03


def test_models_without_labels_and_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (4, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    docs = make_docs(odd_rows(), clash=True)
    for lab in (labels, some):
        for got in (quality.score_quality(docs, lab), toxicity.score_toxicity(spark, docs, lab)):
            rows = got.collect()
            assert len(rows) == len(odd_rows())
            assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.score_quality(make_docs([]), some).count() == 0
    assert toxicity.score_toxicity(spark, make_docs([]), some).count() == 0


def test_fold_rule(spark):
    import zlib
    rows = spark.range(200).select("id", held_out(F.col("id"), 5, 0).alias("a"), held_out(F.col("id"), 3, 1).alias("b")).collect()
    assert all(r.a == (zlib.crc32(str(r.id).encode()) % 5 == 0) and r.b == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_language_on_held_out_rows(spark):
    got = identify(spark, read(spark, "documents")).toPandas()
    out = got[got.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_odd_rows(spark, make_docs):
    rows = odd_rows() + [(20, "123 !!! — …"), (21, None, None), (22, "ΑΒΓ δ"), (23, "word", None)]
    got = {r.doc_id: r for r in identify(spark, make_docs(rows, clash=True)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1, 2, 3, 20, 21))
    assert all(got[i].lang_pred == "en" for i in (4, 5, 6, 8, 9, 10, 22, 23))
    assert got[4].src == "x"
    assert identify(spark, make_docs([])).count() == 0
    assert {r.lang_pred for r in identify(spark, make_docs([(1, "text", None)])).collect()} == {"und"}


def test_unlearnt_languages_and_noise_are_rejected(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    noise = spark.range(200).selectExpr("id + 10000000 as doc_id", "cast(null as string) as text", "cast(null as string) as lang")
    rng = random.Random(4)
    noise = spark.createDataFrame([(r.doc_id, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)), None) for r in noise.collect()], docs.schema)
    for left_out in ("fr", "de"):
        unlabelled = docs.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
        got = identify(spark, unlabelled.unionByName(noise.withColumn("was", F.lit("noise")))).toPandas()
        assert got[got.was == left_out].rejected.mean() > 0.8
        assert got[got.was == "noise"].rejected.mean() > 0.9
        assert got[~got.was.isin([left_out, "noise"])].rejected.mean() < 0.02


def made_up(seed, letters, n, words=60):
    """Texts of a made-up language: 80 own words, some much more frequent."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)]
    return [" ".join(vocab[int(80 * rng.random() ** 2)] for _ in range(words)) for _ in range(n)]


def test_language_in_two_scripts(spark, make_docs):
    latin, cyrillic, other = made_up(1, "abcdeklmnorst", 360), made_up(2, "абвгдежзиклмно", 40), made_up(3, "eiouvwxyzhgfq", 400)
    texts = [(t, "sr") for t in latin + cyrillic] + [(t, "xx") for t in other] + [(t, "sr") for t in made_up(3, "eiouvwxyzhgfq", 430)[400:]]  # the last: mislabelled
    got = {r.doc_id: r for r in identify(spark, make_docs([(i, *x) for i, x in enumerate(texts)])).collect()}
    assert all(got[i].lang_pred == "sr" for i in range(400))
    assert sum(not got[i].rejected for i in range(360, 400)) >= 38
    assert all(got[i].lang_pred == "xx" for i in range(400, len(texts)))


def test_grams_do_not_depend_on_the_batch():
    texts = [f"some text number {i} é".encode() * (i % 9) for i in range(600)]
    together = np.concatenate([c for _, c in count_grams(texts)])
    for i in (0, 5, 299, 599):
        assert (next(count_grams([texts[i]]))[1][0] == together[i]).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def hits_brute(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + k]), set()).add(i)
    out = []
    for d, t in docs:
        w = words_of(t)
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                found = windows.get(tuple(w[j:j + k]))
                if found:
                    hit.update(range(j, j + k))
                    ids |= found - {None}
        out.append((d, len(w), len(hit), len(ids), sha256_of(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [4_000_000, 30])  # 30: many blocks of the query set
def test_decontaminate(spark, make_docs, block_words):
    rng = random.Random(2)
    item = [" ".join(rng.choice(["a", "b", "c", "ñ", "d9"]) for _ in range(n)) for n in (1, 5, 13, 20, 40)]
    items = list(enumerate(item[1:])) + [(7, item[2]), (None, item[3]), (8, None), (9, "!!"), (0, item[1])]
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "x"]) for _ in range(60)) + "; " + rng.choice(item[1:]).title() + ". tail") for i in range(30)]
    docs += [(i and i + 100, t) for i, t in odd_rows()] + [docs[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(docs, clash=True)
    got = decontaminate(spark, df, bench, block_words=block_words)
    rows = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), items_digest(F.col("items")).alias("d"), "contaminated", "matches").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.d, r.contaminated) for r in rows), key=str) == hits_brute(docs, items)
    for r in rows[:30]:  # every match is verbatim where it says
        w = words_of(dict(docs)[r.doc_id])
        for m in r.matches:
            assert any(w[m.doc_word:m.doc_word + m.n_words] == words_of(t)[m.item_word:m.item_word + m.n_words] for i, t in items if i == m.item_id)
    assert decontaminate(spark, make_docs([]), bench).count() == 0
    assert not decontaminate(spark, df, bench.limit(0)).where("contaminated").count()
