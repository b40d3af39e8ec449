"""The registered queries against their SQL, and the pipeline against a brute-force version of its stages."""

import math

import duckdb
import pytest

import corpus_pipeline
from marketlens.llm import oracle, queries
from marketlens.llm.common import Scratch
from marketlens.llm.language_id import identify
from marketlens.llm.line_dedup import line_key
from tests.conftest import SF001
from tests.llm.test_dedup import components, shingles
from tests.llm.test_models import hits_brute

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF001)
    cur = con.execute(oracle.SQL[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF001).count() > 0


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = corpus_pipeline.run(spark, SF001)
    assert set(docs.columns) <= set(got.columns)
    # 1: the language model's own verdicts (its accuracy is tested elsewhere)
    stay = {r.doc_id: r.text for r in identify(spark, docs).collect() if r.lang_pred != "und" and not r.rejected}
    # 2: line dedup
    holders = {}
    for i, t in stay.items():
        for x in t.encode().split(b"\n"):
            if len(line_key(x).decode()) >= 40:
                holders.setdefault(line_key(x), set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    stay = {i: b"\n".join(x for x in t.encode().split(b"\n") if hot.get(line_key(x), i) == i).decode() for i, t in stay.items()}
    # 3: near-duplicates on five-word shingles
    sets = {i: shingles(t, 5) for i, t in stay.items()}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(ids, linked)
    stay = {i: t for i, t in stay.items() if comp[i] == i}
    # 4: contamination
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    gone = {r[0] for r in hits_brute(list(stay.items()), bench) if r[5]}
    stay = {i: t for i, t in stay.items() if i not in gone}
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == stay and len(rows) == len(stay)
    # 5: one block a slot
    assert len({(r.slot, r.pos) for r in rows}) == len(rows)


def test_pipeline_takes_odd_rows(spark, make_docs):
    from tests.llm.conftest import odd_rows
    scratch = Scratch(spark, "t")  # as run() does: each stage is written and read again
    docs, empty = make_docs(odd_rows(), clash=True), make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = scratch.table(stage(spark, docs, SF001)), scratch.table(stage(spark, empty, SF001))
        assert docs.count() > 0, name
    assert empty.count() == 0
