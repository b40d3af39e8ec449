import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture()
def make_docs(spark):
    """documents from (doc_id, text[, lang, source]) tuples, with extra columns of clashing names if wanted."""
    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("n", "key", "hits", "items", "rep", "slot", "score", "_doc", "_drop", "lang_pred", "kept_text", "removed", "set", "q", "src"):
                df = df.selectExpr("*", f"'x' as `{c}`")
        return df
    return make


#: One row each: null id, null text, empty text, blank text, ties and repeated rows, a long text.
def odd_rows():
    words = " ".join(f"word{i} and" for i in range(300))
    return [(None, "a text without an id that has some words in it"), (1, None), (2, ""), (3, " \n\t \n"), (4, words), (4, words), (5, words),
            (6, words + " tail"), (7, "é" * 50 + "\n" + "É" * 50), (8, "short"), (9, words * 400), (10, "x" * 3_000_000)]
