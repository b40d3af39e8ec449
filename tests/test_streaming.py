import os

from marketlens.sources.testdata import source_tables
from marketlens.sources.warehouse import read_ods
from marketlens.streaming import start_ods_ingest
from tests.conftest import SF001


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


HEADER = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"


def test_incremental_ods_ingest_exactly_once(spark, tmpdir_path):
    landing, out, ck = (os.path.join(tmpdir_path, d) for d in ("landing", "out", "ck"))
    _write(f"{landing}/sellers/part1.csv", HEADER + "s1,01310,sao paulo,SP\ns2,20000,rio,RJ\n")
    q = start_ods_ingest(spark, landing, "sellers", out, ck, etl_date="2024-01-01")
    q.awaitTermination()
    _write(f"{landing}/sellers/part2.csv", HEADER + "s3,30000,bh,MG\n")
    q = start_ods_ingest(spark, landing, "sellers", out, ck, etl_date="2024-01-02")
    q.awaitTermination()
    q = start_ods_ingest(spark, landing, "sellers", out, ck, etl_date="2024-01-03")  # nothing new
    q.awaitTermination()
    df = read_ods(spark, out, "sellers")
    got = sorted((r.seller_id, r.seller_zip_code_prefix, str(r.etl_date)) for r in df.collect())
    assert got == [("s1", "01310", "2024-01-01"), ("s2", "20000", "2024-01-01"), ("s3", "30000", "2024-01-02")]


def test_batch_load_after_a_stream_is_seen(spark, tmpdir_path):
    from marketlens.plans.pipeline import build
    landing, out, ck = (os.path.join(tmpdir_path, d) for d in ("landing", "out", "ck"))
    _write(f"{landing}/sellers/part1.csv", HEADER + "s1,01310,sao paulo,SP\n")
    start_ods_ingest(spark, landing, "sellers", out, ck, etl_date="2024-01-01").awaitTermination()
    sellers = source_tables(spark, SF001)["sellers"]
    build(spark, {"sellers": sellers}, out, layer="ods", etl_date="2024-01-02")
    days = {str(r.etl_date): r["count"] for r in read_ods(spark, out, "sellers").groupBy("etl_date").count().collect()}
    assert days == {"2024-01-01": 1, "2024-01-02": sellers.count()}
