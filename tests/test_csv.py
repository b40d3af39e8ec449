"""CSV source path (S1, S2, S4, S5, N26) on written-out mini files."""

import os

import pytest

from marketlens.plans.model import Warehouse
from marketlens.sources import quoted_csv
from marketlens.sources.csv import CSV_FILES, load_raw


def _write(root, name, text):
    with open(os.path.join(root, CSV_FILES[name]), "w", encoding="utf-8") as fh:
        fh.write(text)


def _fixture(root):
    _write(root, "customers", "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                              "c1,u1,01310,sao paulo,SP\n")
    _write(root, "sellers", "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,20000,rio,RJ\n")
    _write(root, "products", "product_id,product_category_name,product_name_lenght,product_description_lenght,"
                             "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n"
                             "p1,cama_mesa,40,300,2,500,10,5,2\n")
    _write(root, "orders", "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                           "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
                           "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,"
                           "2017-10-10 21:25:13,2017-10-18 00:00:00\n"
                           "o2,c1,delivered,not a date,,,,2017-10-18 00:00:00\n")
    _write(root, "order_items", "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
                                "o1,1,p1,s1,2017-10-06 11:07:15,29.99,8.72\n")
    _write(root, "order_reviews", "review_id,order_id,review_score,review_comment_title,review_comment_message,"
                                  "review_creation_date,review_answer_timestamp\n"
                                  'r1,o1,4,,"good, ""fast""\nsecond line",2017-10-11 00:00:00,2017-10-12 03:43:48\n')
    # order_payments and the translation file are missing on purpose


def test_csv_types_and_quirks(spark, tmpdir_path):
    _fixture(tmpdir_path)
    missing = []
    src = load_raw(spark, tmpdir_path, missing)
    assert missing == ["product_category_translation", "order_payments"]
    c = src["customers"].first()
    assert c.customer_zip_code_prefix == "01310"                          # N26
    p = src["products"].first()
    assert p.product_name_length == 40 and p.product_description_length == 300   # S4
    o = {r.order_id: r for r in src["orders"].collect()}
    assert o["o2"].order_purchase_timestamp is None                       # S5: bad date → NULL
    assert str(src["orders"].schema["order_purchase_timestamp"].dataType) == "TimestampNTZType()"
    r = src["order_reviews"].collect()
    assert len(r) == 1 and r[0].review_comment_message == 'good, "fast"\nsecond line'
    assert float(src["order_items"].first().price) == 29.99


def test_csv_warehouse_end_to_end(spark, tmpdir_path):
    _fixture(tmpdir_path)
    src = load_raw(spark, tmpdir_path)
    src["order_payments"] = spark.createDataFrame(
        [("o1", 1, "credit_card", 1, 38.71)],
        "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double"
    ).selectExpr("order_id", "payment_sequential", "payment_type", "payment_installments",
                 "cast(payment_value as decimal(10,2)) as payment_value")
    wh = Warehouse(spark, src, etl_date="2024-01-01")
    f = wh.fact.collect()
    assert len(f) == 1 and f[0].delivery_days == 8 and f[0].category_name == "cama_mesa"


QUOTED = ['a,b,c', '1,plain,x', '2,"two\nlines",y', '3,"say ""hi""\n\n""again""",z', '4,"\n\n\n",', '5,bare "quote" inside,6"', '', '6,"comma, and\nmore","x\ny"',
          '7,"' + "long " * 40 + '\n' + 'tail"' + ',"é\nü"', '8,,', '9,"",q', '10,"""",r', '11,"ends with quote""",s', '12,last,row']


def canon(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("cut", [7, 16, 33, 64, 10_000])
def test_split_reader_equals_the_multiline_reader(spark, tmpdir_path, cut, end):
    for i, tail in enumerate(("", end)):  # two files, one without a last line end
        with open(os.path.join(tmpdir_path, f"f{i}.csv"), "w", encoding="utf-8", newline="") as fh:
            fh.write(end.join(QUOTED) + tail)
    want = canon(spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(tmpdir_path))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = quoted_csv.read_quoted_csv(spark, tmpdir_path)
        assert canon(got) == want and len(want) == 24
        blocks = quoted_csv.records(spark, tmpdir_path).select("block").distinct().count()
        assert blocks > 3 or cut > 200
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_quote_states():
    f = quoted_csv.ends_inside
    assert [f('a,"b', False), f('a,"b"', False), f('b",c', True), f('b"",c', True), f('x', True), f('a"b', False), f('","', True), f('""', False), f('"""', False)] == [
        True, False, False, True, True, False, True, False, True]
