import os

import pytest
from pyspark.sql import functions as F

from marketlens.plans import ads_reports, marts, py_reports, sql_reports
from marketlens.plans.model import Warehouse
from marketlens.plans.pipeline import build
from marketlens.sources.testdata import source_tables
from marketlens.sources.releases import Load, Release
from marketlens.sources.warehouse import audit_counts
from tests.conftest import SF001
from tests.fixtures import mini_sources

DAY = "2024-01-01"


def counts(audit):
    return {(r.layer, r.table): r.rows for r in audit.collect()}


def test_build_all_layers_and_rerun(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    a1 = counts(build(spark, src, tmpdir_path, etl_date=DAY))
    assert a1[("ODS", "ods_order_items")] == src["order_items"].count()
    assert a1[("DWD", "dwd_order_detail")] > 0 and a1[("DWS", "dws_daily_metrics")] > 0
    # idempotent: a re-run of one layer replaces what it wrote; the day is the fact's own
    a2 = counts(build(spark, src, tmpdir_path, layer="dws"))
    assert a2[("DWS", "dws_daily_metrics")] == a1[("DWS", "dws_daily_metrics")]


def test_unknown_layer(spark, tmpdir_path):
    with pytest.raises(ValueError):
        build(spark, {}, tmpdir_path, layer="ads")


def test_rebuild_leaves_no_stale_month(spark, tmpdir_path):
    src = mini_sources(spark)
    ts = "order_purchase_timestamp"
    moved = src["orders"].withColumn(ts, F.when(F.col("order_id") == "o1", F.timestamp_add("MONTH", F.lit(2), F.col(ts))).otherwise(F.col(ts)))
    build(spark, src | {"orders": moved}, tmpdir_path, etl_date=DAY)
    build(spark, src, tmpdir_path, etl_date=DAY)
    fact = Release.open(spark, tmpdir_path).table("dwd_order_detail")
    assert fact.count() == Warehouse(spark, src, etl_date=DAY).fact.count()
    assert fact.groupBy("order_id", "order_item_id").count().where("count > 1").count() == 0


def test_layer_without_snapshot_raises_and_keeps_the_tables(spark, tmpdir_path):
    build(spark, mini_sources(spark), tmpdir_path, etl_date=DAY)
    before = Release.open(spark, tmpdir_path).table("dim_customers").count()
    for layer in ("dwd", "dws"):
        with pytest.raises(LookupError):
            build(spark, {}, tmpdir_path, layer=layer, etl_date="2024-02-02")
    assert Release.open(spark, tmpdir_path).table("dim_customers").count() == before > 0
    assert counts(build(spark, {}, tmpdir_path, layer="dwd"))[("DWD", "dim_customers")] == before  # the newest snapshot


def test_audit_counts_the_run_only(spark, tmpdir_path):
    src = mini_sources(spark)
    first = counts(build(spark, src, tmpdir_path, etl_date=DAY))
    assert counts(build(spark, src, tmpdir_path, etl_date="2024-01-02")) == first
    assert first[("ODS", "ods_orders")] == src["orders"].count()


def test_audit_of_missing_tables(spark):
    assert counts(audit_counts({"ODS": {"ods_orders": None}})) == {("ODS", "ods_orders"): 0}
    got = counts(ads_reports.s8_warehouse_stats(Warehouse(spark, {"orders": mini_sources(spark)["orders"]}, etl_date=DAY)))
    assert got[("ODS", "ods_orders")] == 8 and got[("ODS", "ods_sellers")] == 0 and got[("DWS", "dws_daily_metrics")] == 0


def test_load_warehouse_and_fallback(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, etl_date=DAY)
    wh = Warehouse.load(spark, "warehouse", tmpdir_path, date_floor=None)
    direct = Warehouse(spark, src, etl_date=DAY)
    assert wh.fact.count() == direct.fact.count() and wh.etl_date == DAY
    assert wh.mart("dws_daily_metrics").count() == marts.daily_metrics(direct).count()
    assert set(wh.warehouse_delivered.columns) >= {"product_length_cm", "order_id"}
    floor = Warehouse.from_warehouse(spark, tmpdir_path, date_floor="1995-01-01")
    assert floor.fact.count() == direct.fact.where("purchase_date >= date'1995-01-01'").count()
    assert Warehouse.from_warehouse(spark, tmpdir_path).fact.count() == 0  # the loader's floor lies after these data
    missing = os.path.join(tmpdir_path, "nothing-here")
    csv_dir = os.path.join(tmpdir_path, "csv")
    os.makedirs(csv_dir)
    with pytest.raises(LookupError):
        Warehouse.load(spark, "warehouse", missing)
    fb = Warehouse.load(spark, "warehouse", missing, fallback_csv=csv_dir, etl_date=DAY)
    assert fb.src == {} and fb.etl_date == DAY


def test_older_day_is_not_mixed_with_the_newest_fact(spark, tmpdir_path):
    src = mini_sources(spark)
    build(spark, src, tmpdir_path, etl_date=DAY)
    build(spark, src | {"order_items": src["order_items"].where("order_id <> 'o1'")}, tmpdir_path, etl_date="2024-01-02")
    old = Warehouse.from_warehouse(spark, tmpdir_path, etl_date=DAY, date_floor=None)
    new = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None)
    assert old.fact.where("order_id = 'o1'").count() == 2 and new.fact.where("order_id = 'o1'").count() == 0
    assert old.mart("dws_daily_metrics").count() == new.mart("dws_daily_metrics").count() + 1


STORED_REPORTS = ["q22", "q23", "q25", "q26", "q27", "q28", "q29", "q30", "q31", "q32", "q35", "q37", "q38", "q41", "q43"]


def test_reports_scan_the_stored_marts_only(spark, tmpdir_path):
    build(spark, mini_sources(spark), tmpdir_path, etl_date=DAY)
    wh = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None)
    for name, fn in ads_reports.QUERIES.items():
        if name[:3] in STORED_REPORTS:
            files = fn(wh).inputFiles()
            assert files and all("/dws_" in f for f in files), name


@pytest.mark.parametrize("mode", ["csv", "warehouse"])
def test_every_report_runs_on_source_shaped_keys(spark, tmpdir_path, mode):
    src = mini_sources(spark)
    wh = Warehouse(spark, src, etl_date=DAY).materialize(tmpdir_path)
    if mode == "warehouse":
        wh = wh.for_dashboard()
        families = (py_reports.QUERIES,)
    else:
        families = (sql_reports.QUERIES, marts.QUERIES, ads_reports.QUERIES, py_reports.QUERIES)
    for family in families:
        for name, fn in family.items():
            fn(wh).collect()


def test_warehouse_mode_frames(spark, tmpdir_path):
    wh = Warehouse(spark, mini_sources(spark), etl_date=DAY).materialize(tmpdir_path).for_dashboard()
    assert wh.order_frame.count() == wh.fact.select("order_id").distinct().count()  # L6
    row = wh.report_frame.where("order_id = 'o1'").first()
    assert row.delivery_time_days == 2 and row.purchase_dayofweek == 6 and row.order_purchase_timestamp is not None  # a Sunday
    cats = {r.category_name: r for r in wh.category_frame.collect()}
    assert cats["bed_table"].unique_products == 1  # J11
    assert 0 <= cats["bed_table"].delay_rate <= 100
    assert wh.report_frame.columns.count("product_weight_g") == 1


def test_slow_deliveries_and_reviews_of_the_adapter(spark):
    src = source_tables(spark, SF001)
    days = src["orders"].where("order_delivered_customer_date is not null").select(
        F.datediff("order_delivered_customer_date", "order_purchase_timestamp").alias("d"))
    assert days.where("d > 60 and d > 50 and d <= 200").count() > 0 and days.where("d > 200").count() > 0
    n = {r.order_id: r["count"] for r in src["order_reviews"].groupBy("order_id").count().collect()}
    assert {1, 2} == set(n.values()) and len(n) < src["orders"].count()


# ------------------------------------------------------------- published releases


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_detail_rebuild_alone_does_not_empty_the_reports(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, etl_date=DAY)
    build(spark, src, tmpdir_path, layer="ods", etl_date="2024-01-02")
    build(spark, src, tmpdir_path, layer="dwd", etl_date="2024-01-02")
    wh, direct = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None), Warehouse(spark, src, etl_date="2024-01-02")
    for name in ("q22_overview_kpis", "q37_sales_trend", "s8_warehouse_stats"):
        assert rows_of(ads_reports.QUERIES[name](wh)) == rows_of(ads_reports.QUERIES[name](direct)) != [], name
    build(spark, {}, tmpdir_path, layer="dws")
    again = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None)
    assert all("/dws_" in f for f in ads_reports.q37_sales_trend(again).inputFiles())
    assert rows_of(ads_reports.q37_sales_trend(again)) == rows_of(ads_reports.q37_sales_trend(wh))


@pytest.mark.parametrize("dies_at", ["daily_metrics", "weekly_metrics", "state_summary"])
def test_a_build_that_dies_leaves_the_old_release(spark, tmpdir_path, monkeypatch, dies_at):
    src = mini_sources(spark)
    build(spark, src, tmpdir_path, etl_date=DAY)
    old = Release.open(spark, tmpdir_path)
    before = {n: rows_of(old.table(n)) for n in old.by_name}

    def dies(*_, **__):
        raise RuntimeError("executor lost")
    monkeypatch.setattr(marts, dies_at, dies)
    fewer = src | {"order_items": src["order_items"].where("order_id <> 'o1'")}
    with pytest.raises(RuntimeError):
        build(spark, fewer, tmpdir_path, etl_date="2024-01-02")
    now = Release.open(spark, tmpdir_path)
    assert now.number == old.number == 1 and {n: rows_of(now.table(n)) for n in now.by_name} == before
    monkeypatch.undo()
    build(spark, fewer, tmpdir_path, etl_date="2024-01-02")
    assert Release.open(spark, tmpdir_path).number == 2
    assert {n: rows_of(Release.open(spark, tmpdir_path, 1).table(n)) for n in before} == before  # older releases stay readable


def months_of(release):
    return {p: e.load for p, e in release.parts("dwd_order_detail").items()}


def test_a_change_of_one_day_rewrites_one_month(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, etl_date=DAY)
    first = months_of(Release.open(spark, tmpdir_path))
    day = Release.open(spark, tmpdir_path).table("dwd_order_detail").agg(F.max("purchase_date")).first()[0]
    ids = src["orders"].where(F.to_date("order_purchase_timestamp") == F.lit(day)).select("order_id", F.lit(1).alias("hit"))
    price = F.when(F.col("hit").isNull(), F.col("price")).otherwise((F.col("price") + 1).cast(src["order_items"].schema["price"].dataType))
    changed = src | {"order_items": src["order_items"].join(ids, "order_id", "left").withColumn("price", price).select(*src["order_items"].columns)}
    build(spark, changed, tmpdir_path, etl_date="2024-01-02")
    release = Release.open(spark, tmpdir_path)
    now = months_of(release)
    assert [m for m in now if now[m] != first[m]] == [f"{day:%Y-%m}"] and len(now) > 10
    stored = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None)
    whole = Warehouse(spark, changed, etl_date="2024-01-02")
    assert rows_of(stored.fact.select(*whole.fact.columns)) == rows_of(whole.fact)
    for name in ("dim_sellers", "dim_customers"):
        assert rows_of(getattr(stored, name)) == rows_of(getattr(whole, name))


def test_vanished_months_and_an_empty_fact(spark, tmpdir_path):
    src = mini_sources(spark)
    build(spark, src, tmpdir_path, etl_date=DAY)
    full = rows_of(Release.open(spark, tmpdir_path).table("dwd_order_detail"))
    build(spark, src | {"orders": src["orders"].where("order_id = 'o1'")}, tmpdir_path, etl_date=DAY)
    assert len(months_of(Release.open(spark, tmpdir_path))) == 1
    with pytest.raises(LookupError):  # no orders at all: the layer does not empty the warehouse
        build(spark, src | {"orders": src["orders"].limit(0)}, tmpdir_path, etl_date=DAY)
    build(spark, src | {"orders": src["orders"].withColumn("order_status", F.lit("canceled"))}, tmpdir_path, etl_date=DAY)
    assert Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None).fact.count() == 0
    build(spark, src, tmpdir_path, etl_date=DAY)
    assert rows_of(Release.open(spark, tmpdir_path).table("dwd_order_detail")) == full


def test_audit_reads_no_data_file(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    audit = build(spark, src, tmpdir_path, etl_date=DAY)
    assert audit.inputFiles() == []
    release = Release.open(spark, tmpdir_path)
    assert counts(audit) == {(layer, t): release.table(t).count() for layer, t in counts(audit)}
    wh = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None)
    stats = ads_reports.s8_warehouse_stats(wh)
    assert stats.inputFiles() == [] and rows_of(stats) == rows_of(ads_reports.s8_warehouse_stats(Warehouse(spark, src, etl_date=DAY)))


def test_two_builds_at_once_are_noticed(spark, tmpdir_path):
    one, two = Load(spark, tmpdir_path), Load(spark, tmpdir_path)
    for load in (one, two):
        load.replace("dim_x", spark.range(3), DAY)
    assert one.publish().number == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        two.publish()
    assert Release.open(spark, tmpdir_path).unused_folders([("dim_x", one.id), ("dim_x", two.id)]) == [("dim_x", two.id)]
    with pytest.raises(LookupError):
        Release.open(spark, tmpdir_path, 7)


# ------------------------------------------------------------- what a build moves


def test_a_day_is_written_as_it_lies(spark, tmpdir_path):
    day = spark.range(0, 80, 1, 4).withColumn("etl_date", F.lit(DAY).cast("date"))
    load = Load(spark, tmpdir_path)
    got = load.replace_day("ods_x", day, "etl_date", DAY)
    assert len(got.inputFiles()) == 4  # no shuffle by the one day brought them together
    assert got.columns == day.columns and rows_of(got) == rows_of(day)
    assert load.state.rows("ods_x", [DAY]) == 80


def test_a_build_joins_the_star_once(spark, tmpdir_path, monkeypatch):
    src = mini_sources(spark)
    build(spark, src, tmpdir_path, etl_date=DAY)
    star, joined = Warehouse._star, []

    def counted(self, *a, **kw):
        joined.append(kw)
        return star(self, *a, **kw)
    monkeypatch.setattr(Warehouse, "_star", counted)
    fewer = src | {"order_items": src["order_items"].where("order_id <> 'o1'")}
    build(spark, fewer, tmpdir_path, etl_date="2024-01-02")
    assert len(joined) == 1
    stored, whole = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None), Warehouse(spark, fewer, etl_date="2024-01-02")
    assert rows_of(stored.fact.select(*whole.fact.columns)) == rows_of(whole.fact) != []


def test_order_lines_are_stored_once_for_items_and_payments(spark, tmpdir_path):
    from marketlens.sources.testdata import with_stored_lines
    raw = source_tables(spark, SF001)
    stored = with_stored_lines(raw, tmpdir_path)
    for name in ("order_items", "order_payments"):
        assert all("/src_item_lines/" in f for f in stored[name].inputFiles())
        assert "Exchange" not in stored[name]._jdf.queryExecution().executedPlan().toString()
        assert stored[name].columns == raw[name].columns and rows_of(stored[name]) == rows_of(raw[name])


def test_lines_are_shuffled_as_supplied(spark):
    plan = source_tables(spark, SF001)["_item_lines"]._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "AS price" in above and "AS price" not in below and "AS freight_value" not in below


def test_months_are_merged_from_staged_files_without_a_shuffle(spark, tmpdir_path):
    from marketlens.sources.releases import CODEC
    base = spark.range(0, 120, 1, 4).select("id", F.concat(F.lit("2024-0"), F.col("id") % 3 + 1).alias("m"))

    def derive(df):
        return df.select("m", (F.col("id") * 2).alias("twice"), "id")
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, load = spark.conf.get(key), Load(spark, tmpdir_path)
    assert load.replace_changed("x", base, "m", DAY, derive) == {"changed": ["2024-01", "2024-02", "2024-03"], "vanished": [], "kept": []}
    staged = spark.read.parquet(f"{tmpdir_path}/staging/x/load={load.id}").inputFiles()
    assert len(staged) == 4 * 3  # each task wrote its rows of every month where they lay
    got = load.publish().table("x")
    assert len(got.inputFiles()) == 3 and all(f".{CODEC}." in f for f in got.inputFiles())
    assert rows_of(got) == rows_of(derive(base)) and got.columns == ["m", "twice", "id"]
    again = Load(spark, tmpdir_path)
    moved = base.where("id <> 5").withColumn("id", F.when(F.col("m") == "2024-02", F.col("id") + 1).otherwise(F.col("id")))
    assert again.replace_changed("x", moved, "m", DAY, derive) == {"changed": ["2024-02", "2024-03"], "vanished": [], "kept": ["2024-01"]}
    assert rows_of(again.publish().table("x")) == rows_of(derive(moved)) and spark.conf.get(key) == before


def test_a_month_of_many_rows_has_several_files(spark, tmpdir_path, monkeypatch):
    from marketlens.sources import releases
    monkeypatch.setattr(releases, "ROWS_A_FILE", 20)
    base = spark.range(0, 60, 1, 6).select("id", F.lit("2024-01").alias("m"))
    load = Load(spark, tmpdir_path)
    load.replace_changed("x", base, "m", DAY, lambda df: df)
    got = load.state.table("x")
    assert 1 < len(got.inputFiles()) <= 3 and rows_of(got) == rows_of(base) and load.state.rows("x") == 60


def test_orders_of_two_loads_are_stored_once(spark, tmpdir_path):
    from marketlens.sources.testdata import with_stored_input
    raw = source_tables(spark, SF001)
    stored = with_stored_input(raw, tmpdir_path)["orders"]
    assert all("/src_orders/" in f for f in stored.inputFiles())
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    assert stored.columns == raw["orders"].columns and rows_of(stored) == rows_of(raw["orders"])


def test_rows_in_buckets_by_order_stay_there(spark, tmpdir_path):
    from marketlens.plans.model import Warehouse
    from marketlens.plans.pipeline import BY_ORDER, ods_snapshot
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, layer="ods", etl_date=DAY, order_buckets=4)
    release = Release.open(spark, tmpdir_path)
    assert release.buckets([f"ods_{t}" for t in BY_ORDER], DAY) == 4 and release.buckets(["ods_orders", "ods_products"], DAY) is None
    stored, _ = ods_snapshot(spark, tmpdir_path)
    for name in BY_ORDER:
        assert stored[name].columns == src[name].columns and rows_of(stored[name]) == rows_of(src[name])
    wh = Warehouse(spark, stored, etl_date=DAY)
    wh.order_buckets, wh.known_rows = 4, {"ods_sellers": 10}
    plan = wh.fact_base()._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(order_id" in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)  # keys and reviews come to the buckets, orders and items stay
    assert rows_of(wh.fact) == rows_of(Warehouse(spark, src, etl_date=DAY).fact) != []


@pytest.mark.parametrize("sellers", [0, 10])
def test_buckets_by_order_give_the_same_fact_of_odd_keys(spark, tmpdir_path, monkeypatch, sellers):
    src = mini_sources(spark)
    twice = src["products"].limit(1)  # a product that is listed twice doubles its items, as in the joins without buckets
    items = src["order_items"]
    none, other = [items.limit(1).withColumns({"product_id": F.lit(p).cast("string"), "order_item_id": F.lit(n).cast(items.schema["order_item_id"].dataType)})
                   for p, n in ((None, 98), ("nowhere", 99))]
    odd = src | {"products": src["products"].unionByName(twice), "order_items": items.unionByName(none).unionByName(other)}
    monkeypatch.setattr(Warehouse, "BROADCAST_ROWS", {"sellers": sellers})
    build(spark, odd, tmpdir_path, etl_date=DAY, order_buckets=3)
    stored, whole = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None), Warehouse(spark, odd, etl_date=DAY)
    flags = ("first_of_order", "first_in_category")  # which of two equal rows is the first one is open
    assert rows_of(stored.fact.select(*whole.fact.columns).drop(*flags)) == rows_of(whole.fact.drop(*flags)) != []
    assert rows_of(stored.dim_sellers) == rows_of(whole.dim_sellers) and rows_of(stored.dim_customers) == rows_of(whole.dim_customers)
    assert rows_of(Release.open(spark, tmpdir_path).table("ods_order_items").drop("etl_date")) == rows_of(odd["order_items"])


@pytest.mark.parametrize("counted, buckets, broadcast", [(10, 4, True), (10**7, 4, False), (0, 4, False), (10**7, None, False)])
def test_dimensions_go_to_the_driver_by_counted_rows_not_by_file_sizes(spark, tmpdir_path, counted, buckets, broadcast):
    from marketlens.plans.pipeline import ods_snapshot
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, layer="ods", etl_date=DAY, order_buckets=buckets)
    wh = Warehouse(spark, ods_snapshot(spark, tmpdir_path)[0], etl_date=DAY)
    wh.order_buckets = buckets
    wh.known_rows = {f"ods_{t}": counted for t in ("customers", "products", "orders")} | {"ods_sellers": 10}  # 0: streamed, not counted
    for df, tables in ((wh.fact_base(), {"customer_id", "product_id"}), (wh.dim_customers, {"customer_id"})):
        joins = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [" in line]
        sent = {key for line in joins for key in ("customer_id", "product_id") if "BroadcastHashJoin" in line and f"[{key}#" in line}
        assert bool(sent & tables) == broadcast, joins
    whole = Warehouse(spark, src, etl_date=DAY)
    assert rows_of(wh.fact) == rows_of(whole.fact) != [] and rows_of(wh.dim_customers) == rows_of(whole.dim_customers)


def test_product_sizes_go_to_the_driver_by_counted_rows_not_by_file_sizes(spark, tmpdir_path):
    src = source_tables(spark, SF001)
    build(spark, src, tmpdir_path, layer="ods", etl_date=DAY)
    build(spark, src, tmpdir_path, layer="dwd", etl_date=DAY)
    few = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None).for_dashboard()
    many = Warehouse.from_warehouse(spark, tmpdir_path, date_floor=None).for_dashboard()
    many.known_rows["dim_products"] = 10**7
    plans = [wh.report_frame._jdf.queryExecution().executedPlan().toString() for wh in (few, many)]
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False] and "ShuffledHashJoin" in plans[1]
    assert rows_of(many.report_frame) == rows_of(few.report_frame) != []
