"""Operators 1 and 2."""

from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from marketlens.llm.mixing import frame_slots, mix_sources, quantise
from marketlens.llm.url_filter import RULES, rule_table, url_filter

URLS = ["http://www.example.com/en/1", "https://A.Example.COM/en/x?y", "http://example.com/en", "http://x.net/es/", "http://net/fr/a#b",
        "http://xnet/es/1", "nothing", None, "", "http://", "a://b://c/en/", "http://com", "http://com/", "http://example.com.evil.org/en/",
        "http://example.com?q=/en/", "HTTP://EXAMPLE.COM/EN/1", "http://example.com:80/en/1", "http://..com/en/", "http://é.net/es/é"]


def judge(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def test_url_filter_matches_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter(pages, rule_table(spark)).collect())
    want = sorted((str(i), h, p, str(r), v) for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])] for h, p, r, v in [judge(u)])
    assert got == want


def test_url_filter_other_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/pa/th/x")], "page_id long, url string").withColumn("rule", F.lit("x"))
    rules = [("b.c", "/pa", "block"), ("c", "/pa/th", "allow"), ("", "/", "block"), ("c", None, "block"), ("a.b.c", "/pa/th/x/y", "block")]
    row = url_filter(pages, rule_table(spark, rules)).first()
    assert (row.rule, row.verdict) == ("c/pa/th", "allow")
    assert url_filter(pages.limit(0), rule_table(spark)).count() == 0
    none = url_filter(pages, rule_table(spark).limit(0), default="block").first()
    assert (none.rule, none.verdict) == (None, "block")


def test_a_hostile_host_costs_no_more_suffixes_than_rules_have(spark):
    """Hosts of a megabyte and half a million labels, and a path as long."""
    host = "a." * 500_000 + "example.com"
    urls = ["http://" + host + "/en/x", "http://" + host + "." * 500_000 + "/en/", "http://example.com/en/" + "p/" * 500_000, "http://" + "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(pages, rule_table(spark)).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: (None, "allow"), 2: ("example.com/en/", "block"), 3: (None, "allow")}


def edf(quota):
    total, done, out = sum(quota.values()), dict.fromkeys(quota, 0), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // q), s) for s, q in sorted(quota.items()) if done[s] * total <= t * q]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def test_frame_is_earliest_deadline_first_and_within_one_block(spark):
    quota = {"=a": 5, "=b": 3, "=c": 3, "=d": 1, "": 2}
    rows = sorted(frame_slots(spark.createDataFrame(list(quota.items()), "src string, q long")).collect(), key=lambda r: r.frame_slot)
    order = [r.src for r in rows]
    assert order == edf(quota)
    for t in range(1, len(order) + 1):
        seen = Counter(order[:t])
        assert all(abs(seen[s] - t * q / 14) < 1 for s, q in quota.items())


def test_mixture_keeps_all_rows_and_its_share(spark, make_docs):
    rows = [(i, "t", "en", ["a", "b", "c", None][min(3, i % 7)]) for i in range(700)] + [(None, "t", "en", "a"), (5, "t", "en", "b")]
    weights = {"a": 4, "b": 2, None: 3}
    got = mix_sources(spark, make_docs(rows, clash=True), weights, block_rows=4)
    assert set(make_docs(rows, clash=True).columns) <= set(got.columns)
    got = got.collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)  # one block a slot
        assert 0 <= r.pos < 4
    assert len({(r.slot, r.pos) for r in got}) == len(got)
    target = [r.slot for r in got if r.on_target]
    share = {"a": 4, "b": 2, "c": 1, None: 3}
    counts = list(accumulate(([Counter([slots[t][0]]) for t in range(max(target) + 1)]), lambda x, y: x + y))
    for t, seen in enumerate(counts, 1):
        assert all(abs(seen[s] - t * q / 10) < 1 for s, q in share.items())


def test_mixture_edge_cases(spark, make_docs):
    assert mix_sources(spark, make_docs([])).count() == 0
    with pytest.raises(ValueError):
        mix_sources(spark, make_docs([]), {"a": 0})
    assert sum(quantise({"a": 0.5, "b": 0.3, "c": 0.2}, 10).values()) == 10
    assert quantise({"a": 1.0, "b": 1.0}) == {"a": 1, "b": 1}


def test_groups_of_equal_weight_are_dealt_like_single_sources(spark):
    for quota in ({f"={i:03d}": 1 + i % 3 for i in range(60)}, {f"={i}": 1 + i * i % 11 for i in range(17)}, {"=x": 7}):
        rows = sorted(frame_slots(spark.createDataFrame(list(quota.items()), "src string, q long")).collect(), key=lambda r: r.frame_slot)
        assert [r.src for r in rows] == edf(quota)


def test_many_sources_are_scheduled(spark):
    n = 50_000
    quota = spark.range(n).select(F.format_string("=%06d", "id").alias("src"), F.when(F.col("id") < 5, 4).otherwise(1).cast("long").alias("q"))
    slots = frame_slots(quota)
    got = slots.agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("frame_slot").alias("places")).first()
    assert (got.n, got.sources, got.places) == (n + 15, n, n + 15)
    # less than one block off the target: the i-th turn of a source lies within its release and deadline
    bad = slots.where("turn * frame > frame_slot * q or (frame_slot + 1) * q > (turn + 1) * frame + q - 1")
    assert bad.count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_a_long_frame_is_joined_without_broadcast(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr("marketlens.llm.mixing.BROADCAST_SLOTS", limit)
    rows = [(i, "t", "en", f"s{i % 40}") for i in range(2000)]
    got = mix_sources(spark, make_docs(rows))
    assert got.count() == 2000 and got.select("slot", "pos").distinct().count() == 2000
    assert {r.n for r in got.groupBy("slot").agg(F.countDistinct("source").alias("n")).collect()} == {1}
