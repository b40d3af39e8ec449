"""Operator 1 [native]: URL allow / block rules by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into expressions: each host suffix of as many
labels as some rule host has, with each path prefix whose length some rule path has.  The
expressions meet the rules in an equi-join on a short hash prefix (the first 32
bits of SHA-256); equal full digests confirm a match, and the longest rule wins.

Expansion runs on distinct (host, path) pairs, so copies of a hot URL are
combined before the shuffle; the verdict goes back to the rows by an equi-join
whose URL side adaptive execution may split.  The rule side is never hinted: the
planner broadcasts it only below the session's size threshold.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; a URL that no rule fits takes ``default``; rules with a null or
empty host or a null path are ignored; of equally long rules the one with the
longer host, then block before allow, then the smaller rule string wins.
A host of any number of labels and a path of any length have no more expressions than that.
Repeated rows and ids stay; other columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower

#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def split_url(url) -> tuple:
    """(host, path) columns by the rule in the module docstring."""
    return (ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, URL, 2), F.lit("")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url)``."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = rules.where("rule_host <> '' and rule_path is not null").select(
        ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict").distinct()
    book = good.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("digest", 1, 8))
    # one row: the path lengths that occur in rules (at most the longest rule path)
    lengths = good.select(F.sort_array(F.collect_set(F.char_length("rule_path"))).alias("x")).scalar()
    # and the label counts of rule hosts: a host of a million labels has no more suffixes than these
    labels = "char_length({0}) - char_length(replace({0}, '.', '')) + 1".format
    counts = good.select(F.sort_array(F.collect_set(F.expr(labels("rule_host")))).alias("x")).scalar()

    keys = rows.where("host <> ''").select("host", "path").distinct()
    parts = (keys.withColumn("labels", F.expr(labels("host")))
             .withColumn("some", F.explode(counts))
             .where("some <= labels")
             .withColumn("suffix", F.expr("substring_index(host, '.', -some)"))
             .withColumn("len", F.explode(lengths))
             .where("len <= char_length(path)")
             .withColumn("prefix", F.expr("substring(path, 1, len)")))
    exprs = parts.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("full")).withColumn(
        "short", F.substring("full", 1, 8))
    hit = exprs.join(book, "short").where("full = digest")  # short prefix joins, full digest confirms
    rule = F.concat("rule_host", "rule_path")
    best = hit.groupBy("host", "path").agg(F.min_by(
        F.struct(rule.alias("rule"), F.col("rule_verdict")),
        F.struct((-F.char_length(rule)).alias("a"), (-F.char_length("rule_host")).alias("b"),
                 (F.col("rule_verdict") != "block").alias("c"), rule.alias("d"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
