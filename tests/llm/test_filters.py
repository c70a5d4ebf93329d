"""Filters beyond what can be sent to every task: the same answers, no text in a shuffle, few false hits."""

import random
import re

import pytest
from pixelloom.llm import exact_dedup, url_filter
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"


def documents(spark):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.choice(("Same Text", "same text", None, "", f"only {i}", f"pair {i // 2}", "x" * 5000)), rng.choice("abc")) for i in range(2000)]
    return rows + rows[100:140], spark.createDataFrame(rows + rows[100:140], DOCS).repartition(5)


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize(("most", "sent"), [(1 << 21, 1 << 20), (-1, 1 << 20), (-1, 64)])
def test_exact_copies_at_any_size(spark, monkeypatch, most, sent):
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", most)
    monkeypatch.setattr(exact_dedup, "MAX_SENT", sent)
    rows, df = documents(spark)
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(lowered(text), []).append(-1 if i is None else i)
    found = exact_dedup.exact_dedup(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.kept) for r in found) == sorted((k, max(g), len(g), k == max(g)) for g in groups.values() for k in g)
    left = exact_dedup.drop_exact_copies(df).collect()
    assert sorted((lowered(r.text), -1 if r.doc_id is None else r.doc_id) for r in left) == sorted((t, max(g)) for t, g in groups.items())
    assert {tuple(r) for r in left} <= set(rows)


def test_texts_stay_where_they_are(spark, monkeypatch):
    _, df = documents(spark)
    for most in (1 << 21, 1):  # 1: the filter of blocks is joined, not sent
        monkeypatch.setattr(exact_dedup, "FILTER_ROWS", most)
        monkeypatch.setattr(exact_dedup, "flag_possible_repeats", lambda *a, f=exact_dedup.flag_possible_repeats: f(*a))
        flagged, groups = exact_dedup.repeated_groups(df.select(F.col("doc_id").alias("key"), exact_dedup.text_digest(F.col("text")).alias("digest")))
        assert "text" not in flagged.columns + groups.columns and groups.count() > 3
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", 1 << 21)
    straight, _ = exact_dedup.split_by_groups(df.withColumn("digest", exact_dedup.text_digest(F.col("text"))), "digest", groups, "group")
    plan = straight._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"(?<!Broadcast)Exchange hashpartitioning", plan)


def test_long_lists_have_few_false_hits(spark, monkeypatch):
    listed = spark.range(400_000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".example/p")).alias("canonical"))
    others = spark.range(100_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("v"))
    for sent in (1 << 20, 0):  # broadcast, and joined by block
        monkeypatch.setattr(url_filter, "SENT_BLOCKS", sent)
        tested = url_filter.possible_hits(others, F.col("v"), listed, "canonical", 400_000, "hit")
        assert tested.where("hit").count() < 200
        assert url_filter.possible_hits(listed.withColumnRenamed("canonical", "v"), F.col("v"), listed, "canonical", 400_000, "hit").where("NOT hit").isEmpty()
    blocks = url_filter.power_of_two(50_000_000 / url_filter.ENTRIES, 64, url_filter.MAX_BLOCKS)
    fill = 1 - (1 - 1 / 64) ** (50_000_000 / blocks * url_filter.BITS)
    assert fill ** (url_filter.BITS * url_filter.WORDS) < 0.002


def test_filtered_urls_do_not_depend_on_the_filter(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.net/a/{i % 7}") for i in range(300)] + [(None, None), (1, "none")], "page_id long, url string")
    listed = pages.where("page_id % 3 = 0").select(url_filter.canonical(F.col("url")).alias("canonical"))
    whole = sorted(url_filter.filter_urls(pages, listed).collect(), key=str)
    monkeypatch.setattr(url_filter, "SENT_BLOCKS", 0)
    assert sorted(url_filter.filter_urls(pages, listed).collect(), key=str) == whole
    assert {r.listed for r in whole} == {True, False}
