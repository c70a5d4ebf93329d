"""URL filters, DataFrame functions only.

A small ordered rule set (host and path prefixes) decides first. Every other page is tested against a blocked Bloom filter of
the listed canonical URLs; a miss is certain and passes without a shuffle, a possible hit goes to an exact join on the
canonical URL, which removes the false positives.

The filter has one row of four 64-bit words for each block, and a block for some 16 entries, however long the list (one entry in
10,000 is a false hit). Up to SENT_BLOCKS blocks (40 MB) it is broadcast; larger filters are joined by block.

Cases: a null url or one without :// has empty host and path, fits no rule and is not listed. Repeated pages are judged each.
Rules are few and passed by the caller; the longest host-and-path wins. Other columns are not read. Empty inputs are fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, power_of_two, stored

SENT_BLOCKS, MAX_BLOCKS = 1 << 20, 1 << 40
ENTRIES = 16
WORDS, BITS = 4, 2


def url_host(url: Column) -> Column:
    """After the first :// up to the next / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without leading www., path without trailing slashes, query without tracking parameters; no scheme or fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike(r"^(utm_[^=]*|ref)(=|$)") & (x != ""))), "&")
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.concat(host, F.regexp_replace(url_path(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], index: int) -> Column:
    """Of the longest (host, path, verdict) that fits: its text (index 0) or its verdict (index 1); null if none does."""
    chosen = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.lit((rule_host + rule_path, verdict)[index])).otherwise(chosen)
    return chosen


def _masks(value: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a value, and the bits that it sets in each word of it."""
    where, bits = F.xxhash64(value), F.xxhash64(value, F.lit(1))
    one = F.lit(1).cast("long")
    words = []
    for i in range(WORDS):
        a, b = (F.shiftrightunsigned(bits, 6 * (BITS * i + j)).bitwiseAND(F.lit(63)).cast("int") for j in range(BITS))
        words.append(F.call_function("shiftleft", one, a).bitwiseOR(F.call_function("shiftleft", one, b)))
    return where.bitwiseAND(F.lit(blocks - 1)), words


def blocked_bloom(values: DataFrame, column: str, blocks: int) -> DataFrame:
    """(_block, _w0.._w3): at most `blocks` rows."""
    block, words = _masks(F.col(column), blocks)
    return values.groupBy(block.alias("_block")).agg(*(F.bit_or(w).alias(f"_w{i}") for i, w in enumerate(words)))


def possible_hits(rows: DataFrame, value: Column, listed: DataFrame, column: str, n: int, flag: str, most: int = MAX_BLOCKS) -> DataFrame:
    """rows plus the boolean `flag`: false means that a value is not among the n values listed in a column. most: blocks of the filter; one
    that is cut to fewer than it needs has more false hits, but stays right."""
    blocks = power_of_two(n / ENTRIES, 64, most)
    names = fresh(rows.columns, "_block", *(f"_w{i}" for i in range(WORDS)))
    bloom = blocked_bloom(listed, column, blocks).toDF(*names)
    block, words = _masks(value, blocks)
    tested = rows.withColumn(names[0], block).join(F.broadcast(bloom) if blocks <= SENT_BLOCKS else bloom, names[0], "left")
    hit = F.lit(True)
    for name, w in zip(names[1:], words, strict=True):
        hit = hit & (F.coalesce(F.col(name), F.lit(0).cast("long")).bitwiseAND(w) == w)
    return tested.withColumn(flag, hit).drop(*names)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, listed) of every page. listed: canonical URLs, in a column `canonical`."""
    entries = stored(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed")
    n = entries.count()
    u = F.col(url)
    judged = pages.select(F.col(key).alias("_key"), url_host(u).alias("host"), url_path(u).alias("path"), canonical(u).alias("canonical"))
    judged = judged.withColumns({"rule": matching_rule(F.col("host"), F.col("path"), rules, 0), "_rule_verdict": matching_rule(F.col("host"), F.col("path"), rules, 1)})
    tested = possible_hits(judged, F.col("canonical"), entries, "canonical", n, "_hit").withColumn("_maybe", F.col("_hit") & F.col("rule").isNull())
    columns = ["_key", "host", "path", "rule", "_rule_verdict"]
    missed = tested.where("NOT _maybe").select(*columns, F.lit(False).alias("listed"))
    exact = entries.withColumn("_listed", F.lit(True))
    hits = tested.where("_maybe").select(*columns, "canonical").join(exact, "canonical", "left").select(*columns, F.coalesce("_listed", F.lit(False)).alias("listed"))
    verdict = F.coalesce("_rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return missed.unionByName(hits).select(F.col("_key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "listed")
