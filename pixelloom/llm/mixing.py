"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Every document, in a reproducible shuffled order of its source, gets a virtual finish time: the source's words up to and
with it, divided by the source's target. A source whose target exceeds its size is queued again, up to max_repeats times.
The documents of all sources, in order of their finish times, are cut off where the total budget is used up.

Running sums never pass one task: documents are cut into buckets (by the shuffled order within a source, by finish time
overall), bucket totals are summed first, and each bucket then continues from its offset. A source of a third of all rows
spreads over as many buckets as its rows need. As finish times rise within a source, what is taken is a prefix of its
order: one cut-off row for each source decides, and no text is shuffled.

Cases: null text has size 0; a source of size 0 gets target 0 and takes nothing. Rows that repeat an id are ordered
together and share their fate. The order depends on the id and the seed only. Empty tables give empty results. mixed_documents
keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

ROWS_PER_BUCKET = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """(source, sid, source_size, budget, target) by source: shares of all words by weight, filled up to max_repeats times a
    source's size. Ordered by size limit over weight, the full sources are a prefix, so running sums find the level."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    limited = ranked.select("*", weight.alias("weight"), (F.col("source_size") * max_repeats).alias("most"), F.sum("source_size").over(Window.partitionBy()).alias("budget"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    running = limited.select(
        "*",
        F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.row_number().over(order).alias("place"),
    )
    level = (F.col("budget") - F.col("full")) / F.col("rest")
    open_ = running.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    first = F.first("level", ignorenulls=True).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    settled = open_.withColumn("level", first)
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
    return settled.select("source", "sid", "source_size", "budget", target.alias("target"))


def _running(rows: DataFrame, groups: list[str], bucket: str, order: list, size: str, out: str) -> DataFrame:
    """rows plus `out`: the sum of `size` up to and with a row, over `groups` in the order of bucket and `order`."""
    totals = rows.groupBy(*groups, bucket).agg(F.sum(size).alias("_total"))
    before = totals.select(*groups, bucket, (F.sum("_total").over(Window.partitionBy(*groups).orderBy(bucket)) - F.col("_total")).alias("_before"))
    within = F.sum(size).over(Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, [*groups, bucket]).withColumn(out, F.col("_before") + within).drop("_before")


def source_cuts(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """From (key, source, size): (source, sid, source_size, target, cut) where cut is the last (epoch, order, key) taken."""
    sources = stored(source_targets(sizes, weights, max_repeats), "sources")
    buckets = min(1 << 16, 1 + sizes.count() // ROWS_PER_BUCKET)
    order = shuffled(F.col("key"), seed)
    queued = sizes.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source")))
    queued = queued.select("sid", "source_size", "target", "budget", "key", "size", order.alias("order"))
    lead = F.conv(F.substring("order", 1, 4), 16, 10).cast("long")
    queued = queued.withColumn("part", F.shiftright(lead * buckets, 16).cast("int"))
    queued = _running(queued, ["sid"], "part", ["order", "key", "size"], "size", "upto")
    epochs = F.least(F.lit(max_repeats - 1), F.floor(F.try_divide(F.col("target"), F.col("source_size")))).cast("int")
    copies = queued.where("target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs)))
    end = F.col("epoch") * F.col("source_size") + F.col("upto")
    copies = copies.where(end - F.col("size") < F.col("target")).withColumn("finish", end / F.col("target"))
    copies = copies.withColumn("slot", F.least(F.lit(buckets), F.floor(F.col("finish") * buckets)).cast("int"))
    copies = _running(copies.select("sid", "budget", "key", "size", "order", "epoch", "finish", "slot"), [], "slot", ["finish", "order", "key", "epoch", "size"], "size", "used")
    cut = copies.where("used <= budget").groupBy("sid").agg(F.max(F.struct("epoch", "order", "key")).alias("cut"))
    return stored(sources.join(cut, "sid", "left"), "cuts")


def epochs_taken(cut: Column, order: Column, key: Column) -> Column:
    """How often a document is taken, from its source's cut."""
    within = F.struct(order.alias("order"), key.alias("key")) <= F.struct(cut["order"].alias("order"), cut["key"].alias("key"))
    return F.when(cut.isNull(), 0).otherwise(cut["epoch"] + F.when(within, 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken, times) of every document."""
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    cuts = source_cuts(sizes, weights, max_repeats, seed)
    times = epochs_taken(F.col("cut"), shuffled(F.col("key"), seed), F.col("key"))
    joined = sizes.withColumnRenamed("source", "_source").join(cuts, F.col("_source").eqNullSafe(F.col("source")))
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, repeated as often as they are taken."""
    sizes = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    kin, cut, times, copy = fresh(docs.columns, "kin", "cut", "times", "copy")
    cuts = source_cuts(sizes, weights, max_repeats, seed).select(F.col("source").alias(kin), F.col("cut").alias(cut))
    taken = epochs_taken(F.col(cut), shuffled(F.col(key), seed), F.col(key))
    joined = docs.join(cuts, docs[source].eqNullSafe(F.col(kin))).withColumn(times, taken).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
