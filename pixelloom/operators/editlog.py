"""Edit logs and progress events in batch: the last, the first, bursts, runs and statuses of each key. Undo and redo are in editlog_fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """(key, order, values) of each key's last event: results that a later one overtook are dropped."""
    return events.groupBy(key).agg(F.max(F.struct(order, *values)).alias("m")).select(key, "m.*")


def debounced(events: DataFrame, key: str, gap_ms: int, value: str) -> DataFrame:
    """(key, ts, value, n): the last event of each burst, in which events follow within the gap."""
    w = Window.partitionBy(key).orderBy("ts", value)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    apart = (micros(F.col("ts")) - micros(F.lag("ts").over(w))) >= gap_ms * 1000
    bursts = events.withColumn("burst", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w))
    return bursts.groupBy(key, "burst").agg(F.max(F.struct("ts", value)).alias("m"), F.count(F.lit(1)).alias("n")).select(key, "m.ts", f"m.{value}", "n")


def coalesced(events: DataFrame, session: str, order: str, key: str) -> DataFrame:
    """(session, run, key, order, n): neighbouring events of one key become one step, the last."""
    from .joins import runs

    numbered = runs(events, session, order, key)
    return numbered.groupBy(session, "run", key).agg(F.max(order).alias(order), F.count(F.lit(1)).alias("n"))


def last_kept(events: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """The last `most` events of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def ticks(events: DataFrame, key: str, order: str, step: int, most: int) -> DataFrame:
    """(key, order, done): after each tick of a job, its progress so far, `step` for a tick and `most` at the end."""
    w = Window.partitionBy(key).orderBy(order)
    return events.select(key, order, F.least(F.lit(most), F.row_number().over(w) * step).cast("long").alias("done"))


#: Status of a job after each kind of event; any other kind means that it is being processed.
STATUS = {"signup": "pending", "purchase": "done", "error": "error"}


def statuses(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """(key, status, attempts, errors) of each job: pending, processing, done or error after its last event. An attempt begins where a
    job that was not being processed is."""
    status = F.lit("processing")
    for k, v in STATUS.items():
        status = F.when(F.col(kind) == k, v).otherwise(status)
    marked = events.select(key, order, status.alias("_s")).withColumn("_b", F.lag("_s").over(Window.partitionBy(key).orderBy(order)))
    begun = (F.col("_s") == "processing") & ~F.col("_b").eqNullSafe(F.lit("processing"))
    return marked.groupBy(key).agg(F.max_by("_s", order).alias("status"), F.count_if(begun).alias("attempts"), F.count_if(F.col("_s") == "error").alias("errors"))


def once(events: DataFrame, key: str, order: str) -> DataFrame:
    """The first event of each key."""
    return events.groupBy(key).agg(F.min(order).alias(order))
