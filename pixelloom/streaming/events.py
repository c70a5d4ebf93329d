"""Live edit logs and progress on Structured Streaming. Each function takes a streaming DataFrame and has a batch twin in
operators.editlog; run_to_table() runs a stream over what is there and returns its result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import shared_folder
from ..sources.formats import parsed_events


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, op, ts, value, stage) from the event files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("op"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("stage"))


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Progress, result and error events from JSON lines as they arrive; other lines are dropped."""
    return parsed_events(spark.readStream.text(path))


def latest(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Each key's last event so far (update or complete mode)."""
    return events.groupBy(key).agg(F.max(F.struct(order, *values)).alias("m")).select(key, "m.*")


def debounced(events: DataFrame, key: str, gap_ms: int, value: str, late: str = "1 day") -> DataFrame:
    """The last event of each burst; a burst ends when nothing follows within the gap. With a watermark, ended bursts go out in
    append mode and their state is dropped."""
    bursts = events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{gap_ms} milliseconds").alias("burst"), key)
    return bursts.agg(F.max(F.struct("ts", value)).alias("m"), F.count(F.lit(1)).alias("n")).select(key, "m.ts", f"m.{value}", "n")


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def silent(events: DataFrame, key: str, limit_seconds: int, late: str = "1 minute") -> DataFrame:
    """(key, seq, answered): as operators.contours.timed_out, as soon as the watermark is past the limit; a key that never says anything
    again is told of too. Each key has its last event as state, which goes with the timeout."""
    limit = limit_seconds * 1000

    def watch(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        last = state.get if state.exists else None
        if state.hasTimedOut:
            out.append((name[0], last[1], False))
            state.remove()
        else:
            for ts, seq in pd.concat(list(parts)).sort_values(["_ms", "seq"])[["_ms", "seq"]].itertuples(index=False):
                if last is not None and ts - last[0] > limit:
                    out.append((name[0], last[1], True))
                last = (int(ts), int(seq))
            due = last[0] + limit + 1
            if due > state.getCurrentWatermarkMs():
                state.update(last)
                state.setTimeoutTimestamp(due)
            else:
                out.append((name[0], last[1], False))
                state.remove()
        yield pd.DataFrame(out, columns=[key, "seq", "answered"])

    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark("ts", late).withColumn("_ms", F.unix_millis("ts"))
    return timed.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, seq long, answered boolean", "at long, seq long", "append", "EventTimeTimeout")


def run_to_table(stream: DataFrame, mode: str, key: str) -> DataFrame:
    """Runs over all files there are. complete: the last trigger's table; update: each key's last row; append: all rows."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    columns = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("_trigger", T.IntegerType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_trigger", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/t={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
    if mode == "append":
        return found.drop("_trigger")
    last = found.agg(F.max("_trigger")) if mode == "complete" else None
    if last is not None:
        return found.join(F.broadcast(last.withColumnRenamed("max(_trigger)", "_trigger")), "_trigger", "left_semi").drop("_trigger")
    row = F.struct("_trigger", *(c for c in columns if c != key))
    return found.groupBy(key).agg(F.max(row).alias("m")).select(key, "m.*").drop("_trigger")
