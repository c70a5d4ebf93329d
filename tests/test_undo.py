"""Undo and redo over tagged logs, in batch and on streams, against lists."""

import random
import shutil

import pytest
from pixelloom.operators import editlog_fold as ef
from pixelloom.sources import fixtures as fx
from pixelloom.streaming import events as ev
from pixelloom.streaming import undo

LOG = "session long, seq long, op string, log string"


def random_log(seed, n=2000):
    rng = random.Random(seed)
    weights = {0: (1, 4, 1), 1: (3, 1, 1), 2: (1, 2, 4)}  # sessions that often have nothing to undo, rarely, or redo much
    rows = []
    for i in range(n):
        s = rng.choice((0, 1, 2, 3, None))
        rows.append((s, i, rng.choices(("edit", "undo", "redo"), weights.get(s, (1, 1, 1)))[0], rng.choice(("palette", "fill", None))))
    return rows


def brute(rows):
    state, out = {}, []
    for s, i, op, log in sorted(rows, key=lambda r: r[1]):
        done, undone = state.setdefault(s, ([], []))
        hit = (None, None)
        if op == "edit":
            hit = (log, i)
            done.append(hit)
            undone.clear()
        elif op == "undo" and done:
            hit = done.pop()
            undone.append(hit)
        elif op == "redo" and undone:
            hit = undone.pop()
            done.append(hit)
        out.append((s, i, op, *hit))
    return out, {s: (len(d), len(u), d[-1][1] if d else None) for s, (d, u) in state.items()}


@pytest.mark.parametrize("batch", [7, 10_000])
def test_batch(spark, batch):
    rows = random_log(1)
    routes, states = brute(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG)
        assert sorted((tuple(r) for r in ef.routed(df).collect()), key=str) == sorted(routes, key=str)
        found = {r.session: (r.standing, r.redoable, r.last_edit) for r in ef.replayed(df).collect()}
        counts = {(r.session, r.edits + r.undos + r.redos) for r in ef.replayed(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == states and counts == {(s, sum(r[0] == s for r in rows)) for s in states}
    assert ef.replayed(df.limit(0)).collect() == [] and ef.routed(df.limit(0)).collect() == []


def test_stream_over_several_triggers(spark, tmp_path):
    rows = [r for r in random_log(3, 900) if r[0] is not None]
    routes, states = brute(rows)
    found = []
    for n in range(3):
        part = spark.createDataFrame(rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3], LOG)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = undo.routed(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: found.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(found, key=str) == sorted(routes, key=str)
    last = ev.run_to_table(undo.replayed(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))), "update", "session")
    assert {r.session: (r.standing, r.redoable, r.last_edit) for r in last.collect()} == states
    shutil.rmtree(tmp_path / "in")


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    log = fx.edit_log(spark, sf)
    batch = {r.session: (r.standing, r.redoable, r.last_edit) for r in ef.replayed(log).collect()}
    stream = ev.run_to_table(undo.replayed(ev.event_stream(spark, sf).withColumnRenamed("stage", "log")), "update", "session")
    assert {r.session: (r.standing, r.redoable, r.last_edit) for r in stream.collect()} == batch
