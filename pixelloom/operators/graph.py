"""Fixpoints on edge tables: connected components by ranges, else alternating stars, and greedy selection. Every round is a written table. What is left
of at most SMALL edges, counted beforehand, is no more than a partition, and is finished by the same rule in one task."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import discard, ship, stored

#: Edges that one task takes.
SMALL = 1 << 16


def _key(v) -> tuple:
    """A value so that it can be hashed, and compared as Spark does: null first, structs field by field."""
    return (v is not None, tuple(map(_key, v.values())) if isinstance(v, dict) else v)


def _value(k: tuple, kind: pa.DataType):
    if k[0] and pa.types.is_struct(kind):
        return {kind.field(i).name: _value(x, kind.field(i).type) for i, x in enumerate(k[1])}
    return k[1]


def _keys(column: pa.Array) -> list[tuple]:
    return [_key(v) for v in column.to_pylist()]


def _values(keys: list[tuple], kind: pa.DataType) -> pa.Array:
    return pa.array([_value(k, kind) for k in keys], kind)


def _roots(batches: Iterator[pa.RecordBatch], own: bool = False) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v): trees whose roots are their smallest nodes; own: with the roots themselves."""
    parent: dict = {}
    kind = None

    def root(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(_keys(batch.column(0)), _keys(batch.column(1)), strict=True):
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    if kind is not None:
        nodes = [x for x in parent if own or root(x) != x]
        yield pa.RecordBatch.from_arrays([_values(nodes, kind), _values([root(x) for x in nodes], kind)], names=["node", "root"])


def _beaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that go, of all conflicts (better, worse): a node is decided when all better ones are."""
    worse, waits, kind = defaultdict(list), defaultdict(int), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(_keys(batch.column(0)), _keys(batch.column(1)), strict=True):
            worse[a].append(b)
            waits[b] += 1
    gone, ready = set(), deque(a for a in worse if a not in waits)
    while ready:
        a = ready.popleft()
        for b in worse.get(a, ()):
            if a not in gone:
                gone.add(b)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([_values(list(gone), kind)], names=["node"])


def _finished(edges: DataFrame, solve, *names: str) -> DataFrame:
    kind = edges.schema.fields[0].dataType
    return stored(edges.coalesce(1).mapInArrow(solve, T.StructType([T.StructField(n, kind) for n in names])), "finished")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.union(edges.select("v", "u")) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("least"))
    joined = near.join(least.hint("merge"), "u")  # files of nodes are far smaller than their rows
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return out.where("u <> v")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _roots() gives of a partition's edges, and the roots with themselves."""
    return _roots(batches, True)


def _contracted(edges: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) in ranges of v, of SMALL each: (node, root) by range, where a node that is in several has a row for each, written; and
    the edges (a, b) between roots that such nodes have in common. Near nodes have near values, so hardly any are in several."""
    kind = edges.schema.fields[0].dataType
    dealt = edges.repartitionByRange(-(-count // max(1, SMALL)), "v")
    forest = stored(dealt.mapInArrow(_forest, T.StructType([T.StructField(n, kind) for n in ("node", "root")])), "forest")
    least = forest.groupBy("node").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return forest, forest.join(least.hint("merge"), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node in reach; nodes that are their own root are left out. Of many edges each range is contracted
    in one task, and what is left between ranges is solved in the same way; where that is not much less, by stars."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before, mark = None, _mark(now)
    if mark[0] > SMALL:
        forest, between = _contracted(now, mark[0])
        between = stored(between.distinct(), "between")
        if between.count() <= mark[0] // 4:
            discard(now)
            top = components(between).select(F.col("node").alias("least"), F.col("root").alias("_top"))
            own = forest.groupBy("node").agg(F.min("root").alias("least"))
            return own.join(top.hint("merge"), "least", "left").select("node", F.coalesce("_top", "least").alias("root")).where("node <> root")
        discard(forest, between)
    while mark[0] and mark != before:
        if mark[0] <= SMALL:
            done = _finished(now, _roots, "node", "root")
            discard(now)
            return done
        last, now = now, stored(_star(_star(now, True), False).distinct(), "edges")
        discard(last)
        before, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def greedy(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(node, kept): in order of rank, a node stays unless one that stays, of better rank, conflicts with it.
    nodes: (node, rank), ranks distinct. conflicts: (better, worse). A round keeps every open node without an open better neighbour
    and drops its worse ones; settled nodes and their conflicts are left out of the next round. The rounds are as many as the
    longest chain of alternating decisions, not as the nodes."""
    every = stored(nodes.select("node"), "nodes")
    known = conflicts.join(every.withColumnRenamed("node", "better"), "better", "left_semi")
    open_, conflicts = stored(every, "open"), stored(known.select("better", "worse").distinct(), "conflicts")
    chosen: list[DataFrame] = []
    while not open_.isEmpty():
        if conflicts.count() <= SMALL:
            chosen.append(stored(open_.join(_finished(conflicts, _beaten, "node"), "node", "left_anti"), "kept"))
            discard(open_, conflicts)
            break
        kept = stored(open_.join(conflicts.select(F.col("worse").alias("node")).distinct(), "node", "left_anti"), "kept")
        chosen.append(kept)
        beaten = conflicts.join(kept.withColumnRenamed("node", "better"), "better", "left_semi").select(F.col("worse").alias("node")).distinct()
        left = stored(open_.join(kept, "node", "left_anti").join(beaten, "node", "left_anti"), "open")
        rest = conflicts.join(left.withColumnRenamed("node", "better"), "better", "left_semi").join(left.withColumnRenamed("node", "worse"), "worse", "left_semi")
        rest = stored(rest.select("better", "worse"), "conflicts")
        discard(open_, conflicts)
        open_, conflicts = left, rest
    if not chosen:
        return every.withColumn("kept", F.lit(True))
    kept = chosen[0]
    for part in chosen[1:]:
        kept = kept.union(part)
    return every.join(kept.withColumn("kept", F.lit(True)), "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))


ship(__name__)
