"""Components of more edges than a task takes, by ranges."""

import random

import pytest
from pixelloom.operators import graph, reach


def roots_of(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("kind", ["path", "near", "far"])
def test_components_by_ranges(spark, monkeypatch, kind):
    """A long path takes a few tables, not one for each doubling; edges without any order still give the same."""
    rng = random.Random(6)
    n = 1500
    edges = {
        "path": [(i, i + 1) for i in range(n) if i != 700],
        "near": [(i, i + rng.randint(1, 5)) for i in range(n) for _ in range(rng.randint(0, 2))],
        "far": [(rng.randrange(n), rng.randrange(n)) for _ in range(900)],
    }[kind]
    rng.shuffle(edges)
    monkeypatch.setattr(graph, "SMALL", 120)
    tables, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="step": tables.append(name) or real(df, name))
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in found} == roots_of(edges) and len({r.node for r in found}) == len(found)
    assert kind == "far" or len(tables) < 8


def test_floods_send_no_table_to_all_tasks(spark):
    px = spark.createDataFrame([(0, x, y) for x in range(9) for y in range(9) if (x + y) % 5], "image_id long, x int, y int")
    plan = reach.reached(px, reach.col("x") == 0)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
