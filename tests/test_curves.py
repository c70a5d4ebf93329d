"""Every point of a contour lies within the bound of its curve."""

import math
import random

import numpy as np
from pixelloom.operators import contour_lines as cl
from pixelloom.operators import curves as cv

LINES = "image_id long, ring int, idx int, x double, y double, closed boolean"


def lines():
    rng = random.Random(3)
    square = [(x, 0) for x in range(40)] + [(40, y) for y in range(40)] + [(40 - x, 40) for x in range(40)] + [(0, 40 - y) for y in range(40)]
    circle = [(50 + 45 * math.cos(i / 50), 50 + 45 * math.sin(i / 50)) for i in range(int(2 * math.pi * 50))]
    noise = [(i + rng.random(), rng.random() * 9) for i in range(700)]
    shapes = [(square, True), (circle, True), (noise, False), ([(0, 0), (1, 1), (2, 0), (1, -1)], True), ([(0, 0), (5, 5)], False), ([(3, 3)] * 4, True)]
    return [(0, r, i, float(x), float(y), closed) for r, (points, closed) in enumerate(shapes) for i, (x, y) in enumerate(points)]


def check(rows, found, bound):
    by_line = {}
    for image, ring, idx, x, y, closed in rows:
        by_line.setdefault((image, ring), ([], closed))[0].append((idx, x, y))
    t = np.linspace(0, 1, 400)[:, None]
    for line, (points, closed) in by_line.items():
        points = {i: (x, y) for i, x, y in sorted(points)}
        if closed:
            points[len(points)] = points[0]
        own = sorted(((r.part, r.piece, r) for r in found if (r.image_id, r.ring) == line), key=lambda v: v[:2])
        spans = [(r.from_idx, r.to_idx) for *_, r in own]
        assert spans[0][0] == 0 and spans[-1][1] == max(points) and all(a[1] == b[0] for a, b in zip(spans, spans[1:])), line
        for *_, r in own:
            c = np.array([r[f"{k}{i}"] for i in range(4) for k in "xy"]).reshape(4, 2)
            assert tuple(c[0]) == points[r.from_idx] and tuple(c[3]) == points[r.to_idx] and r.error <= bound
            curve = (1 - t) ** 3 * c[0] + 3 * (1 - t) ** 2 * t * c[1] + 3 * (1 - t) * t * t * c[2] + t**3 * c[3]
            for i in range(r.from_idx, r.to_idx + 1):
                length = np.abs(np.diff(curve, axis=0)).sum()
                assert np.hypot(*(curve - points[i]).T).min() <= bound + length / 400, (line, i)


def test_curves_keep_their_bound(spark):
    rows = lines()
    df = spark.createDataFrame(rows, LINES).repartition(3)
    sharp = {(r.ring, r.idx) for r in cv.corners(df).collect()}
    assert {i for ring, i in sharp if ring == 0} == {0, 40, 80, 120} and not any(ring == 1 for ring, _ in sharp)
    for bound in (0.1, 1.0):
        found = cv.curves(df, bound).collect()
        check(rows, found, bound)
        assert max(r.to_idx - r.from_idx for r in found) <= cv.PART
    assert len([r for r in found if r.ring == 0]) == 4 and len([r for r in found if r.ring == 1]) < 8


def test_curves_of_contours(spark):
    rng = random.Random(5)
    blob = [(0, x, y, 0, 0, 0, max(0, min(255, 900 - 6 * ((x - 15) ** 2 + (y - 14) ** 2)))) for y in range(30) for x in range(31)]
    noise = [(1, x, y, 0, 0, 0, rng.choice((0, 90, 200, 255))) for y in range(14) for x in range(14)]
    px = spark.createDataFrame(blob + noise, "image_id long, x int, y int, r int, g int, b int, a int")
    found = cl.stored(cl.stitched(cl.segments(px)))
    check([tuple(r[c] for c in ("image_id", "ring", "idx", "x", "y", "closed")) for r in found.collect()], cv.curves(found, 0.5).collect(), 0.5)


def test_no_lines(spark):
    assert cv.curves(spark.createDataFrame([], LINES)).collect() == []


def test_parts_of_a_batch_are_fitted_together(spark, monkeypatch):
    rng = np.random.default_rng(7)
    runs = [np.cumsum(rng.random((int(n), 2)), axis=0) for n in rng.integers(2, 12, 600)]
    begin = np.cumsum([0] + [len(p) for p in runs[:-1]])
    calls, fit = [], cv.fitted
    monkeypatch.setattr(cv, "fitted", lambda p: calls.append(p.shape) or fit(p))
    first, last, control, error = cv.fitted_within(np.concatenate(runs), begin, begin + [len(p) - 1 for p in runs], 0.2)
    assert len(calls) < 70 and sum(k for k, *_ in calls) > 1000  # one call for each length and round, not for each run
    alone = [cv.fitted_within(p, np.array([0]), np.array([len(p) - 1]), 0.2) for p in runs]
    assert [list(first), list(last)] == [[i + b for b, r in zip(begin, alone) for i in r[k]] for k in (0, 1)]
    assert np.array_equal(control, np.concatenate([r[2] for r in alone])) and np.array_equal(error, np.concatenate([r[3] for r in alone]))


def test_parts_that_go_on_in_the_next_batch(spark):
    df = spark.createDataFrame(lines(), LINES).repartition(3).persist()
    whole = sorted(cv.curves(df).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(cv.curves(df).collect()) == whole and len(whole) > 100
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
