"""Packed masks, brushes, colour filters and vignettes against plain loops."""

import math
import random

import numpy as np
import pytest
from pixelloom.operators import painting as pt
from pixelloom.operators import sets
from pyspark.sql import functions as F

PX = "image_id long, x int, y int, r int, g int, b int, a int"
MASK = "image_id long, x int, y int"
STROKES = "image_id long, stroke int, seq long, x double, y double, radius double, hardness double, flow double, mode string"


def mask_of(rng, n=400):
    return {(rng.randrange(2), rng.randint(-20, 40), rng.randint(-9, 30)) for _ in range(n)}


def test_masks_as_words_and_back(spark):
    rng = random.Random(1)
    a, b = mask_of(rng), mask_of(rng)
    wa, wb = (sets.packed(spark.createDataFrame(sorted(m), MASK)) for m in (a, b))
    pixels = lambda words: {tuple(r) for r in sets.unpacked(words).collect()}
    assert pixels(wa) == a and wa.count() < len(a)
    assert pixels(sets.packed_union(wa, wb)) == a | b
    assert pixels(sets.packed_intersection(wa, wb)) == a & b
    assert pixels(sets.packed_minus(wa, wb)) == a - b
    areas = {r.image_id: r.area for r in sets.packed_areas(wa).collect()}
    assert areas == {i: sum(p[0] == i for p in a) for i in (0, 1)}
    full = spark.range(64).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    assert sets.packed(full).head().w == -1 and sets.unpacked(sets.packed(full)).count() == 64
    assert sets.unpacked(sets.packed(full.limit(0))).count() == 0


@pytest.mark.parametrize(("width", "height"), [(7, 9), (30, 4), (1, 1)])
def test_masks_take_the_nearest_pixel(spark, width, height):
    rng = random.Random(2)
    w, h = 11, 6
    alpha = {(x, y): rng.choice((0, 127, 128, 255)) for x in range(w) for y in range(h)}
    px = spark.createDataFrame([(0, x, y, 0, 0, 0, a) for (x, y), a in alpha.items()], PX)
    sizes = spark.createDataFrame([(0, w, h)], "image_id long, w int, h int")
    wanted = {(x, y) for x in range(width) for y in range(height) if alpha[int((x + 0.5) * w / width), int((y + 0.5) * h / height)] >= 128}
    scaled = sets.mask_scaled(px, sizes, width, height)
    assert {(r.x, r.y) for r in scaled.collect()} == wanted
    found = sets.mask_component(scaled).collect()
    assert len(found) == bool(wanted)
    if wanted:
        first = min(wanted, key=lambda p: (p[1], p[0]))
        xs, ys = zip(*wanted, strict=True)
        assert tuple(found[0])[1:] == (*first, min(xs), min(ys), max(xs), max(ys), len(wanted))


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1])


def test_brushes(spark):
    rng = random.Random(3)
    px = [(0, x, y, *(rng.randrange(256) for _ in range(3)), rng.choice((0, 128, 255))) for x in range(70) for y in range(50)]
    original = [(i, x, y, 255 - r, g, b, 255 - a) for i, x, y, r, g, b, a in px]
    shapes = [(5.0, 0.0, 100.0, "erase"), (9.0, 50.0, 60.0, "restore"), (0.0, 50.0, 60.0, "erase"), (14.0, 100.0, 80.0, "erase"), (6.0, 90.0, 150.0, "restore")]
    strokes = [(0, s, k, rng.uniform(-5, 75), rng.uniform(-5, 55), *shapes[s]) for s in range(5) for k in range(1 if s == 0 else 4)]
    wanted = {}
    for (i, x, y, r, g, b, a), (*_, r0, g0, b0, a0) in zip(px, original, strict=True):
        color, alpha, touched = [float(r), float(g), float(b)], a / 255, False
        for s, (radius, hard, flow, mode) in enumerate(shapes):
            points = [(p[3], p[4]) for p in strokes if p[1] == s]
            t = min(distance((x + 0.5, y + 0.5), p, q) for p, q in zip(points, points[1:] or points)) / max(0.01, radius)
            if t >= 1:
                continue
            touched = True
            core = hard / 100 if 0 < hard < 100 else 0.0
            k = min(1.0, flow / 100) * (1.0 if t <= core else 1 - (t - core) / (1 - core))
            if mode == "erase":
                alpha *= 1 - k
            else:
                laid = a0 / 255 * k
                over = laid + alpha * (1 - laid)
                if over > 0:
                    color = [(c0 * laid + c * alpha * (1 - laid)) / over for c0, c in zip((r0, g0, b0), color, strict=True)]
                alpha = over
        wanted[x, y] = tuple(int(math.floor(round(v, 6) + 0.5)) for v in (*color, alpha * 255)) if touched else (r, g, b, a)
    found = pt.brushed(spark.createDataFrame(px, PX), spark.createDataFrame(strokes, STROKES), spark.createDataFrame(original, PX)).collect()
    assert {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in found} == wanted
    few = pt.brushed(spark.createDataFrame(px[:9], PX), spark.createDataFrame([], STROKES), spark.createDataFrame(original, PX)).collect()
    assert sorted(map(tuple, few)) == sorted(px[:9])


CHAINS = [
    [("brightness", 150.0), ("contrast", 130.0), ("saturate", 180.0), ("hue-rotate", 200.0)],
    [("grayscale", 40.0), ("sepia", 60.0), ("invert", 30.0), ("brightness", 90.0), ("contrast", 70.0)],
    [("invert", 100.0), ("invert", 100.0)],
    [],
]


@pytest.mark.parametrize("chain", CHAINS)
def test_folding_filters_changes_nothing(spark, chain):
    rng = random.Random(4)
    px = [(0, i, 0, *(rng.choice((0, 255, rng.randrange(256))) for _ in range(3)), rng.randrange(256)) for i in range(200)]
    wanted = {}
    for _, x, _, r, g, b, a in px:
        c = np.array([r, g, b]) / 255
        for name, amount in chain:
            m = np.array(pt.filter_matrix(name, amount))
            c = np.clip(m[:, :3] @ c + m[:, 3], 0, 1)
        wanted[x] = (*(int(math.floor(round(v * 255, 6) + 0.5)) for v in c), a)
    found = pt.filtered(spark.createDataFrame(px, PX), chain).collect()
    assert {r.x: (r.r, r.g, r.b, r.a) for r in found} == wanted
    assert len(pt.folded(chain)) <= len(chain)


def test_filters_that_need_no_cut_become_one():
    assert len(pt.folded([("grayscale", 40.0), ("invert", 20.0), ("brightness", 80.0)])) == 1  # sepia can be too bright
    assert len(pt.folded([("brightness", 150.0), ("contrast", 50.0), ("invert", 100.0)])) == 2
    assert np.allclose(pt.filter_matrix("hue-rotate", 0.0), pt.filter_matrix("saturate", 100.0)) and np.allclose(np.array(pt.filter_matrix("hue-rotate", 360.0))[:, :3], np.eye(3))
    with pytest.raises(ValueError):
        pt.filter_matrix("sparkle", 1)


def test_blur_spreads_over_the_border(spark):
    px = spark.createDataFrame([(0, x, y, 200, 100, 0, 255 if (x, y) == (4, 4) else 0) for x in range(9) for y in range(9)], PX)
    found = {(r.x, r.y): r for r in pt.filtered(px, [("blur", 1.0)]).collect()}
    weights = {k: v for k, v in pt.gaussian_weights(1.0).items()}
    for (x, y), r in found.items():
        a = 255 * weights.get(x - 4, 0) * weights.get(y - 4, 0)
        assert r.a == int(math.floor(round(a, 6) + 0.5)) and (a == 0 or (r.r, r.g, r.b) == (200, 100, 0))
    opaque = spark.createDataFrame([(0, x, 0, 9, 9, 9, 255) for x in range(3)], PX)
    assert [r.a for r in pt.filtered(opaque, [("blur", 1.0)]).orderBy("x").collect()][1] < 255


def test_vignette(spark):
    px = [(0, x, y, 100, 200, 50, a) for x in range(20) for y, a in ((0, 255), (1, 128), (2, 0))]
    for r in pt.vignetted(spark.createDataFrame(px, PX), 80).collect():
        inner, outer = 3 * 0.32, 20 * 0.72
        v = max(0.0, min(1.0, (math.hypot(r.x + 0.5 - 10, r.y + 0.5 - 1.5) - inner) / (outer - inner))) * 0.6
        a = (255, 128, 0)[r.y] / 255
        o = v + a * (1 - v)
        wanted = [int(math.floor(round(c * a * (1 - v) / o if o else 0, 6) + 0.5)) for c in (100, 200, 50)] + [int(math.floor(round(o * 255, 6) + 0.5))]
        assert [r.r, r.g, r.b, r.a] == wanted
