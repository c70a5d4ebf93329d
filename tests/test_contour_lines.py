"""Contour lines against a walk from cell to cell."""

import random

import pytest
from pixelloom.operators import contour_lines as cl

PX = "image_id long, x int, y int, r int, g int, b int, a int"
ROUND = [(0, 0), (1, 0), (1, 1), (0, 1)]


def images(rng, n):
    rows = [(0, x, y, 0, 0, 0, max(0, min(255, 290 - 6 * ((x - 9) ** 2 + (y - 8) ** 2)))) for y in range(18) for x in range(20)]
    rows += [(1, x, y, 0, 0, 0, 255) for y in range(3) for x in range(3)] + [(2, 0, 0, 0, 0, 0, 255)]
    for i in range(n):
        values = rng.choice([(0, 255), (0, 90, 127, 128, 200, 255), (0, 0, 0, 255)])
        w, h = rng.randint(2, 12), rng.randint(2, 12)
        rows += [(3 + i, x, y, 0, 0, 0, rng.choice(values)) for y in range(h) for x in range(w)]
    return rows


def brute_lines(a):
    """a: {(x, y): alpha} -> the lines of one image, as lists of points."""
    inside = lambda p: a[p] > 127.5
    after, place = {}, {}

    def spot(p, q):
        p, q = sorted((p, q), key=lambda v: (v[1], v[0]))
        t = (127.5 - a[p]) / (a[q] - a[p])
        name = (p[1], p[0], int(q[1] > p[1]))
        place[name] = (round(p[0] + t * (q[0] - p[0]), 6), round(p[1] + t * (q[1] - p[1]), 6))
        return name

    for x, y in a:
        c = [(x + dx, y + dy) for dx, dy in ROUND]
        if not all(p in a for p in c):
            continue
        out = [i for i in range(4) if inside(c[i]) and not inside(c[(i + 1) % 4])]
        into = [i for i in range(4) if not inside(c[i]) and inside(c[(i + 1) % 4])]
        full = sum(a[p] for p in c) >= 510
        for i in out:
            j = into[0] if len(into) == 1 else (i + (1 if full else 3)) % 4
            after[spot(c[i], c[(i + 1) % 4])] = spot(c[j], c[(j + 1) % 4])
    lines, seen = [], set()
    for start in sorted(set(after) - set(after.values())):
        line = [start]
        while line[-1] in after:
            line.append(after[line[-1]])
        seen |= set(line)
        if len(line) >= 4:
            lines.append((min(line), line, False))
    for start in sorted(after):
        if start not in seen:
            line = [start]
            while after[line[-1]] != start:
                line.append(after[line[-1]])
            seen |= set(line)
            lines.append((start, line, True))
    return [([place[p] for p in line], closed) for _, line, closed in sorted(lines)]


def away(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = (dx * dx + dy * dy) ** 0.5
    return abs(dx * (p[1] - a[1]) - dy * (p[0] - a[0])) / long if long else ((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2) ** 0.5


def fewer(line, tolerance):
    if len(line) < 3:
        return line
    d = [away(p, line[0], line[-1]) for p in line[1:-1]]
    k = max(range(len(d)), key=lambda i: d[i])
    return fewer(line[: k + 2], tolerance)[:-1] + fewer(line[k + 1 :], tolerance) if d[k] > tolerance else [line[0], line[-1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_and_contours(spark, seed):
    rows = images(random.Random(seed), 50)
    found = cl.stored(cl.segments(spark.createDataFrame(rows, PX).repartition(3)))
    wanted, simple = {}, {}
    for image in {r[0] for r in rows}:
        lines = brute_lines({(r[1], r[2]): r[6] for r in rows if r[0] == image})
        for ring, (line, closed) in enumerate(lines):
            wanted |= {(image, ring, i): (*p, closed) for i, p in enumerate(line)}
            kept = fewer([*line, line[0]], 0.6)[:-1]
            if len(kept) >= 3:
                simple |= {(image, ring, i): p for i, p in enumerate(kept)}
    assert {(r.image_id, r.ring, r.idx): (r.x, r.y, r.closed) for r in cl.stitched(found).collect()} == wanted
    got = {(r.image_id, r.ring, r.idx): (r.x, r.y) for r in cl.contours(found).collect()}
    assert got == simple and len({k[:2] for k in got}) > 40


def test_no_contours(spark):
    empty = cl.segments(spark.createDataFrame([], PX))
    assert cl.contours(empty).collect() == []


def test_small_images_take_no_rounds(spark, monkeypatch):
    """Tables written on the way: one, however long the lines are."""
    written = []
    monkeypatch.setattr(cl, "stored", lambda df, name="step", store=cl.stored: written.append(name) or store(df, name))
    found = cl.segments(spark.createDataFrame(images(random.Random(3), 20), PX).repartition(3))
    assert cl.contours(found).count() > 40 and len(written) <= 2


@pytest.mark.parametrize("block", [2, 3, 8])
def test_lines_that_cross_blocks(spark, monkeypatch, block):
    rows = images(random.Random(block), 20)
    rows += [(100, x, y, 0, 0, 0, 255 * (x % 4 == 1 or y % 6 == 2)) for y in range(-9, 12) for x in range(-7, 9)]  # also left of and above 0
    found = cl.stored(cl.segments(spark.createDataFrame(rows, PX).repartition(3)))
    wanted = {(r.image_id, r.ring, r.idx): (r.x, r.y, r.closed) for r in cl.stitched(found).collect()}
    simple = sorted(cl.contours(found).collect())
    for image in (0, 3, 100):
        lines = brute_lines({(r[1], r[2]): r[6] for r in rows if r[0] == image})
        assert {k[1:]: v for k, v in wanted.items() if k[0] == image} == {(ring, i): (*p, closed) for ring, (line, closed) in enumerate(lines) for i, p in enumerate(line)}
    monkeypatch.setattr(cl, "BLOCK", block)
    monkeypatch.setattr(cl, "LONG", 9)
    lines = cl.stored(cl.stitched(found))
    assert lines.where("idx >= 9").count() > 0
    assert {(r.image_id, r.ring, r.idx): (r.x, r.y, r.closed) for r in lines.collect()} == wanted
    assert sorted(cl.contours(found).collect()) == simple
