"""Windows of any radius, boxes of any size, images of any ratio, drawings, bitmaps, brushes, filters and curves against brute force."""

import random
import time

import numpy as np
import pytest
from pixelloom.operators import aggregates, drawings, everything, joins, nearest, reach, resample, windows
from pixelloom.plans import image_plan, shared
from pixelloom.plans.image_plan import features
from pyspark.sql import functions as F

PX = "image_id long, x int, y int, r int, g int, b int, a int"


@pytest.mark.parametrize("r", [1, 3, 4, 9, 40])
def test_windows_of_any_radius(spark, r):
    rng = random.Random(r)
    at = {(i, x + dx, y): rng.randint(0, 255) for i, (w, h, dx) in enumerate([(1, 1, 0), (7, 5, 0), (33, 21, -3), (9, 30, 100)]) for x in range(w) for y in range(h)}
    df = spark.createDataFrame([(*k, v) for k, v in at.items()], "image_id long, x int, y int, a int").repartition(3)
    box = {k: [at[(k[0], x, y)] for x in range(k[1] - r, k[1] + r + 1) for y in range(k[2] - r, k[2] + r + 1) if (k[0], x, y) in at] for k in at}
    key = lambda q: (q.image_id, q.x, q.y)
    assert {key(q): (q.s_a, q.n) for q in windows.box_sums(df, ["a"], r).collect()} == {k: (sum(v), len(v)) for k, v in box.items()}
    assert {key(q): q.v for q in windows.dilated(df, "a", r, "v").collect()} == {k: max(v) for k, v in box.items()}
    assert {key(q): q.v for q in windows.eroded(df, "a", r, "v").collect()} == {k: min(v) if len(v) == (2 * r + 1) ** 2 else 0 for k, v in box.items()}


def boxes_of(rng, n):
    sizes = [1, 3, 40, 700, 100_000]
    out = []
    for i in range(n):
        x, y = rng.randint(-2000, 2000), rng.randint(-2000, 2000)
        out.append((i % 2, i, x, y, x + rng.choice(sizes) - 1, y + rng.choice(sizes) - 1))
    return out


def test_boxes_of_any_size(spark):
    rows = boxes_of(random.Random(1), 160)
    df = spark.createDataFrame(rows, "image_id long, cand_no long, x0 long, y0 long, x1 long, y1 long")
    wanted = set()
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1]:
                w, h = min(p[4], q[4]) - max(p[2], q[2]) + 1, min(p[5], q[5]) - max(p[3], q[3]) + 1
                if w > 0 and h > 0:
                    area = sum((b[4] - b[2] + 1) * (b[5] - b[3] + 1) for b in (p, q))
                    wanted.add((p[0], p[1], q[1], w * h, area - w * h))
    found = joins.overlapping(df, groups=("image_id",)).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    assert joins.overlapping(df.limit(0)).collect() == []


def test_points_in_boxes_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, x0, y0, x1 + rng.choice((0, 1)), y1 + 1) for _, i, x0, y0, x1, y1 in boxes_of(rng, 120)]
    points = [(rng.randint(-2100, 2800), rng.randint(-2100, 2800)) for _ in range(300)]
    found = joins.smallest_box(spark.createDataFrame(points, "px long, py long"), spark.createDataFrame(rows, "box_id long, x0 long, y0 long, x1 long, y1 long")).collect()
    for r in found:
        inside = [((x1 - x0) * (y1 - y0), i) for i, x0, y0, x1, y1 in rows if x0 <= r.px < x1 and y0 <= r.py < y1]
        assert r.box_id == (min(inside)[1] if inside else None)
    assert len(found) == 300


def area_mean(a, tw, th):
    """Each target pixel's mean over the area that it covers, by exact fractions."""
    from fractions import Fraction

    h, w = a.shape[:2]
    out = {}
    for ty in range(th):
        for tx in range(tw):
            total = [Fraction(0)] * 4
            for y in range(h * ty // th, -(-h * (ty + 1) // th)):
                for x in range(w * tx // tw, -(-w * (tx + 1) // tw)):
                    part = (min(Fraction(x + 1), Fraction(w * (tx + 1), tw)) - max(Fraction(x), Fraction(w * tx, tw))) * (min(Fraction(y + 1), Fraction(h * (ty + 1), th)) - max(Fraction(y), Fraction(h * ty, th)))
                    alpha = int(a[y, x, 3])
                    for c in range(3):
                        total[c] += part * int(a[y, x, c]) * alpha
                    total[3] += part * alpha
            colors = [round(t / total[3]) if total[3] else 0 for t in total[:3]]
            out[(tx, ty)] = (*colors, round(total[3] * tw * th / (w * h)))
    return out


def as_rows(image, a):
    return [(image, x, y, *map(int, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]


def test_shrinking_by_area(spark):
    rng = np.random.default_rng(3)
    images = {0: rng.integers(0, 256, (23, 40, 4)), 1: rng.integers(0, 256, (31, 17, 4)), 2: rng.integers(0, 256, (6, 16, 4)), 3: np.zeros((40, 1, 4), int)}
    images[0][:, :, 3] = rng.choice([0, 128, 255], (23, 40))
    df = spark.createDataFrame([r for i, a in images.items() for r in as_rows(i, a)], PX).repartition(3)
    found = {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in resample.shrunken(df, 16).collect()}
    wanted = {(2, x, y): (r, g, b, a) for _, x, y, r, g, b, a in as_rows(2, images[2])}
    for i, (tw, th) in ((0, (16, 9)), (1, (9, 16)), (3, (1, 16))):
        wanted |= {(i, *k): v for k, v in area_mean(images[i], tw, th).items()}
    assert found == wanted


def test_a_large_image_has_the_profile_of_its_small_twin(spark):
    """Each pixel of the small image is a square of the large one."""
    small = spark.range(250 * 200).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % 250).cast("int").alias("x"), F.floor(F.col("id") / 250).cast("int").alias("y"))
    inner = F.col("x").between(60, 180) & F.col("y").between(50, 150)
    noise = lambda k: (F.col("x") * k + F.col("y") * 13) % 97 + 80
    small = small.select("*", *(F.when(inner, noise(k)).otherwise(250).cast("int").alias(c) for k, c in ((7, "r"), (11, "g"), (5, "b"))), F.lit(255).alias("a"))
    eight = F.array(*map(F.lit, range(8)))
    large = small.withColumn("dx", F.explode(eight)).withColumn("dy", F.explode(eight)).select("image_id", (F.col("x") * 8 + F.col("dx")).alias("x"), (F.col("y") * 8 + F.col("dy")).alias("y"), *"rgba")
    twin = resample.shrunken(large, 250)
    assert twin.exceptAll(small).isEmpty() and small.exceptAll(twin).isEmpty()
    reduced = resample.shrunken(large)
    assert reduced.agg(F.max("x"), F.max("y")).head()[:] == (255, 204)
    assert features(large).collect() == features(reduced).collect()


@pytest.mark.parametrize("scale", [0.3, 1.0, 2.0, 2.6])
def test_lanczos_by_any_ratio(spark, scale):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (7, 10))

    def axis(v, n, m):
        step = n / m
        wide = max(1.0, step)
        out = np.zeros((m, v.shape[1]))
        for t in range(m):
            centre = (t + 0.5) * step - 0.5
            places = np.arange(int(np.floor(centre - 3 * wide)) - 1, int(np.ceil(centre + 3 * wide)) + 2)
            d = (places - centre) / wide
            k = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
            out[t] = (v[np.clip(places, 0, n - 1)] * k[:, None]).sum(axis=0) / k.sum()
        return out

    tw, th = (max(1, int(np.floor(v * scale + 0.5))) for v in (10, 7))
    wanted = np.clip(np.rint(np.round(axis(axis(a.T.astype(float), 10, tw).T, 7, th), 6)), 0, 255)
    df = spark.createDataFrame([(0, x, y, int(a[y, x])) for y in range(7) for x in range(10)], "image_id long, x int, y int, a int")
    found = {(r.x, r.y): r.v for r in resample.lanczos_scaled(df, "a", scale).collect()}
    assert found == {(x, y): int(wanted[y, x]) for y in range(th) for x in range(tw)}
    if scale == 2.0:
        assert found == {(r.x, r.y): r.v for r in windows.lanczos(df, "a", 2).collect()}


def test_drawings(spark):
    text = '<?xml?><SVG width="9">\n<defs><linearGradient id="g"/><path fill="red"/></defs><path fill="#F00" d="M0"/><PATH style="stroke:1;fill: rgb(255,0,0);x:2"/><rect fill="url(#g)"/><circle fill="#00f"><title>a > b</title></circle><path d="1"/><text fill="red">no</text><rect fill="blue" a="1"/></svg>tail'
    rows = [(1, text), (2, "no drawing"), (3, "<svg></svg>"), (4, None), (5, '<svg><path fill="none"/></svg>'), (6, "</svg><svg>"), (7, "<svg>" + "<path fill='x' d='" + "1" * 50_000 + "'/></svg>")]
    df = spark.createDataFrame(rows, "doc_id long, svg string")
    found = {r.doc_id: (r.grouped, r.runs) for r in drawings.grouped(df).collect()}
    head = '<SVG width="9"><defs><linearGradient id="g"/><path fill="red"/></defs>'
    body = '<g id="capa-1" data-color="#ff0000" fill="#ff0000"><path/><path d="M0"/><PATH style="stroke:1;x:2"/></g><g id="capa-2"><rect fill="url(#g)"/></g><g id="capa-3" data-color="#0000ff" fill="#0000ff"><circle><title>a > b</title></circle></g><g id="capa-4"><path d="1"/></g><g id="capa-5" data-color="#0000ff" fill="#0000ff"><rect a="1"/></g></svg>'
    assert found[1] == (head + body, 5) and found[5][1] == found[7][1] == 1
    assert all(found[i] == (t, 0) for i, t in rows if i in (2, 3, 4, 6))
    assert [tuple(r) for r in drawings.color_counts(df).where("doc_id = 1").orderBy("pos").collect()] == [(1, 0, "#ff0000", 3), (1, 1, "#0000ff", 2)]
    edits = [(1, 0, "#ff0000", "#010203", None), (1, 1, "#010203", "#0a0b0c", False), (1, 2, "#0000ff", None, True), (1, 3, "#0000ff", "#ffffff", None), (9, 0, "#ff0000", None, True)]
    changed = drawings.edited(drawings.grouped(df).drop("svg"), spark.createDataFrame(edits, "doc_id long, step int, color string, to string, remove boolean"))
    out = {r.doc_id: r.edited for r in changed.collect()}
    assert out[1] == (head + body).replace('data-color="#ff0000" fill="#ff0000"', 'data-color="#0a0b0c" fill="#0a0b0c"').replace('<g id="capa-3" data-color="#0000ff" fill="#0000ff"><circle><title>a > b</title></circle></g>', "").replace('<g id="capa-5" data-color="#0000ff" fill="#0000ff"><rect a="1"/></g>', "")
    assert all(out[i] == found[i][0] for i in (2, 3, 4, 5, 6, 7))


def test_time_does_not_grow_with_the_radius(spark):
    px = spark.range(400 * 400).select(F.lit(0).cast("long").alias("image_id"), (F.col("id") % 400).cast("int").alias("x"), F.floor(F.col("id") / 400).cast("int").alias("y"), (F.col("id") % 251).cast("int").alias("a"))

    def took(r):
        begin = time.perf_counter()
        windows.box_sums(px, ["a"], r).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    took(4)
    assert min(took(96) for _ in range(3)) < 2 * min(took(4) for _ in range(3)) + 0.5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_masks_by_hash(spark):
    """Ties and numbers of any size; pixels are neither sorted before they meet nor sent to all tasks."""
    big = 2**63 - 1
    rows = [(5, 2**62, 1, 1), (2**62, 2**62, 1, 1), (big, 7, 1, 1), (3, big, 2, 2), (2, big, 2, 2), (9, -4, 3, 2), (8, -4, 3, 2), (1, -3, 3, 2)]
    first = joins.first_of(spark.createDataFrame(rows, "cand_no long, pos long, x int, y int"))
    assert {(r.x, r.y): r.cand_no for r in first.collect()} == {(x, y): min((p, c) for c, p, *at in rows if at == [x, y])[1] for *_, x, y in rows}
    boxes = boxes_of(random.Random(5), 30)
    boxes = [(c, x0 % 20, y0 % 20, x0 % 20 + (x1 - x0) % 9, y0 % 20 + (y1 - y0) % 7) for _, c, x0, y0, x1, y1 in boxes]
    masks = joins.box_pixels(spark.createDataFrame(boxes, "cand_no long, x0 long, y0 long, x1 long, y1 long"))
    wanted = {}
    for c, x0, y0, x1, y1 in boxes:
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                wanted[x, y] = min(wanted.get((x, y), (big, big)), ((x1 - x0 + 1) * (y1 - y0 + 1), c))
    smallest = joins.smallest_label(masks)
    assert {(r.x, r.y): r.cand_no for r in smallest.collect()} == {k: c for k, (_, c) in wanted.items()}
    for df in (first, smallest):
        assert "SortAggregate" not in plan_of(df) and "Broadcast" not in plan_of(df)


@pytest.mark.parametrize("above", [0.2, 0.45])
def test_masks_in_blocks_and_rounds(spark, monkeypatch, above):
    """Masks of one word and of several, in blocks and rounds of a few, against brute force; candidates for suppression are not all pairs."""
    monkeypatch.setattr(joins, "BLOCK", 4)
    monkeypatch.setattr(everything, "FIRST", 5)
    rng = random.Random(11)
    masks = {}
    for i in range(120):
        side, dx, dy = rng.choice([(8, 0, 0), (8, 0, 0), (8, 8, 0), (13, -3, 2)])
        masks[i % 3, i] = {(x + dx, y + dy) for x in range(side) for y in range(side) if rng.random() < 0.6} or {(dx, dy)}
    for i in range(120, 140):
        masks[i % 3, i] = set(masks[i % 3, i - 120])  # copies
    scores = {k: rng.choice([None, 0.5, 1.5, rng.random()]) for k in masks}
    overlap = lambda a, b: len(a & b) / len(a | b)
    kept = []
    for key in sorted(masks, key=lambda k: (scores[k] is not None, -(scores[k] or 0), k[1])):
        if not any(k[0] == key[0] and overlap(masks[k], masks[key]) > above for k in kept):
            kept.append(key)
    px = spark.createDataFrame([(*k, x, y) for k, m in masks.items() for x, y in m], "image_id long, cand_no long, x int, y int").repartition(5)
    seen, real = [], everything.greedy
    monkeypatch.setattr(everything, "greedy", lambda nodes, clash: seen.append(clash.count()) or real(nodes, clash))
    found = everything.suppressed(px, spark.createDataFrame([(*k, s) for k, s in scores.items()], "image_id long, cand_no long, score double"), above)
    assert {(r.image_id, r.cand_no): r.kept for r in found.collect()} == {k: k in kept for k in masks}
    wanted = {(i, a, b): (len(masks[i, a] & masks[i, b]), len(masks[i, a] | masks[i, b])) for i, a in masks for j, b in masks if i == j and a < b and overlap(masks[i, a], masks[i, b]) > above}
    rows = joins.iou_pairs(px, above).collect()
    assert {(r.image_id, r.a, r.b): (r.common, r.joint) for r in rows} == wanted and len(rows) == len(wanted)
    assert seen and sum(seen) < len(wanted)


def test_equal_boxes(spark, monkeypatch):
    """Many copies of few boxes: cells hold each different box once, and pairs come in blocks."""
    monkeypatch.setattr(joins, "EQUAL", 3)
    rng = random.Random(4)
    few = [(i, x0, y0, x0 + w, y0 + h) for i, x0, y0, w, h in ((rng.randrange(2), rng.randrange(40), rng.randrange(40), rng.choice([0, 5, 70]), rng.randrange(9)) for _ in range(9))]
    rows = [(b[0], c, *b[1:]) for c, b in enumerate(rng.choices(few, k=90))]
    rng.shuffle(rows)
    found = joins.overlapping(spark.createDataFrame(rows, "image_id long, cand_no long, x0 long, y0 long, x1 long, y1 long"), groups=("image_id",))
    wanted = {}
    for p in rows:
        for q in rows:
            w, h = min(p[4], q[4]) - max(p[2], q[2]) + 1, min(p[5], q[5]) - max(p[3], q[3]) + 1
            if p[0] == q[0] and p[1] < q[1] and w > 0 and h > 0:
                wanted[p[0], p[1], q[1]] = (w * h, sum((b[4] - b[2] + 1) * (b[5] - b[3] + 1) for b in (p, q)) - w * h)
    got = found.collect()
    assert {(r.image_id, r.a, r.b): (r.common, r.joint) for r in got} == wanted and len(got) == len(wanted)
    assert "collect_list" in plan_of(found)


def test_small_images_are_dealt_by_their_pixels(spark, monkeypatch):
    monkeypatch.setattr(windows, "TASK", 100)
    rows = [(i, x, y, i, x, y, (i * x + y) % 256) for i in range(40) for x in range(5) for y in range(6)]
    df = spark.createDataFrame(rows, PX).repartition(3)
    tasks = windows.dealt(df)
    assert tasks.rdd.getNumPartitions() == 12 and sorted(map(tuple, tasks.collect())) == sorted(rows)
    assert nearest.nearest_marked(windows.sized(tasks), {"n": F.col("a") > 9}).rdd.getNumPartitions() == 12  # not put together again
    assert windows.dealt(df.limit(0)).count() == 0
    whole = sorted(nearest.recovered(df, df.withColumn("m", F.col("g"))).collect())
    monkeypatch.setattr(windows, "SMALL", 29)
    assert windows.dealt(df).rdd.getNumPartitions() == 3  # a larger image spreads over rows and columns
    assert sorted(nearest.recovered(df, df.withColumn("m", F.col("g"))).collect()) == whole and len(whole) == len(rows)


def test_features_sort_an_image_once(spark):
    """The border's pixels are looked at once, not once for each channel's median and again for what is near to them."""
    rows = [(i, x, y, (i * x) % 256, (x * y) % 256, y, 255) for i in range(6) for x in range(9) for y in range(8)]
    df = spark.createDataFrame(rows, PX).repartition(3)
    plan = aggregates.border_uniformity(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 1 and plan.count("LogicalRDD") == 2
    for r in aggregates.border_median(df).collect():
        sides = [(x, y) for x in range(9) for y in (0, 7)] + [(x, y) for x in (0, 8) for y in range(8)]
        own = {(q[1], q[2]): q[3:6] for q in rows if q[0] == r.image_id}
        assert tuple(r)[1:] == tuple(sorted(own[p][k] for p in sides)[len(sides) // 2] for k in range(3))


def test_ways_of_a_batch_shrink_it_once(spark):
    rows = [(i, x, y, (i * x * 40) % 256, (x * y) % 256, y, 255) for i in range(6) for x in range(9) for y in range(8)]
    kinds = image_plan.routed(spark.createDataFrame(rows, PX).repartition(3), image_plan.Options())
    assert sorted(r.image_id for r in kinds.collect()) == list(range(6))
    plan = features(spark.createDataFrame(rows, PX))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Union" not in plan  # the features read what was shrunken and written


def test_a_batch_is_dealt_by_its_images(spark, monkeypatch):
    """Graphics, which lose their ground, and photos, whose alpha is a matte: no step's task holds more pixels because there are more images."""
    rng = random.Random(8)
    inner = lambda x, y: 0 < x < 5 and 0 < y < 4
    rows = [(i, x, y, *((200, 200, 200) if i % 2 and not inner(x, y) else (30, 60, 90) if i % 2 else (rng.randrange(256) for _ in range(3))), 255 if i % 2 else rng.randrange(256)) for i in range(120) for x in range(6) for y in range(5)]
    df = spark.createDataFrame(rows, PX).repartition(3)
    options = image_plan.Options(background=(255, 255, 255))
    written = []

    def noted(df, name="step"):
        written.append((name, shared.stored(df, name)))
        return written[-1][1]

    for module in (image_plan, reach, windows):
        monkeypatch.setattr(module, "stored", noted)
    monkeypatch.setattr(windows, "TASK", 100)
    whole = sorted(map(tuple, image_plan.run_plan(df, options).collect()))
    held = {}
    for name, t in written:
        if "x" in t.columns:
            files = t.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] or 0
            held[name] = max(files, held.get(name, 0))
    assert {"shrunken", "profiled", "runs", "comps", "defringed", "removed", "haloed"} <= set(held)
    assert max(held.values()) <= 450, held  # of 3,600 pixels, in four tasks otherwise
    monkeypatch.setattr(windows, "SMALL", 29)
    assert sorted(map(tuple, image_plan.run_plan(df, options).collect())) == whole and len({r[0] for r in whole}) == 120
