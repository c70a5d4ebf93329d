"""Operators without SQL against brute force, hand-drawn rasters, and properties."""

import json
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark import InheritableThread
from pyspark.sql import Row
from pyspark.sql import functions as F

from pixelloom.functions import numeric as nm
from pixelloom.operators import contours, everything, graph, joins, nearest, palettes, reach, sets, windows
from pixelloom.plans import shared
from pixelloom.plans.image_plan import Options, clean_halo, features, remove_background, routed, run_plan
from pixelloom.sources import formats, sinks
from pixelloom.streaming import events as ev

PX = "image_id long, x int, y int, r int, g int, b int, a int"


def raster(spark, rows, image=0):
    """A drawing: '#' is opaque black, '.' clear white, 'o' opaque red."""
    colors = {"#": (0, 0, 0, 255), ".": (255, 255, 255, 0), "o": (255, 0, 0, 255)}
    return spark.createDataFrame([(image, x, y, *colors[c]) for y, row in enumerate(rows) for x, c in enumerate(row)], PX)


def at(df):
    return {(r.x, r.y) for r in df.collect()}


def test_rounding(spark):
    v = spark.createDataFrame([(-2.5,), (2.5,), (0.5,), (300.0,)], "v double")
    found = v.select(nm.half_up(F.col("v")).alias("up"), nm.store_byte(F.col("v")).alias("even")).collect()
    assert [r.up for r in found] == [-2, 3, 1, 300] and [r.even for r in found] == [0, 2, 0, 255]


def test_medians(spark):
    df = spark.createDataFrame([(0, i) for i in (4, 1, 3, 2)], "image_id long, v int")
    assert nm.pick("v", nm.upper_middle(), ["image_id"])(df).first().v == 3


def test_components(spark):
    px = raster(spark, ["##.#", ".#.#", "...#", "#.#."]).where("a > 0").withColumn("label", F.lit(1))
    four = {(r.comp.x, r.comp.y): r.area for r in reach.component_table(px).collect()}
    assert four == {(0, 0): 3, (3, 0): 3, (0, 3): 1, (2, 3): 1}
    eight = {(r.comp.x, r.comp.y): r.area for r in reach.component_table(px, diagonal=True).collect()}
    assert eight == {(0, 0): 3, (3, 0): 4, (0, 3): 1}


def test_holes(spark):
    px = raster(spark, ["#####", "#ooo#", "#o#o#", "#ooo#", "#####"])
    assert at(reach.holes(px, F.col("r") == 255)) == {(2, 2)}
    ring = raster(spark, ["#####", "#ooo#", "#o#oo", "#oo##", "#####"])
    assert at(reach.holes(ring, F.col("r") == 255)) == {(2, 2)}


def test_border_ring_and_growth(spark):
    px = raster(spark, [".....", ".###.", ".###.", ".###.", "....."])
    mask = px.where("a > 0").select("image_id", "x", "y")
    assert at(windows.border_ring(mask)) == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} - {(2, 2)}
    grown = at(reach.grown(mask, px, 1))
    assert at(mask) < grown and (0, 1) in grown and (0, 0) not in grown
    eroded = at(windows.eroded(px, "a", 1, "v").where("v > 0"))
    assert eroded == {(2, 2)}


def test_sets(spark):
    a, b = (raster(spark, [row]).where("a > 0") for row in ("##..", ".##."))
    assert at(sets.union(a, b)) == {(0, 0), (1, 0), (2, 0)}
    assert at(sets.minus(a, b)) == {(0, 0)} and at(sets.intersection(a, b)) == {(1, 0)}


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_greedy(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(2)
    conflicts = {(i, j) for i in range(60) for j in range(i) if rng.random() < 0.08}
    kept = []
    for i in range(60):
        if not any((i, k) in conflicts for k in kept):
            kept.append(i)
    nodes = spark.range(60).selectExpr("id AS node", "id AS rank")
    edges = spark.createDataFrame([(j, i) for i, j in conflicts], "better long, worse long")
    assert sorted(r.node for r in graph.greedy(nodes, edges).where("kept").collect()) == kept


@pytest.mark.parametrize("small", [0, 100, 1 << 16])
def test_graph_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: find(v) for v in root if find(v) != v}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_event_lines(spark, tmp_path):
    lines = ['{"type":"progress","stage":"a","progress":0.5}', "not json", '{"type":"other"}', '{"type":"error","code":"E"}', ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("\n".join(lines))
    batch = formats.parsed_events(spark.read.text(str(tmp_path / "in"))).select("type", "stage", "progress", "code").collect()
    assert sorted(map(tuple, batch), key=str) == [("error", None, None, "E"), ("progress", "a", 0.5, None)]
    stream = ev.run_to_table(ev.line_stream(spark, str(tmp_path / "in")).select("type", "stage"), "append", "type")
    assert sorted(r.type for r in stream.collect()) == ["error", "progress"]
    out = formats.event_lines(spark.createDataFrame([("progress", None)], "type string, stage string")).first().value
    assert json.loads(out) == {"type": "progress"}


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (7, 5, 4), dtype=np.uint8)
    data = formats.png_file(px, 300)
    assert (formats.png_pixels(data) == px).all()
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"no image")
    info = {r.path.rsplit("/", 1)[1]: r for r in formats.image_info(formats.files(spark, str(tmp_path))).collect()}
    a = info["a.png"]
    assert (a.format, a.width, a.height, a.channels, a.has_alpha, round(a.dpi), a.size_bytes) == ("png", 5, 7, 4, True, 300, len(data))
    assert info["b.bin"].format is None
    # chunks behind a long profile count too
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    cut = data.index(b"pHYs") - 4
    plain = data[:25] + b"\x02" + data[26:cut]
    (tmp_path / "c.png").write_bytes(plain + chunk(b"iCCP", bytes(200_000)) + chunk(b"pHYs", struct.pack(">IIB", 3937, 3937, 1)) + chunk(b"tRNS", bytes(6)) + data[data.index(b"IDAT") - 4 :])
    c = formats.image_info(formats.files(spark, str(tmp_path / "c.png"))).first()
    assert (c.channels, c.has_alpha, round(c.dpi)) == (3, True, 100)
    (tmp_path / "c.png").unlink()
    rows = formats.decoded(formats.files(spark, str(tmp_path / "a.png"))).withColumn("image_id", F.lit(9).cast("long"))
    assert rows.count() == 35
    again = formats.encoded(rows).first()
    assert (formats.png_pixels(bytes(again.content)) == px).all()


def test_embedding_files(spark, tmp_path):
    a, b = np.arange(6, dtype=np.float32).reshape(2, 3), np.ones(4, np.float32)
    (tmp_path / "e.emb").write_bytes(formats.embedding_file({"model": "m"}, a, b))
    found = formats.files(spark, str(tmp_path))
    header = json.loads(formats.embedding_headers(found).first().header)
    assert header == {"model": "m", "dims": [2, 3], "posDims": [4]}
    (tmp_path / "long.emb").write_bytes(formats.embedding_file({"model": "m" * 5000}, a, b))
    (tmp_path / "none.emb").write_bytes(b"SAM")
    heads = {r.path.rsplit("/", 1)[1]: r.header and len(json.loads(r.header)["model"]) for r in formats.embedding_headers_of(spark, str(tmp_path)).collect()}
    assert heads == {"e.emb": 1, "long.emb": 5000, "none.emb": None}
    tensors = {r.tensor: (list(r.dims), list(r.data)) for r in formats.embeddings(found).collect()}
    assert tensors == {0: ([2, 3], a.ravel().tolist()), 1: ([4], b.tolist())}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string")
    sinks.write_output(df, str(tmp_path / "deep" / "er"), by=("kind",))
    assert {(r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "deep" / "er")).collect()} == {(1, "a"), (2, "b")}
    drawings = {"one": '<svg width="3">\n<path/>\n</svg>', "two": "<svg/>"}
    sinks.write_texts(spark.createDataFrame(list(drawings.items()), "name string, text string"), str(tmp_path / "svg"))
    found = {r.path.split("name=")[1].split("/")[0]: r.text for r in sinks.texts(spark, str(tmp_path / "svg" / "*")).collect()}
    assert found == {k: v + "\n" for k, v in drawings.items()}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text('{"type":"progress","stage":"a"}\n{"type":"error","code":"E"}\n{"type":"result","stage":"b"}\nnoise')
    events = ev.line_stream(spark, str(tmp_path / "in")).select("type", "stage", "code")
    sinks.event_sink(events, str(tmp_path / "log"), str(tmp_path / "state"), once=True).awaitTermination()
    read = lambda name: sorted(r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "log" / name)).collect())
    assert read("err") == ['{"type":"error","code":"E"}'] and read("out") == ['{"type":"progress","stage":"a"}', '{"type":"result","stage":"b"}']


def test_palette_merge(spark):
    rows = [(0, i, *c) for i, c in enumerate([(0, 0, 0, 10), (2, 2, 2, 5), (255, 0, 0, 8), (250, 0, 0, 2), (0, 255, 0, 1)])]
    df = spark.createDataFrame(rows, "image_id long, idx int, r int, g int, b int, cnt long")
    found = [(r.r, r.g, r.b, r.cnt) for r in palettes.agglomerated(df, 24, 8).orderBy("idx").collect()]
    assert found == [(1, 1, 1, 15), (254, 0, 0, 10), (0, 255, 0, 1)]
    assert palettes.agglomerated(df, 24, 2).count() == 2


def noise(rng, image, w, h, clear=0.3):
    return [(image, x, y, *(rng.randrange(256) for _ in "rgb"), rng.choice((0, 10)) if rng.random() < clear else rng.randrange(256)) for y in range(h) for x in range(w)]


def test_nearest_marked(spark):
    px = raster(spark, ["#..", "...", "..#"])
    found = {(r.x, r.y): (r.near.d, r.near.x, r.near.y) for r in nearest.nearest_marked(px, {"near": F.col("a") > 128}).collect()}
    assert found[(1, 0)] == (1, 0, 0) and found[(2, 1)] == (1, 2, 2) and found[(1, 1)] == (2, 0, 0)


def test_nearest_marked_ties(spark):
    """Against two sweeps over the image that take a neighbour's pixel only where it is strictly nearer: left, then up; right, then
    down. Images without any mark have none."""
    rng = random.Random(4)
    rows = [r for i in range(6) for r in noise(rng, i, 11, 9)] + [(6, x, 0, 0, 0, 0, 0) for x in range(3)]
    found = nearest.nearest_marked(spark.createDataFrame(rows, PX), {"near": F.col("a") > 225 - 20 * F.col("image_id")}, "r")
    wanted = {}
    for i in range(7):
        pixels = {(x, y): a for n, x, y, *_, a in rows if n == i}
        best = {p: (0, p) if a > 225 - 20 * i else (10**6, None) for p, a in pixels.items()}
        for order, steps in ((sorted(pixels, key=lambda p: p[::-1]), ((-1, 0), (0, -1))), (sorted(pixels, key=lambda p: p[::-1], reverse=True), ((1, 0), (0, 1)))):
            for x, y in order:
                for dx, dy in steps:
                    d, at_ = best.get((x + dx, y + dy), (10**6, None))
                    if d + 1 < best[(x, y)][0]:
                        best[(x, y)] = (d + 1, at_)
        wanted |= {(i, *p): (d, *q) if q else None for p, (d, q) in best.items()}
    colors = {r[:3]: r[3] for r in rows}
    got = found.collect()
    assert {(r.image_id, r.x, r.y): r.near and (r.near.d, r.near.x, r.near.y) for r in got} == wanted
    assert all(r.near is None or r.near.r == colors[(r.image_id, r.near.x, r.near.y)] for r in got)


def test_recovered(spark):
    rng = random.Random(8)
    rows = noise(rng, 0, 40, 3) + noise(rng, 1, 5, 5, 1.0)
    rows = [r if r[1] < 12 or r[0] else (*r[:6], r[6] % 100) for r in rows]  # nothing solid on the right: there the band ends
    source = [(*r[:3], *(rng.randrange(256) for _ in "rgb"), rng.randrange(256)) for r in rows if r[1] != 2]
    out = nearest.recovered(spark.createDataFrame(rows, PX), spark.createDataFrame(source, PX).withColumnRenamed("a", "m"))
    near = nearest.nearest_marked(spark.createDataFrame(rows, PX), {"fg": F.col("a") > 128, "bg": F.col("a") < 16}, "rgb")
    around, given = {(r.image_id, r.x, r.y): (r.fg, r.bg) for r in near.collect()}, {r[:3]: r[3:] for r in source}
    wanted, taken = {}, 0
    for *p, r, g, b, a in rows:
        new, (f, c) = given.get(tuple(p)), around[tuple(p)]
        wanted[tuple(p)] = (r, g, b, a)
        if new is None or f is None or f.d > 10:
            continue
        m = new[3] if f.d <= 6 else int(new[3] * (10 - f.d) / 4 + 0.5)
        far = lambda at_: sum((p - q) ** 2 for p, q in zip((at_.r, at_.g, at_.b), new, strict=False))  # noqa: B023, E731
        if m > a and (c is None or far(c) >= far(f)):
            wanted[tuple(p)], taken = (*new[:3], m), taken + 1
    assert {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in out.collect()} == wanted and taken > 5


def test_figure_mask(spark):
    """A red figure in the box takes its pink neighbours, but not theirs; a figure that leaves the box stays out."""
    colors = {"r": (200, 0, 0, 255), "p": (240, 60, 60, 255), "g": (0, 200, 0, 255), "c": (0, 0, 0, 0)}
    drawing = ["cccccccc", "pprrpccc", "ccrrppgg", "cccpcggg", "cccccggg"]
    px = spark.createDataFrame([(0, x, y, *colors[c]) for y, line in enumerate(drawing) for x, c in enumerate(line)], PX)
    found = {(r.x, r.y): r.ring for r in reach.figure_mask(px, (2, 1, 5, 2), bits=3).collect()}
    body, ring = [(2, 1), (3, 1), (2, 2), (3, 2), (4, 1), (4, 2), (5, 2)], [(1, 1), (3, 3)]
    assert found == dict.fromkeys(body, False) | dict.fromkeys(ring, True)


def test_remove_background(spark):
    """On a flat ground: a dark ring whose hole has the ground's colour, and a speck in the corner. On noise: the matte of its profile."""
    ground, dark = (200, 200, 200, 255), (20, 20, 20, 255)
    ring = lambda x, y: 12 <= x < 48 and 12 <= y < 48 and not (29 <= x < 31 and 29 <= y < 31)
    flat = [(0, x, y, *(dark if ring(x, y) or (x > 56 and y > 57) else ground)) for y in range(60) for x in range(60)]
    rng = random.Random(6)
    px = spark.createDataFrame(flat + noise(rng, 1, 24, 24, 0.1), PX)
    kinds = {r.image_id: r.profile for r in features(px).collect()}
    assert kinds == {0: "logo", 1: "foto"}
    kinds = routed(px, Options())
    out = remove_background(px, Options(), kinds)
    seen = {(r.x, r.y): r.a for r in out.where("image_id = 0 AND a > 0").collect()}
    inner = {(x, y) for y in range(60) for x in range(60) if ring(x, y)}
    edge = {(x, y) for x, y in inner if not {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} <= inner}
    assert seen == dict.fromkeys(inner - edge, 255)
    photo = px.where("image_id = 1")
    soft = windows.guided_alpha(photo, keep="rgb").withColumn("a", nm.clamp(nm.half_up(F.col("alpha")), 0, 255).cast("int"))
    soft = windows.snapped_alpha(soft, keep="rgb").withColumn("a", nm.half_up(F.col("alpha") * 255).cast("int")).select("image_id", "x", "y", *"rgb", "a")
    soft = windows.defringed(soft, 2).withColumn("a", F.expr("CASE WHEN a <= 13 THEN 0 WHEN a >= 217 THEN 255 ELSE a END"))
    assert sorted(map(tuple, out.where("image_id = 1").collect())) == sorted(map(tuple, windows.defringed(soft, 3).collect()))
    grown = {(r.x, r.y) for r in clean_halo(out, Options(), kinds).where("image_id = 0 AND a > 0").collect()}
    core = inner - edge
    assert grown == core | {(x + dx, y + dy) for x, y in core for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))}
    faint = clean_halo(out, Options(), kinds).where("image_id = 1").join(out.withColumnRenamed("a", "b4"), ["image_id", "x", "y"])
    assert all(r.a == (0 if r.b4 <= 9 else int(r.b4 * (r.b4 - 9) / 6 + 0.5) if r.b4 < 15 else r.b4) for r in faint.collect())


def test_enclosed_background(spark):
    """Holes of the ground's colour go, unless other pixels of that colour stand near; the ring follows the hole's own shape."""
    holes = {(30, 30), (31, 31), (31, 30), (10, 50), (13, 50), (50, 0), (59, 59)}
    px = spark.createDataFrame([(0, x, y, *((128, 128, 128) if (x, y) in holes else (0, 0, 0)), 7 if (x, y) == (59, 59) else 255) for y in range(60) for x in range(60)], PX)
    found = reach.enclosed_background(px, (128, 128, 128), other=0.002)
    assert {(r.comp.x, r.comp.y, r.area) for r in found.collect()} == {(30, 30, 3), (50, 0, 1)}
    assert reach.enclosed_background(px, (128, 128, 128)).count() == 4


def test_thin_merge(spark):
    rows = [(0, x, y, 9 if (x, y) == (1, 1) else (1 if x < 2 else 2)) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, label int")
    found = {(r.x, r.y): r.label for r in reach.merged_thin(df, [9]).collect()}
    assert found[(1, 1)] == 1 and found[(2, 1)] == 2


def test_thin_merge_ties(spark):
    """Left A, right B, up B, down A: B is the first to reach two. Clear pixels neither change nor count."""
    cross = lambda left, right, up, down: {(0, 1): left, (2, 1): right, (1, 0): up, (1, 2): down, (1, 1): 9}
    rows = [(i, x, y, v, 255) for i, votes in enumerate((("A", "B", "B", "A"), ("A", "B", "A", "B"), ("B", "A", "C", "D"))) for (x, y), v in cross(*({"A": 1, "B": 2, "C": 3, "D": 4}[v] for v in votes)).items()]
    rows += [(3, *p, v, 0 if p == (0, 1) else 255) for p, v in cross(1, 2, 3, 4).items()] + [(4, *p, v, 0 if p == (1, 1) else 255) for p, v in cross(1, 2, 3, 4).items()]
    rows += [(5, x, 0, 9 if x % 3 else 1, 255) for x in range(7)] + [(6, 0, 0, 9, 255), (6, 1, 0, None, 255)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, label int, a int")
    found = {(r.image_id, r.x, r.y): r.label for r in reach.merged_thin(df, [9]).collect()}
    assert [found[i, 1, 1] for i in range(5)] == [2, 1, 2, 2, 9]
    assert [found[5, x, 0] for x in range(7)] == [1] * 7 and found[6, 0, 0] == 9 and found[6, 1, 0] is None


def test_silent_jobs(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 2, 50), ("a", 3, 500), ("b", 4, 10), ("c", 5, 900), ("c", 6, 1000)]
    df = spark.createDataFrame([(k, seq, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for k, seq, t in rows], "job string, seq long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    wanted = {("a", 2, True), ("a", 3, False), ("b", 4, False), ("c", 5, True)}
    assert {tuple(r) for r in contours.timed_out(df, "job", 90).collect()} == wanted
    for i in range(2):  # the newest events come in a file of their own, so that the watermark has passed the limit of the others
        df.where("seq >= 5" if i else "seq < 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    found = ev.run_to_table(ev.silent(stream, "job", 90, "1 second"), "append", "job")
    assert {tuple(r) for r in found.select("job", "seq", "answered").collect()} == wanted


def test_cancel(spark):
    failed = []

    def work():
        with shared.cancellable(spark, "slow"):
            try:
                spark.range(0, 1 << 40, 1, 4).selectExpr("sum(id * id % 7)").collect()
            except Exception as e:
                failed.append(e)

    thread = InheritableThread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.2)
        shared.cancel(spark, "slow")
        if not thread.is_alive():
            break
    thread.join(10)
    assert failed and not thread.is_alive() and spark.range(5).count() == 5


def test_mask_suppression(spark):
    rng = random.Random(3)
    masks = {(i % 3, i): {(rng.randrange(20), rng.randrange(17)) for _ in range(rng.randint(5, 250))} for i in range(40)}
    for i in range(40, 60):  # close copies of others, of which the better one stays
        image, of = i % 3, i - 39 - (i - 39 - i) % 3
        base = masks[image, next(c for m, c in masks if m == image and c >= of % 30)]
        masks[image, i] = set(rng.sample(sorted(base), max(1, len(base) * 4 // 5)))
    scores = {k: rng.randrange(5) for k in masks}
    overlap = lambda a, b: len(a & b) / len(a | b)
    kept = []
    for key in sorted(masks, key=lambda k: (-scores[k], k[1])):
        if not any(k[0] == key[0] and overlap(masks[k], masks[key]) > 0.5 for k in kept):
            kept.append(key)
    px = spark.createDataFrame([(*k, x, y) for k, m in masks.items() for x, y in m], "image_id long, cand_no long, x int, y int")
    found = everything.suppressed(px, spark.createDataFrame([(*k, s) for k, s in scores.items()], "image_id long, cand_no long, score int"), 0.5)
    rows = {(r.image_id, r.cand_no): r.kept for r in found.collect()}
    assert rows == {k: k in kept for k in masks} and not all(rows.values())
    pairs = {(r.image_id, r.a, r.b): (r.common, r.joint) for r in joins.iou_pairs(px, 0.2).collect()}
    assert pairs == {(i, a, b): (len(masks[i, a] & masks[i, b]), len(masks[i, a] | masks[i, b])) for i, a in masks for j, b in masks if i == j and a < b and overlap(masks[i, a], masks[i, b]) > 0.2}


def test_smallest_box(spark):
    rng = random.Random(9)
    boxes = [(i, x, y, x + rng.randint(0, 150), y + rng.randint(0, 90)) for i in range(60) for x, y in [(rng.randint(-80, 200), rng.randint(-80, 200))]]
    points = [(rng.randint(-100, 300), rng.randint(-100, 300)) for _ in range(200)]
    inside = lambda p: [((x1 - x0) * (y1 - y0), i) for i, x0, y0, x1, y1 in boxes if x0 <= p[0] < x1 and y0 <= p[1] < y1]
    found = joins.smallest_box(spark.createDataFrame(points, "px int, py int"), spark.createDataFrame(boxes, "box_id int, x0 int, y0 int, x1 int, y1 int")).collect()
    assert sorted(map(str, found)) == sorted(map(str, ([Row(px=p[0], py=p[1], box_id=min(inside(p))[1] if inside(p) else None) for p in points])))


def test_plan(spark):
    px = raster(spark, ["......", ".####.", ".####.", ".####.", ".####.", "......"])
    out = run_plan(px, Options(matte="crisp", expand_edge=False))  # a graphic on a flat ground, whose outermost pixels go with the ground
    assert at(out.where("a > 0")) == {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert run_plan(px, Options(steps=("remove-bg", "auto-crop", "clean-halo"), hard_edge=True, contract=1)).where("a > 0").count() == 0
    try:
        run_plan(px, Options(steps=("nothing",)))
    except ValueError:
        return
    raise AssertionError


def brute_uniform(img):
    """{(x, y): alpha}: the flood of a uniform background, pixel by pixel."""
    w, h = max(x for x, _ in img) + 1, max(y for _, y in img) + 1
    border = [img[p] for x in range(w) for p in ((x, 0), (x, h - 1))] + [img[p] for y in range(h) for p in ((0, y), (w - 1, y))]
    median = [sorted(c[k] for c in border)[len(border) // 2] for k in range(3)]
    d2 = lambda c: sum((c[k] - median[k]) ** 2 for k in range(3))
    alpha = {p: c[3] for p, c in img.items()}
    if sum(a < 128 for a in alpha.values()) >= len(img) * 0.05 or sum(d2(c) < 45 * 45 for c in border) / len(border) <= 0.85:
        return alpha
    p95 = sorted(d2(c) ** 0.5 for c in border)[min(len(border) - 1, int(len(border) * 0.95))]
    tol = max(10, min(34, int(p95 * 1.3 + 0.5) + 4))
    near = lambda x, y: [p for p in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if p in img]
    todo = [p for p in img if p[0] in (0, w - 1) or p[1] in (0, h - 1)]
    while todo:
        p = todo.pop()
        if alpha[p] and d2(img[p]) < tol * tol:
            alpha[p] = 0
            todo += near(*p)
    for _ in range(2):
        for p in [p for p in img if alpha[p] and d2(img[p]) < 52 * 52 and any(alpha[q] == 0 for q in near(*p))]:
            alpha[p] = 0
    return alpha


def test_uniform_background(spark):
    rng = random.Random(7)
    images = []
    for back, noise, clear in (((250, 240, 10), 2, 0.0), ((20, 20, 30), 14, 0.01), ((128, 128, 128), 90, 0.0), ((200, 200, 200), 2, 0.2)):
        img = {}
        for x in range(16):
            for y in range(14):
                base, spread = ((back[0] // 2 + 40, 90, 60), 30) if 4 <= x <= 11 and 4 <= y <= 9 else (back, noise)
                value = [max(0, min(255, v + rng.randint(-spread, spread) + (22 if (x, y) == (3, 5) else 0))) for v in base]
                img[x, y] = (*value, 0 if rng.random() < clear else rng.randint(130, 255))
        images.append(img)
    df = spark.createDataFrame([(i, *p, *c) for i, img in enumerate(images) for p, c in img.items()], PX)
    found = {(r.image_id, r.x, r.y): r.a for r in reach.uniform_background(df).collect()}
    wanted = [brute_uniform(img) for img in images]
    assert found == {(i, *p): a for i, alpha in enumerate(wanted) for p, a in alpha.items()}
    assert [sum(alpha[p] != img[p][3] for p in img) > 30 for alpha, img in zip(wanted, images, strict=True)] == [True, True, False, False]


def brute_accents(img, palette):
    """[(y, x, area, r, g, b)] of one image, pixel by pixel."""
    d2 = lambda a, b: sum((u - v) ** 2 for u, v in zip(a[:3], b[:3], strict=True))
    far = {p for p, c in img.items() if c[3] >= 128 and all(d2(c, e) > 48 * 48 for e in palette)}
    least = max(200, int(sum(c[3] >= 128 for c in img.values()) * 0.0012 + 0.5))
    known, out = list(palette), []
    for y, x in sorted((y, x) for x, y in far):
        if (x, y) not in far:
            continue
        todo, comp = [(x, y)], []
        far.discard((x, y))
        while todo:
            p = todo.pop()
            comp.append(p)
            for q in ((p[0] - 1, p[1]), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1)):
                if q in far:
                    far.discard(q)
                    todo.append(q)
        mean = tuple(int(sum(img[p][k] for p in comp) / len(comp) + 0.5) for k in range(3))
        if len(comp) >= least and all(d2(mean, e) >= 32 * 32 for e in known):
            known.append(mean)
            out.append((y, x, len(comp), *mean))
    return out


def test_accents(spark):
    def image(w, h, parts):
        img = {(x, y): (250, 250, 250, 255) for x in range(w) for y in range(h)}
        for x0, y0, x1, y1, color in parts:
            img |= {(x, y): color(x, y) for x in range(x0, x1) for y in range(y0, y1)}
        return img

    red, blue, like_blue = (lambda x, y: (200, x, 20, 255)), (lambda x, y: (10, 20, 220, 255)), (lambda x, y: (14, 28, 200, 255))
    striped = lambda x, y: ((120, 250, 250, 255), (250, 120, 250, 255))[x % 2]  # noqa: E731  # its mean is near the palette's third colour
    palette = [(250, 250, 250), (185, 185, 250)]
    small = image(60, 50, [(2, 2, 20, 16, red), (30, 2, 45, 18, blue), (30, 25, 48, 40, like_blue), (2, 25, 12, 40, blue), (14, 20, 28, 45, striped)])
    large = image(480, 400, [(5, 5, 20, 20, red), (100, 100, 116, 115, blue)])  # 225 and 240 pixels, of which 0.12 % are 230
    df = spark.createDataFrame([(i, *p, *c) for i, img in enumerate((small, large)) for p, c in img.items()], PX)
    colors = spark.createDataFrame([(i, k, *c) for i in range(2) for k, c in enumerate(palette)], "image_id long, idx int, r int, g int, b int")
    found = reach.accents(df, colors).collect()
    wanted = [(i, *row) for i, img in enumerate((small, large)) for row in brute_accents(img, palette)]
    assert sorted((r.image_id, r.comp.y, r.comp.x, r.area, r.r, r.g, r.b) for r in found) == sorted(wanted)
    assert [sum(w[0] == i for w in wanted) for i in range(2)] == [2, 1]
