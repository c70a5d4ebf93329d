"""Box windows and stencils. Pixels are dense per image; each pass is one window over rows or columns, so an image spreads over
as many tasks as it has rows or columns. tiles_with_halo() cuts larger images into tiles with the border they need."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import luma, over
from ..functions.numeric import store_byte
from ..plans.shared import stored

IMAGE = "image_id"


def col(name: str) -> Column:
    return F.col(name)


def along(axis: str, groups: tuple[str, ...] = (IMAGE,)) -> "Window":
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*groups, other).orderBy(axis)


def sized(px: DataFrame) -> DataFrame:
    """px plus the size of its image: _w, _h and the number of pixels _n. One row for each image is joined back, so that the pixels of
    a large image need not meet in one task."""
    sizes = px.groupBy(IMAGE).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return px.join(sizes, IMAGE)


#: Pixels of a task where images are dealt to tasks whole, and of the largest image for which that is done.
TASK, SMALL = 65_536, 65_536


def tasks_of(px: DataFrame) -> int | None:
    """Tasks of about TASK pixels each, if no image has more than SMALL; else, and without pixels, None."""
    about = px.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("all"), F.max("_n").alias("most")).first()
    return None if about["all"] is None or about["most"] > SMALL else -(-about["all"] // TASK)


def by_image(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by image, or by the keys, to a number of tasks; None: as they are. Spark keeps that number in windows whose keys hold these,
    but in a join only if both sides are dealt by all of its keys."""
    return rows if tasks is None else rows.repartition(tasks, *(keys or (IMAGE,)))


def dealt(px: DataFrame) -> DataFrame:
    """px dealt by image, about TASK pixels to a task, if no image has more than SMALL: then what a task holds does not grow with the number
    of images, and windows and joins by image, row or column find their pixels where they are. Larger images spread over rows and columns."""
    return by_image(px, tasks_of(px))


#: Radius from which windows are put together from blocks; below, frames that look at each pixel of the window take less.
WIDE = 4
_KINDS = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def over_reach(px: DataFrame, axis: str, r: int, wanted: dict[str, tuple[str, str]], tasks: int | None = None) -> DataFrame:
    """px plus, for each name of wanted, the sum, min or max of a column over the pixels at most r away along an axis: {name: (kind, column)}.
    The cost of a pixel does not grow with r: rows are cut into blocks of 2 r + 1 pixels, and the values of a window are those from its
    first pixel to that block's end, and from the beginning of the block in which it ends. Where that is one block, the window begins or
    ends with what the block has of the row, and one of both is enough. Nothing is taken off again, so sums of fractions lose nothing.
    tasks: to which the rows are dealt; None, here and below: as Spark deals them."""
    if r < WIDE:
        w = along(axis).rangeBetween(-r, r)
        return px.withColumns({name: _KINDS[kind][0](value).over(w) for name, (kind, value) in wanted.items()})
    names, other = px.columns, "y" if axis == "x" else "x"
    # one exchange by row serves all windows, also where the image is a constant that the optimizer leaves out
    cut = px.withColumn("_row", F.xxhash64(IMAGE, other))
    cut = (cut.repartition("_row") if tasks is None else cut.repartition(tasks, "_row")).withColumn("_k", F.floor(col(axis) / (2 * r + 1)))
    block = Window.partitionBy("_row", IMAGE, other, "_k")
    ahead, back = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (col(axis), F.desc(axis)))
    to_here, from_here = ([f"_{side}{i}" for i in range(len(wanted))] for side in "pq")
    cut = cut.withColumns({n: _KINDS[kind][0](value).over(back) for n, (kind, value) in zip(from_here, wanted.values(), strict=True)})
    cut = cut.withColumns({n: _KINDS[kind][0](value).over(ahead) for n, (kind, value) in zip(to_here, wanted.values(), strict=True)} | {"_b": F.min(axis).over(ahead)})
    row = Window.partitionBy("_row", IMAGE, other).orderBy("_k", axis)  # the order that the blocks are in already
    every = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = cut.withColumns({"_end": F.struct("_k", *to_here), "_start": F.struct("_k", (col(axis) == col("_b")).alias("whole"), *from_here)})
    cut = cut.withColumns({"_end": F.coalesce(F.lead("_end", r).over(row), F.last("_end").over(every)), "_start": F.coalesce(F.lag("_start", r).over(row), F.first("_start").over(every))})
    found = {}
    for name, (kind, _), p, q in zip(wanted, wanted.values(), to_here, from_here, strict=True):
        begin, end = col(f"_start.{q}"), col(f"_end.{p}")
        found[name] = F.when(col("_start._k") != col("_end._k"), _KINDS[kind][1](begin, end)).when(col("_start.whole"), end).otherwise(begin)
    kept = [n for n in names if n not in wanted]
    return cut.select(*kept, *(v.alias(n) for n, v in found.items()))


def box_sums(px: DataFrame, values: list[str], r: int, tasks: int | None = None) -> DataFrame:
    """px plus, for each value, s_<value>: its sum over the box of radius r cut at the image's border, and n: the box's pixels."""
    px = px.withColumn("_1", F.lit(1).cast("long"))
    px = over_reach(px, "x", r, {f"s_{v}": ("sum", v) for v in values} | {"n": ("sum", "_1")}, tasks).drop("_1")
    return over_reach(px, "y", r, {f"s_{v}": ("sum", f"s_{v}") for v in values} | {"n": ("sum", "n")}, tasks)


def box_mean(px: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """Mean over the box, cut at the border and divided by the real number of pixels."""
    return box_sums(px, [value], r).withColumn(out, col(f"s_{value}") / col("n")).drop(f"s_{value}", "n")


def integral(px: DataFrame, value: str) -> DataFrame:
    """px plus `total`: the sum over all pixels up to and with x and y."""
    px = px.withColumn("total", F.sum(value).over(along("x").rowsBetween(Window.unboundedPreceding, 0)))
    return px.withColumn("total", F.sum("total").over(along("y").rowsBetween(Window.unboundedPreceding, 0)))


def feather(px: DataFrame, r: int) -> DataFrame:
    """Alpha averaged over the box; beyond the border the edge pixel is repeated."""
    value = "a"
    for axis in "xy":
        w, every = along(axis).rowsBetween(-r, r), along(axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.greatest(F.lit(0), r - (col(axis) - F.min(axis).over(every)))
        after = F.greatest(F.lit(0), r - (F.max(axis).over(every) - col(axis)))
        total = F.sum(value).over(w) + before * F.first(value).over(every) + after * F.last(value).over(every)
        px, value = px.withColumn("_s", total), "_s"
    return px.withColumn("a", store_byte(col("_s") / F.lit(float((2 * r + 1) ** 2)))).drop("_s")


def eroded(px: DataFrame, value: str, r: int, out: str) -> DataFrame:
    """Least value of the box, where the outside counts as 0."""
    for axis in "xy":
        px = over_reach(px.withColumn("_1", F.lit(1)), axis, r, {out: ("min", value), "_n": ("sum", "_1")})
        px = px.withColumn(out, F.when(col("_n") < 2 * r + 1, 0).otherwise(col(out))).drop("_n", "_1")
        value = out
    return px


def dilated(px: DataFrame, value: str, r: int, out: str) -> DataFrame:
    for axis in "xy":
        px = over_reach(px, axis, r, {out: ("max", value)})
        value = out
    return px


def opened(px: DataFrame, value: str, r: int, out: str) -> DataFrame:
    return dilated(eroded(px, value, r, "_e"), "_e", r, out).drop("_e")


def sobel(px: DataFrame) -> DataFrame:
    """(image_id, x, y, magnitude) of the interior pixels: |gx| + |gy| of the luma."""
    w, h = along("x"), along("y")
    px = px.withColumn("l", luma(col("r"), col("g"), col("b")))
    px = px.withColumns({"_d": F.lead("l").over(w) - F.lag("l").over(w), "_m": F.lag("l").over(w) + 2 * col("l") + F.lead("l").over(w)})
    gx = F.lag("_d").over(h) + 2 * col("_d") + F.lead("_d").over(h)
    gy = F.lead("_m").over(h) - F.lag("_m").over(h)
    return px.withColumn("magnitude", F.abs(gx) + F.abs(gy)).where("magnitude IS NOT NULL").select(IMAGE, "x", "y", "magnitude")


def unsharp(px: DataFrame, amount: float) -> DataFrame:
    """Sharpens by the four neighbours; beyond the border the pixel itself counts; invisible pixels stay."""
    a = amount / 100 * 1.2
    w, h = along("x"), along("y")
    out = {}
    for c in "rgb":
        near = [F.coalesce(f(c).over(o), col(c)) for f, o in ((F.lag, h), (F.lead, h), (F.lag, w), (F.lead, w))]
        out[c] = F.when(col("a") == 0, col(c)).otherwise(store_byte(F.lit(1 + 4 * a) * col(c) - F.lit(a) * (near[0] + near[1] + near[2] + near[3])))
    return px.select(IMAGE, "x", "y", *(v.alias(c) for c, v in out.items()), "a")


def dilated_one(px: DataFrame) -> DataFrame:
    """Each invisible pixel takes the colour of its first visible neighbour (left, right, up, down), opaque."""
    w, h = along("x"), along("y")
    seen = F.when(col("a") > 0, F.struct("r", "g", "b"))
    marked = px.withColumn("_c", seen)
    found = F.coalesce(F.lag("_c").over(w), F.lead("_c").over(w), F.lag("_c").over(h), F.lead("_c").over(h))
    grown = marked.withColumn("_n", found).withColumn("grown", (col("a") == 0) & col("_n").isNotNull())
    return grown.select(IMAGE, "x", "y", *(F.when(col("grown"), col(f"_n.{c}")).otherwise(col(c)).alias(c) for c in "rgb"), F.when(col("grown"), 255).otherwise(col("a")).alias("a"), "grown")


def touching(px: DataFrame, mark: Column) -> Column:
    """Whether one of a pixel's four neighbours is marked."""
    w, h = along("x"), along("y")
    hits = [F.coalesce(f(mark).over(o), F.lit(False)) for f in (F.lag, F.lead) for o in (w, h)]
    return hits[0] | hits[1] | hits[2] | hits[3]


def eroded_alpha(px: DataFrame, passes: int, above: int = 30) -> DataFrame:
    """Visible pixels that touch the background go, `passes` times; the image's border is no background."""
    for _ in range(passes):
        px = px.withColumn("_t", touching(px, col("a") <= above)).withColumn("a", F.when((col("a") > above) & col("_t"), 0).otherwise(col("a"))).drop("_t")
    return px


def defringed(px: DataFrame, passes: int = 2, tasks: int | None = None) -> DataFrame:
    """Edge pixels (0 < a < 250) take the mean colour of their eight neighbours with an alpha larger by more than 8, else larger;
    each pass sees the colours that the one before left."""
    return defringed_by(px, F.lit(passes), passes, tasks)


def defringed_by(px: DataFrame, passes: Column, most: int, tasks: int | None = None) -> DataFrame:
    """As defringed, with a number of passes for each image, `most` at most. Further columns stay. Where images are dealt whole, every
    two passes are written, as all would be one stage otherwise, and a task would take the memory of each pass."""
    for i in range(most):
        px = _defringed_once(by_image(px, tasks), passes > i)
        px = stored(px, "defringed") if tasks is not None and i % 2 else px
    return px


def _defringed_once(px: DataFrame, where: Column) -> DataFrame:
    names = ["r", "g", "b", "a"]
    row = F.struct(*names)
    across = px.withColumn("_0", row).withColumns({"_1": F.lag("_0").over(along("x")), "_2": F.lead("_0").over(along("x"))})
    rows = F.array("_0", "_1", "_2")
    near = across.withColumn("_r", rows).withColumns({"_u": F.lag("_r").over(along("y")), "_d": F.lead("_r").over(along("y"))})
    around = F.array_compact(F.concat(F.array("_1", "_2"), F.coalesce("_u", F.array().cast("array<struct<r:int,g:int,b:int,a:int>>")), F.coalesce("_d", F.array().cast("array<struct<r:int,g:int,b:int,a:int>>"))))
    near = near.withColumn("_n", around)
    strong, weak = F.filter("_n", lambda n: n["a"] > col("a") + 8), F.filter("_n", lambda n: n["a"] > col("a"))
    near = near.withColumn("_m", F.when(F.size(strong) > 0, strong).otherwise(weak))
    edge = where & (col("a") > 0) & (col("a") < 250) & (F.size("_m") > 0)
    mean = lambda c: (F.aggregate("_m", F.lit(0), lambda s, n: s + n[c]) / F.size("_m")).cast("int")
    return near.select(*(F.when(edge, mean(c)).otherwise(col(c)).alias(c) if c in "rgb" else col(c) for c in px.columns))


def border_ring(mask: DataFrame, groups: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    """(groups, x, y) of mask pixels with fewer than four neighbours in the mask."""
    w, h = along("x", groups), along("y", groups)
    beside = [F.coalesce(f(c).over(o) == col(c) + d, F.lit(False)) for o, c in ((w, "x"), (h, "y")) for f, d in ((F.lag, -1), (F.lead, 1))]
    inner = beside[0] & beside[1] & beside[2] & beside[3]
    return mask.withColumn("_i", inner).where("NOT _i").select(*groups, "x", "y")


def guided_alpha(px: DataFrame, r: int = 12, eps: float = (0.012 * 255) ** 2, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """(image_id, x, y, alpha, and the columns to keep): edge-aware smoothing of alpha, guided by luma: a = cov / (var + eps), b = mean
    alpha - a * mean luma, averaged."""
    px = px.withColumn("l", luma(col("r"), col("g"), col("b"))).withColumns({"ll": col("l") * col("l"), "la": col("l") * col("a"), "ad": col("a").cast("double")})
    px = box_sums(px, ["l", "ll", "la", "ad"], r, tasks)
    m = {v: col(f"s_{v}") / col("n") for v in ("l", "ll", "la", "ad")}
    slope = (m["la"] - m["l"] * m["ad"]) / (m["ll"] - m["l"] * m["l"] + F.lit(eps))
    px = px.withColumn("_a", slope).withColumn("_b", m["ad"] - col("_a") * m["l"]).drop("s_l", "s_ll", "s_la", "s_ad", "n")
    px = box_sums(px, ["_a", "_b"], r, tasks)
    found = col("s__a") / col("n") * col("l") + col("s__b") / col("n")
    return px.select(IMAGE, "x", "y", F.round(found, 4).alias("alpha"), *keep)


def snapped_alpha(px: DataFrame, solid: int = 160, r: int = 3, window: int = 9, gain: float = 10.0, keep: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """(image_id, x, y, alpha, and the columns to keep): alpha from 0 to 1, steepened about one half where a solid body (what an
    opening leaves) borders on the rest; the gain there is 1 + (gain - 1) * gate ** 2, and the gate the product of both shares of the
    window over its largest value."""
    body = opened(by_image(px, tasks).withColumn("_s", (col("a") >= solid).cast("int")), "_s", r, "_body").withColumn("_void", 1 - col("_body"))
    sums = box_sums(body, ["_body", "_void"], window, tasks)
    gate = F.least(F.lit(1.0), (col("s__body") / col("n")) * (col("s__void") / col("n")) / F.lit(0.25))
    steep = F.lit(0.5) + (col("a") / F.lit(255.0) - 0.5) * (1 + (F.lit(gain) - 1) * gate * gate)
    return sums.select(IMAGE, "x", "y", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), steep)), 6).alias("alpha"), *keep)


def distance_band(px: DataFrame, band: int, above: int = 128) -> DataFrame:
    """(image_id, x, y, d) of pixels up to `band` from a visible one, in steps of 1 and sqrt 2. On a free grid that is
    max + (sqrt 2 - 1) * min of the offsets to the nearest source, found by looking at each offset's row and column window."""
    near = px.withColumn("_v", F.when(col("a") > above, col("x")))
    w = along("x")
    left = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = near.withColumn("_dx", F.least(col("x") - left, right - col("x")))
    rows = F.collect_list(F.struct(col("y").alias("y"), col("_dx").alias("dx"))).over(along("y").rangeBetween(-band, band))
    near = near.withColumn("_rows", rows)
    step = lambda s: F.greatest(s["dx"], F.abs(s["y"] - col("y"))) + F.least(s["dx"], F.abs(s["y"] - col("y"))) * F.lit(2.0**0.5 - 1)
    d = F.array_min(F.transform(F.filter("_rows", lambda s: s["dx"].isNotNull()), step))
    return near.withColumn("d", d).where(col("d") <= band).select(IMAGE, "x", "y", F.round("d", 6).alias("d"))


def outlined(px: DataFrame, thickness: float, color: tuple[int, int, int]) -> DataFrame:
    """(image_id, x, y, r, g, b, a): the image on a coloured outline, without half-clear pixels. The band is 5 % of the longer side at
    a thickness of 100, one pixel at least; the image gets a clear margin of 1.6 bands, and keeps its coordinates."""
    t = max(0.0, min(100.0, thickness))
    sizes = px.groupBy(IMAGE).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    band = F.greatest(F.lit(1), F.floor(F.greatest("_w", "_h") * t / 100 * F.lit(0.05) + F.lit(0.5)).cast("int"))
    sizes = sizes.withColumn("_b", band).withColumn("_p", col("_b") + F.ceil(col("_b") * F.lit(0.6)).cast("int"))
    # each opaque pixel reaches the pixels of the band around it, row by row and then column by column, with the least offset kept
    reach = lambda c: F.explode(F.sequence(col(c) - col("_b"), col(c) + col("_b")))
    near = px.where(col("a") >= 128).select(IMAGE, "x", "y").join(sizes.select(IMAGE, "_b"), IMAGE)
    near = near.select(IMAGE, "_b", "y", col("x").alias("_x"), reach("x").alias("x")).groupBy(IMAGE, "_b", "x", "y").agg(F.min(F.abs(col("x") - col("_x"))).alias("_dx"))
    near = near.select(IMAGE, "_b", "x", "_dx", col("y").alias("_y"), reach("y").alias("y"))
    dy = F.abs(col("y") - col("_y"))
    steps = F.greatest(col("_dx"), dy) + F.least(col("_dx"), dy) * F.lit(0.4142136)
    near = near.where(steps <= col("_b")).select(IMAGE, "x", "y").distinct().withColumn("_in", F.lit(True))
    span = lambda side: F.explode(F.sequence(-col("_p"), col(side) + col("_p") - 1))
    grid = sizes.select(IMAGE, "_h", "_p", span("_w").alias("x")).select(IMAGE, "x", span("_h").alias("y"))
    whole = grid.join(px, [IMAGE, "x", "y"], "left").join(near, [IMAGE, "x", "y"], "left")
    a, inside = F.coalesce("a", F.lit(0)), F.coalesce("_in", F.lit(False))
    laid = [F.when(inside, over(F.coalesce(c, F.lit(0)), a, v)).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c, v in zip("rgb", color, strict=True)]
    return whole.select(IMAGE, "x", "y", *laid, F.when(inside | (a >= 128), 255).otherwise(0).alias("a"))


def bilinear(px: DataFrame, value: str, factor: int) -> DataFrame:
    """(image_id, x, y, v) on a grid `factor` times finer, sample centres aligned, edge pixels repeated."""
    sized = px.select(IMAGE, "x", "y", col(value).cast("double").alias("v"))
    for axis in "xy":
        o = along(axis)
        near = sized.withColumns({"_b": F.coalesce(F.lag("v").over(o), col("v")), "_f": F.coalesce(F.lead("v").over(o), col("v"))})
        parts = []
        for k in range(factor):
            t = (k + 0.5) / factor - 0.5
            v = col("v") + (col("_b") - col("v")) * F.lit(-t) if t < 0 else col("v") + (col("_f") - col("v")) * F.lit(t)
            parts.append(F.struct((col(axis) * factor + k).alias("p"), v.alias("v")))
        sized = near.select(IMAGE, *(c for c in "xy" if c != axis), F.inline(F.array(*parts))).withColumnRenamed("p", axis)
    return sized.select(IMAGE, "x", "y", F.round("v", 6).alias("v"))


def _convolved(px: DataFrame, value: str, weights: dict[int, float], axis: str) -> Column:
    """Weighted sum of the neighbours at the given offsets along an axis; beyond the border the edge pixel is repeated."""
    o = along(axis)
    every = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(o), F.first(value).over(every)) if k < 0 else F.coalesce(F.lead(value, k).over(o), F.last(value).over(every))
    total = F.lit(0.0)
    for k, w in sorted(weights.items()):
        total = total + at(k) * F.lit(w)
    return total


def gaussian_weights(sigma: float) -> dict[int, float]:
    """Weights of the offsets up to three sigmas, with sum 1."""
    r = math.ceil(3 * sigma)
    raw = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)}
    return {k: w / sum(raw.values()) for k, w in raw.items()}


def lanczos_weights(factor: int, phase: int, lobes: int = 3) -> dict[int, float]:
    """Weights of the offsets from a pixel for one of the `factor` finer pixels that it becomes, with sum 1."""
    t = (phase + 0.5) / factor - 0.5
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    raw = {k: sinc(k - t) * sinc((k - t) / lobes) for k in range(-lobes, lobes + 1) if abs(k - t) < lobes}
    return {k: w / sum(raw.values()) for k, w in raw.items()}


def blurred_mask(px: DataFrame, value: str, sigma: float, at: int = 128) -> DataFrame:
    """(image_id, x, y, v): 255 where the value, blurred (sigma above 0), reaches `at`, else 0."""
    v = px.select(IMAGE, "x", "y", col(value).cast("double").alias("v"))
    for axis in "xy" if sigma > 0 else "":
        v = v.withColumn("v", _convolved(v, "v", gaussian_weights(sigma), axis))
    return v.select(IMAGE, "x", "y", F.when(F.round("v", 6) >= at, 255).otherwise(0).alias("v"))


def lanczos(px: DataFrame, value: str, factor: int) -> DataFrame:
    """(image_id, x, y, v): a byte value on a grid `factor` times finer."""
    v = px.select(IMAGE, "x", "y", col(value).cast("double").alias("v"))
    for axis in "xy":
        parts = v.withColumns({f"_{k}": _convolved(v, "v", lanczos_weights(factor, k), axis) for k in range(factor)})
        fine = F.inline(F.array(*(F.struct((col(axis) * factor + k).alias("p"), col(f"_{k}").alias("v")) for k in range(factor))))
        v = parts.select(IMAGE, *(c for c in "xy" if c != axis), fine).withColumnRenamed("p", axis)
    return v.select(IMAGE, "x", "y", store_byte(F.round("v", 6)).alias("v"))


def tiled(px: DataFrame, stencil: Callable[[DataFrame], DataFrame], tile: int = 256, halo: int = 16) -> DataFrame:
    """stencil(px), tile by tile: each tile with its halo is an image of its own, so one large image spreads over tasks also where a
    stencil takes an image whole; of the results each tile's own pixels are put back. The stencil must keep the column core and
    look no further than the halo."""
    dealt = tiles_with_halo(px, tile, halo).withColumn(IMAGE, F.struct(col(IMAGE).alias("image"), "tile_x", "tile_y")).drop("tile_x", "tile_y")
    return stencil(dealt).where("core").withColumn(IMAGE, col(f"{IMAGE}.image")).drop("core")


def tiles_with_halo(px: DataFrame, tile: int = 256, halo: int = 16) -> DataFrame:
    """px repeated for each tile that needs it: tile_x, tile_y, and core (whether the pixel is the tile's own)."""
    span = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((col(c) - halo) / tile)).cast("int"), F.floor((col(c) + halo) / tile).cast("int"))
    dealt = px.withColumn("tile_x", F.explode(span("x"))).withColumn("tile_y", F.explode(span("y")))
    return dealt.withColumn("core", (F.floor(col("x") / tile) == col("tile_x")) & (F.floor(col("y") / tile) == col("tile_y")))
