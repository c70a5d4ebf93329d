"""Reachability on rasters. Equal neighbours in a row are runs; runs of adjacent rows that touch are edges; components of that
graph (far smaller than the pixels) are found by ranges of rows. Floods are the components that hold a seed. Joins of runs and pixels
are shuffles by hint: files of coordinates are so much smaller than their rows that Spark would send them to all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import bucket_key, despilled, distance2, key_alpha
from ..functions.numeric import clamp, half_up, percentile_95, pick, upper_middle
from ..plans.shared import discard, stored
from .graph import components, greedy
from .joins import nearest
from .windows import IMAGE, by_image, sized, touching


def col(name: str) -> Column:
    return F.col(name)


def _runs(px: DataFrame, label: str) -> DataFrame:
    """px plus _x0, the first pixel of the run of equal labels that each pixel is in; written."""
    w = Window.partitionBy(IMAGE, "y").orderBy("x")
    fresh = F.when((F.lag("x").over(w) == col("x") - 1) & F.lag(label).over(w).eqNullSafe(col(label)), 0).otherwise(1)
    return stored(px.withColumn("_fresh", fresh).withColumn("_x0", F.max(F.when(col("_fresh") == 1, col("x"))).over(w)).drop("_fresh"), "runs")


def _run_roots(run: DataFrame, label: str, diagonal: bool, tasks: int | None = None) -> DataFrame:
    """(_image_id, _y, _x, _root): the first pixel of a run, and of its component; of runs (image_id, y, label, _x0, _x1). Runs that begin
    their component are left out."""
    node = F.struct(col(IMAGE).alias("image_id"), col("y").alias("y"), col("_x0").alias("x"))
    reach = 1 if diagonal else 0
    below = run.select(col(IMAGE), (col("y") + 1).alias("y"), col(label), node.alias("above"), col("_x0").alias("_u0"), col("_x1").alias("_u1"))
    at = (IMAGE, "y", label)
    met = by_image(run, tasks, *at).join(by_image(below, tasks, *at).hint("merge"), list(at)).where((col("_x0") <= col("_u1") + reach) & (col("_u0") <= col("_x1") + reach))
    found = components(met.select(node.alias("a"), col("above").alias("b")))
    found = found.select(*(col(f"node.{c}").alias(f"_{c}") for c in ("image_id", "y", "x")), F.struct("root.y", "root.x").alias("_root"))
    return by_image(found, tasks, "_image_id", "_y", "_x")


def labelled(px: DataFrame, label: str = "label", diagonal: bool = False, tasks: int | None = None) -> DataFrame:
    """px plus comp, a struct (y, x) of each component's first pixel. Pixels of one label that touch are one component. tasks, here and
    below: to which images are dealt whole, if they are small."""
    runs = by_image(_runs(by_image(px, tasks), label), tasks, IMAGE, "y", "_x0")
    roots = _run_roots(runs.groupBy(IMAGE, "y", label, "_x0").agg(F.max("x").alias("_x1")), label, diagonal, tasks)
    joined = runs.join(roots.hint("merge"), (col(IMAGE) == col("_image_id")) & (runs["y"] == col("_y")) & (col("_x0") == col("_x")), "left")
    return joined.withColumn("comp", F.coalesce("_root", F.struct(runs["y"].alias("y"), col("_x0").alias("x")))).select(*px.columns, "comp")


def component_table(px: DataFrame, label: str = "label", diagonal: bool = False) -> DataFrame:
    """(image_id, comp, label, area, x0, y0, x1, y1)"""
    return labelled(px, label, diagonal).groupBy(IMAGE, "comp", label).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )


def reached(px: DataFrame, seeds: Column, diagonal: bool = False) -> DataFrame:
    """Of px (all passable), the pixels whose component holds a seed."""
    return with_reach(px, F.lit(True), seeds, diagonal).where("hit").select(*px.columns)


def with_reach(px: DataFrame, passable: Column, seeds: Column, diagonal: bool = False, tasks: int | None = None) -> DataFrame:
    """px plus hit: whether a pixel is passable and its component of passable pixels holds a seed. Seeds, components and flags are those of
    runs, far fewer than pixels; pixels are written once and get their run's flag."""
    run_at = (IMAGE, "y", "_x0")  # which tells a run, whatever its label
    runs = by_image(_runs(by_image(px, tasks).withColumn("_open", F.when(passable, 1)).withColumn("_seed", seeds), "_open"), tasks, *run_at)
    run = by_image(stored(runs.where("_open = 1").groupBy(IMAGE, "y", "_open", "_x0").agg(F.max("x").alias("_x1"), F.max("_seed").alias("_seed")), "runs"), tasks, *run_at)
    roots = _run_roots(run, "_open", diagonal, tasks)
    joined = run.join(roots.hint("merge"), (col(IMAGE) == col("_image_id")) & (run["y"] == col("_y")) & (col("_x0") == col("_x")), "left")
    rooted = joined.select(IMAGE, run["y"].alias("y"), "_x0", "_seed", F.coalesce("_root", F.struct(run["y"].alias("y"), col("_x0").alias("x"))).alias("_root"))
    rooted = by_image(rooted, tasks, IMAGE, "_root")
    found = rooted.where("_seed").select(IMAGE, "_root").distinct()
    flags = rooted.join(found.hint("merge"), [IMAGE, "_root"], "left_semi").select(*run_at, F.lit(True).alias("_hit"))
    return runs.join(by_image(flags, tasks, *run_at).hint("merge"), list(run_at), "left").select(*px.columns, F.coalesce("_hit", F.lit(False)).alias("hit"))


def on_border(px: DataFrame) -> DataFrame:
    """px plus edge: whether a pixel is on its image's border."""
    edge = (col("x") == 0) | (col("y") == 0) | (col("x") == col("_w") - 1) | (col("y") == col("_h") - 1)
    return sized(px).select(*px.columns, edge.alias("edge"))


def flood_color(px: DataFrame, seed: tuple[int, int], near: int = 12, fringe: int = 95) -> DataFrame:
    """(image_id, x, y, ring): pixels in reach of the seed within `near` of its colour, then once the neighbours within `fringe`."""
    at = px.where((col("x") == seed[0]) & (col("y") == seed[1])).select(IMAGE, *(col(c).alias(f"_{c}") for c in "rgb"))
    d2 = distance2([col(c) for c in "rgb"], [col(f"_{c}") for c in "rgb"])
    px = stored(px.join(at, IMAGE).withColumn("_d2", d2).select(IMAGE, "x", "y", "_d2"), "distances")
    core = reached(px.where(col("_d2") < near * near), (col("x") == seed[0]) & (col("y") == seed[1])).select(IMAGE, "x", "y", F.lit(True).alias("core"))
    marked = px.join(core.hint("merge"), [IMAGE, "x", "y"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    ringed = marked.withColumn("ring", touching(marked, col("core")) & ~col("core") & (col("_d2") < fringe * fringe))
    return ringed.where("core OR ring").select(IMAGE, "x", "y", "ring")


def flood_border(px: DataFrame, background: tuple[int, int, int], solid: float, cut: float) -> DataFrame:
    """(image_id, x, y, r, g, b, a): what the border reaches through pixels nearer than `cut` to the background fades and loses its
    tint. Each pixel is judged by its own colour, so the order of the flood does not matter. Pixels that stop the flood stay."""
    d = F.sqrt(distance2([col(c) for c in "rgb"], [F.lit(v) for v in background]).cast("double"))
    joined = with_reach(on_border(px).withColumn("_d", d), col("_d") < cut, col("edge")).withColumn("_k", key_alpha(col("_d"), solid, cut))
    joined = joined.withColumn("_a", half_up(col("_k") * 255))
    clear = col("hit") & (col("_a") < col("a"))
    parts = [F.when(clear, despilled(col(c), col("_k"), F.lit(v))).otherwise(col(c)).alias(c) for c, v in zip("rgb", background, strict=True)]
    return joined.select(IMAGE, "x", "y", *parts, F.when(clear, col("_a")).otherwise(col("a")).alias("a"))


def whole_border(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b) of every pixel of each side; corners count on both sides."""
    sides = [(col(c) == v).cast("int") for c, end in (("x", "_w"), ("y", "_h")) for v in (F.lit(0), col(end) - 1)]
    times = sized(px).select(IMAGE, *"rgb", sum(sides[1:], sides[0]).alias("_times")).where("_times > 0")
    return times.select(IMAGE, *"rgb", F.explode(F.array_repeat(F.lit(1), col("_times"))).alias("_side")).drop("_side")


def uniform_background(px: DataFrame, clear: float = 0.05, uniform: float = 0.85) -> DataFrame:
    """(image_id, x, y, a): of images with less than `clear` transparent pixels and more than `uniform` of the border within 45 of
    its median colour, what the border reaches within a tolerance measured on it goes, then two passes of neighbours within 52.
    All else keeps its alpha."""
    border = stored(whole_border(px), "border")
    parts = [pick(c, upper_middle(), [IMAGE])(border.select(IMAGE, c)).withColumnRenamed(c, f"m{c}") for c in "rgb"]
    median = stored(parts[0].join(parts[1], IMAGE).join(parts[2], IMAGE), "median")
    d2 = distance2([col(c) for c in "rgb"], [col(f"m{c}") for c in "rgb"])
    far = border.join(median, IMAGE).select(IMAGE, F.sqrt(d2.cast("double")).alias("d"))
    near = far.groupBy(IMAGE).agg((F.count_if(col("d") < 45) / F.count(F.lit(1))).alias("near"))
    p95 = pick("d", percentile_95(), [IMAGE])(far)
    opaque = px.groupBy(IMAGE).agg((F.count_if(col("a") < 128) / F.count(F.lit(1))).alias("clear"))
    fit = near.join(opaque, IMAGE).where((col("near") > uniform) & (col("clear") < clear)).join(p95, IMAGE).join(median, IMAGE)
    fit = fit.select(IMAGE, "mr", "mg", "mb", clamp(half_up(col("d") * 1.3) + 4, 10, 34).alias("tol"))
    # images that don't fit have no distance, so that every comparison with it fails
    px = on_border(px).join(fit, IMAGE, "left").select(IMAGE, "x", "y", "a", "edge", "tol", d2.alias("d2"))
    px = with_reach(px, (col("a") != 0) & (col("d2") < col("tol") * col("tol")), col("edge")).withColumn("a", F.when(col("hit"), 0).otherwise(col("a")))
    for _ in range(2):
        px = px.withColumn("_t", touching(px, col("a") == 0)).withColumn("a", F.when((col("a") > 0) & col("_t") & (col("d2") < 52 * 52), 0).otherwise(col("a")))
    return px.select(IMAGE, "x", "y", "a")


def accents(px: DataFrame, palette: DataFrame, least: int = 200, share: float = 0.0012) -> DataFrame:
    """(image_id, comp, area, r, g, b): components of opaque pixels further than 48 from every palette colour (idx, r, g, b), of at
    least `least` pixels and `share` of the opaque ones, with their mean colour, if that is 32 or more from the palette and from
    those taken before it, in the order of first pixels. Images without palette take any colour."""
    opaque = stored(px.where(col("a") >= 128).select(IMAGE, "x", "y", *"rgb"), "opaque")
    bare = opaque.join(palette.select(IMAGE).distinct(), IMAGE, "left_anti")
    far = nearest(opaque, palette).where(col("d2") > 48 * 48).select(*opaque.columns).unionByName(bare).withColumn("_one", F.lit(1))
    groups = labelled(far, "_one").groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("area"), *(half_up(F.avg(c)).alias(c) for c in "rgb"))
    totals = opaque.groupBy(IMAGE).agg(F.greatest(F.lit(least), half_up(F.count(F.lit(1)) * share)).alias("_least"))
    large = stored(groups.join(totals, IMAGE).where(col("area") >= col("_least")).select(IMAGE, "comp", "area", *"rgb"), "large")
    d2 = distance2([col(c) for c in "rgb"], [col(f"_{c}") for c in "rgb"])
    known = large.join(palette.select(IMAGE, *(col(c).alias(f"_{c}") for c in "rgb")), IMAGE).where(d2 < 32 * 32).select(IMAGE, "comp")
    fresh = stored(large.join(known, [IMAGE, "comp"], "left_anti"), "fresh")
    node = F.struct(IMAGE, "comp").alias("node")
    # colours nearer than 32 lie in the same cell of side 32 or in one beside it
    cells = [F.floor(col(c) / 32) for c in "rgb"]
    other = fresh.select(IMAGE, col("comp").alias("_comp"), *(col(c).alias(f"_{c}") for c in "rgb"), *(v.alias(f"_c{c}") for c, v in zip("rgb", cells, strict=True)))
    near = fresh
    for c, v in zip("rgb", cells, strict=True):
        near = near.withColumn(f"_c{c}", F.explode(F.sequence(v - 1, v + 1)))
    clash = near.join(other, [IMAGE, "_cr", "_cg", "_cb"]).where((col("comp") < col("_comp")) & (d2 < 32 * 32))
    clash = clash.select(node.alias("better"), F.struct(col(IMAGE), col("_comp").alias("comp")).alias("worse"))
    kept = greedy(fresh.select(node, node.alias("rank")), clash).where("kept").select(f"node.{IMAGE}", "node.comp")
    return fresh.join(kept, [IMAGE, "comp"], "left_semi")


def flood_same(px: DataFrame, seed: tuple[int, int], tolerance: float) -> DataFrame:
    """(image_id, x, y): contiguous visible pixels within the tolerance (inclusive) of the seed's colour."""
    at = px.where((col("x") == seed[0]) & (col("y") == seed[1])).select(IMAGE, *(col(c).alias(f"_{c}") for c in "rgb"))
    d = F.sqrt(distance2([col(c) for c in "rgb"], [col(f"_{c}") for c in "rgb"]).cast("double"))
    passable = px.join(at, IMAGE).where((d <= tolerance) & (col("a") != 0)).select(IMAGE, "x", "y")
    return reached(passable, (col("x") == seed[0]) & (col("y") == seed[1]))


def holes(px: DataFrame, region: Column) -> DataFrame:
    """(image_id, x, y): opaque pixels outside the region which the border can't reach without crossing it."""
    marked = with_reach(on_border(px), ~region, col("edge"))
    return marked.where(~region & (col("a") >= 128) & ~col("hit")).select(IMAGE, "x", "y")


def significant(px: DataFrame, above: int, least: int, share: float, grow: int) -> DataFrame:
    """(image_id, x, y): visible pixels no further than `grow` (in either direction) from a component of eight neighbours that is
    large enough; images without one keep all."""
    comps = stored(labelled(px.where(col("a") > above).withColumn("_one", F.lit(1)), "_one", diagonal=True), "comps")
    totals = px.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("_n"))
    large = comps.groupBy(IMAGE, "comp").count().join(totals, IMAGE).where(col("count") >= F.greatest(F.lit(least), col("_n") * share)).select(IMAGE, "comp")
    large = stored(large, "large")
    core = comps.join(large, [IMAGE, "comp"], "left_semi")
    span = lambda c: F.explode(F.sequence(col(c) - grow, col(c) + grow))
    zone = core.select(IMAGE, span("x").alias("x"), "y").distinct().select(IMAGE, "x", span("y").alias("y")).distinct()
    some = comps.join(large.select(IMAGE).distinct(), IMAGE, "left_anti").select(IMAGE, "x", "y")
    return comps.join(zone, [IMAGE, "x", "y"], "left_semi").select(IMAGE, "x", "y").union(some)


def border_islands(px: DataFrame, share: float = 0.03, alpha: int = 128) -> DataFrame:
    """(image_id, comp, area): opaque components that touch the border, are smaller than `share` of the image and not its largest."""
    return _islands(labelled(on_border(px).where(col("a") >= alpha).withColumn("_one", F.lit(1)), "_one"), px, share)


def _islands(pixels: DataFrame, px: DataFrame, share: float, tasks: int | None = None) -> DataFrame:
    """Of px: the islands among the components of `pixels` (with comp and edge)."""
    comps = by_image(stored(pixels.groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("area"), F.bool_or("edge").alias("touches")), "comps"), tasks)  # one row for each component
    largest = comps.groupBy(IMAGE).agg(F.min(F.struct((-col("area")).alias("n"), "comp")).alias("_m"))
    totals = px.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("_n"))
    joined = comps.join(largest, IMAGE).join(totals, IMAGE)
    return joined.where(col("touches") & (col("comp") != col("_m.comp")) & (col("area") < col("_n") * share)).select(IMAGE, "comp", "area")


def enclosed_background(px: DataFrame, background: tuple[int, int, int], near: int = 42, share: float = 0.0015, ring: int = 6, other: float = 0.02, alpha: int = 8) -> DataFrame:
    """(image_id, comp, area): small components near the background colour with hardly any other candidate pixel around them: of the
    pixels of the image no further than `ring`, in either direction, from one of theirs, `other` at most are candidates."""
    d2 = distance2([col(c) for c in "rgb"], [F.lit(v) for v in background])
    candidate = px.where((d2 < near * near) & (col("a") >= alpha)).withColumn("_one", F.lit(1))
    return _enclosed(stored(labelled(candidate, "_one"), "comps"), px, share, ring, other)


def _enclosed(comps: DataFrame, px: DataFrame, share: float = 0.0015, ring: int = 6, other: float = 0.02, tasks: int | None = None) -> DataFrame:
    """Of px: the enclosed ones among the components of its candidates `comps` (with comp)."""
    totals = sized(px).groupBy(IMAGE, "_w", "_h").agg(F.count(F.lit(1)).alias("_n"))
    small = comps.groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("area")).join(totals, IMAGE).where(col("area") <= col("_n") * share)
    small = by_image(stored(small.select(IMAGE, "comp", "area", "_w", "_h"), "small"), tasks, IMAGE, "comp")
    # only what may go is widened: each row of a pixel's square is cut at the image's border, and equal pixels are one
    own = by_image(comps, tasks, IMAGE, "comp").join(small, [IMAGE, "comp"])
    rows = own.select(IMAGE, "comp", "x", "_w", F.explode(F.sequence(F.greatest(F.lit(0), col("y") - ring), F.least(col("_h") - 1, col("y") + ring))).alias("y")).distinct()
    around = rows.select(IMAGE, "comp", "y", F.explode(F.sequence(F.greatest(F.lit(0), col("x") - ring), F.least(col("_w") - 1, col("x") + ring))).alias("x")).distinct()
    seen = by_image(around, tasks, IMAGE, "x", "y").join(by_image(comps.select(IMAGE, "x", "y", col("comp").alias("_c")), tasks, IMAGE, "x", "y"), [IMAGE, "x", "y"], "left").where(~col("comp").eqNullSafe(col("_c")))
    counts = seen.groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("_ring"), F.count("_c").alias("_others"))
    joined = small.join(counts, [IMAGE, "comp"], "left")
    return joined.where(F.coalesce(col("_others") <= col("_ring") * other, F.lit(True))).select(IMAGE, "comp", "area")


def keyed_out(px: DataFrame, background: DataFrame, solid: float, cut: float, tasks: int | None = None) -> DataFrame:
    """px (image_id, x, y, r, g, b, a) without its image's background colour (image_id, r, g, b): what the border reaches through
    pixels nearer than `cut` fades and loses its tint, then enclosed patches of that colour, and what is left as islands at the border
    goes. Further columns stay."""
    names = px.columns
    px = on_border(px).join(background.select(IMAGE, *(col(c).alias(f"_b{c}") for c in "rgb")), IMAGE)
    d = F.sqrt(distance2([col(c) for c in "rgb"], [col(f"_b{c}") for c in "rgb"]).cast("double"))

    def faded(px: DataFrame, where: Column, d: Column) -> DataFrame:
        px = px.withColumn("_k", key_alpha(d, solid, cut)).withColumn("_a", half_up(col("_k") * 255)).withColumn("_clear", where & (col("_a") < col("a")))
        parts = {c: F.when(col("_clear"), despilled(col(c), col("_k"), col(f"_b{c}"))).otherwise(col(c)).alias(c) for c in "rgb"}
        return px.select(*(parts.get(c, F.when(col("_clear"), col("_a")).otherwise(col("a")).cast("int").alias("a") if c == "a" else col(c)) for c in [*names, "edge", "_br", "_bg", "_bb"]))

    def without(px: DataFrame, passable: Column, choose, d: Column) -> DataFrame:
        """px where the chosen ones among the components of its passable pixels have faded."""
        comps = by_image(stored(labelled(px.withColumn("_open", F.when(passable, 1)), "_open", tasks=tasks), "comps"), tasks)
        gone = stored(choose(comps.where("_open = 1"), comps).select(IMAGE, "comp", F.lit(True).alias("_gone")), "gone")
        return faded(by_image(comps, tasks, IMAGE, "comp").join(by_image(gone, tasks, IMAGE, "comp"), [IMAGE, "comp"], "left"), F.coalesce("_gone", F.lit(False)), d)

    px = faded(with_reach(px.withColumn("_d", d), col("_d") < cut, col("edge"), tasks=tasks), col("hit"), col("_d"))
    px = without(px, (col("a") >= 8) & (d < 42), lambda comps, px: _enclosed(comps, px, tasks=tasks), d)
    px = without(px, col("a") >= 8, lambda comps, px: _islands(comps, px, 0.03, tasks), F.lit(0.0))
    return by_image(px.select(*names), tasks)


def figures_in(px: DataFrame, box: tuple[int, int, int, int], share: float = 0.6, bits: int = 5) -> DataFrame:
    """(image_id, comp, area): one-colour components with at least `share` of their pixels in the box (corners inclusive)."""
    key = bucket_key(bits, col("r"), col("g"), col("b"))
    inside = col("x").between(box[0], box[2]) & col("y").between(box[1], box[3])
    comps = labelled(px.where(col("a") >= 128).withColumn("label", key).withColumn("_in", inside))
    counts = comps.groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("area"), F.count_if("_in").alias("within"))
    return counts.where((col("within") >= col("area") * share) & (col("within") > 0)).select(IMAGE, "comp", "area")


def figure_mask(px: DataFrame, box: tuple[int, int, int, int], share: float = 0.6, bits: int = 5, fringe: int = 95) -> DataFrame:
    """(image_id, x, y, ring): the pixels of the components that figures_in finds, and around each the opaque neighbours within
    `fringe` of its colour (that of its first pixel in the box), which do not spread further."""
    inside = col("x").between(box[0], box[2]) & col("y").between(box[1], box[3])
    opaque = px.where(col("a") >= 128).select(IMAGE, "x", "y", *"rgb")
    comps = stored(labelled(opaque.withColumn("label", bucket_key(bits, *(col(c) for c in "rgb"))).withColumn("_in", inside), "label"), "comps")
    first = F.min(F.when(col("_in"), F.struct("y", "x", *"rgb"))).alias("_first")
    figures = comps.groupBy(IMAGE, "comp").agg(F.count(F.lit(1)).alias("area"), F.count_if("_in").alias("within"), first)
    figures = figures.where((col("within") >= col("area") * share) & (col("within") > 0)).select(IMAGE, "comp", "_first")
    body = stored(comps.join(figures, [IMAGE, "comp"]).select(IMAGE, "x", "y", "_first"), "figures")
    steps = F.array(*(F.struct((col("x") + dx).alias("x"), (col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    # equal neighbours of one figure are one row before they meet the pixels
    beside = body.select(IMAGE, F.explode(steps).alias("p"), *(col(f"_first.{c}").alias(f"_{c}") for c in "rgb")).select(IMAGE, "p.x", "p.y", "_r", "_g", "_b").distinct()
    near = distance2([col(c) for c in "rgb"], [col(f"_{c}") for c in "rgb"]) < fringe * fringe
    ring = opaque.join(beside, [IMAGE, "x", "y"]).where(near).select(IMAGE, "x", "y").distinct()
    marked = body.select(IMAGE, "x", "y", F.lit(False).alias("ring")).unionByName(ring.withColumn("ring", F.lit(True)))
    return marked.groupBy(IMAGE, "x", "y").agg(F.bool_and("ring").alias("ring"))


def grown(mask: DataFrame, px: DataFrame, passes: int) -> DataFrame:
    """(image_id, x, y): the mask and what is up to `passes` steps (four neighbours) from it, within the image."""
    for _ in range(passes):
        steps = F.array(*(F.struct((col("x") + dx).alias("x"), (col("y") + dy).alias("y")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
        mask = mask.select(IMAGE, F.explode(steps).alias("p")).select(IMAGE, "p.x", "p.y").distinct()
    return mask.join(px.select(IMAGE, "x", "y"), [IMAGE, "x", "y"], "left_semi")


def merged_thin(labels: DataFrame, thin: list[int], most: int = 40) -> DataFrame:
    """(image_id, x, y, label): pixels with a thin label take, pass by pass, the most frequent label of their settled neighbours. On a
    tie that label wins which reaches the number first in the order left, right, up, down. With a column `a`, pixels that are
    not opaque (a < 128) neither change nor count; nor do pixels without label."""
    opaque = (col("a") >= 128) if "a" in labels.columns else F.lit(True)
    open_ = opaque & col("label").isin(thin)
    state = labels.select(IMAGE, "x", "y", F.when(opaque & ~open_, col("label")).alias("label"), open_.alias("_open"), col("label").alias("_old"))
    state = last = stored(state, "labels")
    w, h = Window.partitionBy(IMAGE, "y").orderBy("x"), Window.partitionBy(IMAGE, "x").orderBy("y")
    beside = lambda f, o, c, d: F.when(f(c).over(o) == col(c) + d, f("label").over(o))
    for _ in range(most):
        known = F.array_compact(F.array(beside(F.lag, w, "x", -1), beside(F.lead, w, "x", 1), beside(F.lag, h, "y", -1), beside(F.lead, h, "y", 1)))
        step = state.withColumn("_n", known)
        votes = F.transform("_n", lambda v, i: F.struct(F.size(F.filter(F.slice("_n", F.lit(1), i + 1), lambda o: o == v)).alias("n"), (-i).alias("i"), v.alias("v")))
        taken = F.when(col("_open"), F.array_max(votes)["v"])
        step = step.select(IMAGE, "x", "y", F.coalesce("label", taken).alias("label"), (col("_open") & taken.isNull()).alias("_open"), "_old", (col("_open") & taken.isNotNull()).alias("_moved"))
        step = stored(step, "labels")
        discard(last)
        state, last, moved = step.drop("_moved"), step, not step.where("_moved").isEmpty()
        if not moved:
            break
    return state.select(IMAGE, "x", "y", F.coalesce("label", "_old").alias("label"))
