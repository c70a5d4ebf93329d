"""Aggregates over rasters: histograms, palettes, borders, boxes, shapes, quality features. All are plain group-bys with
partial aggregation; ties are broken by pixel order, so that results do not depend on the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import bin_24, bucket_key, distance2, exact_key
from ..functions.numeric import half_up, ratio
from .windows import border_ring, sized

IMAGE = "image_id"


def col(name: str) -> Column:
    return F.col(name)


def background_histogram(px: DataFrame, below: int = 26) -> DataFrame:
    """(image_id, bin, cnt, freq): colours of the removed pixels."""
    counts = px.where(col("a") < below).groupBy(IMAGE, bin_24(col("r"), col("g"), col("b")).alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("freq", col("cnt") / F.sum("cnt").over(Window.partitionBy(IMAGE)))


def histogram_stats(hist: DataFrame) -> DataFrame:
    return hist.groupBy(IMAGE).agg(F.max("freq").alias("max_freq"), F.sum("cnt").alias("bg_pixels"), F.count(F.lit(1)).alias("nonzero_bins"))


def outside_box(px: DataFrame, low: float = 0.225, high: float = 0.775) -> DataFrame:
    """Pixels outside the central box; sizes are those of each image."""
    inside = (col("x") >= col("_w") * low) & (col("x") < col("_w") * high) & (col("y") >= col("_h") * low) & (col("y") < col("_h") * high)
    return sized(px).where(~inside).drop("_w", "_h", "_n")


def color_cardinality(px: DataFrame, bits: int = 4, above: int = 16) -> DataFrame:
    """Different colours, cut to their upper bits, of the visible pixels."""
    return px.where(col("a") > above).groupBy(IMAGE).agg(F.count_distinct(bucket_key(bits, col("r"), col("g"), col("b"))).alias("unique_colors"))


def sampled_border(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b) of every step-th pixel of each side; corners count on both sides."""
    step = F.greatest(F.lit(1), F.floor(2 * (col("_w") + col("_h")) / 240)).cast("int")
    sides = F.array_compact(
        F.array(
            F.when((col("y") == 0) & (col("x") % step == 0), 1),
            F.when((col("y") == col("_h") - 1) & (col("x") % step == 0), 2),
            F.when((col("x") == 0) & (col("y") % step == 0), 3),
            F.when((col("x") == col("_w") - 1) & (col("y") % step == 0), 4),
        )
    )
    return sized(px).select(IMAGE, "r", "g", "b", F.explode(sides).alias("side"))


def _borders(px: DataFrame) -> DataFrame:
    """(image_id, _b, and mr, mg, mb, the upper medians): the sampled border as an array, which has some 480 pixels at most whatever the
    image's size, so that a task sorts an image's pixels once."""
    borders = sampled_border(px).groupBy(IMAGE).agg(F.collect_list(F.struct(*"rgb")).alias("_b"))
    middle = lambda c: F.get(F.sort_array(col(f"_b.{c}")), F.floor(F.size("_b") / 2).cast("int"))
    return borders.withColumns({f"m{c}": middle(c) for c in "rgb"})


def border_median(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b): upper median of each channel on the border."""
    return _borders(px).select(IMAGE, *(col(f"m{c}").alias(c) for c in "rgb"))


def border_uniformity(px: DataFrame, near: int = 40) -> DataFrame:
    """(image_id, uniformity): share of the border within `near` of its median colour."""
    close = lambda p: F.sqrt(distance2([p[c] for c in "rgb"], [col(f"m{c}") for c in "rgb"]).cast("double")) < near
    return _borders(px).select(IMAGE, (F.size(F.filter("_b", close)) / F.size("_b")).alias("uniformity"))


def bounding_box(px: DataFrame, above: int = 0, groups: tuple[str, ...] = (IMAGE,)) -> DataFrame:
    return px.where(col("a") > above).groupBy(*groups).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("area"))


def palette(px: DataFrame, bits: int = 5, share: float = 0.0006, top: int = 80, alpha: int = 128) -> DataFrame:
    """(image_id, idx, r, g, b, cnt): mean colour of the most frequent buckets; equal counts in pixel order."""
    opaque = px.where(col("a") >= alpha)
    key = bucket_key(bits, col("r"), col("g"), col("b"))
    sums = opaque.groupBy(IMAGE, key.alias("key")).agg(*(F.sum(c).alias(f"s{c}") for c in "rgb"), F.count(F.lit(1)).alias("cnt"), F.min(F.struct("y", "x")).alias("first"))
    total = F.sum("cnt").over(Window.partitionBy(IMAGE))
    kept = sums.withColumn("total", total).where(col("cnt") > col("total") * share)
    ranked = kept.withColumn("idx", F.row_number().over(Window.partitionBy(IMAGE).orderBy(F.desc("cnt"), "first")) - 1).where(col("idx") < top)
    return ranked.select(IMAGE, "idx", *(half_up(col(f"s{c}") / col("cnt")).alias(c) for c in "rgb"), "cnt")


def exact_palette(px: DataFrame, share: float = 0.0001, top: int = 64, least: int = 0, alpha: int = 128, protected: DataFrame | None = None) -> DataFrame:
    """(image_id, idx, r, g, b, cnt) of exact colours; protected ones (r, g, b) stay however rare they are."""
    counts = px.where(col("a") >= alpha).groupBy(IMAGE, "r", "g", "b").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("y", "x")).alias("first"))
    counts = counts.withColumn("total", F.sum("cnt").over(Window.partitionBy(IMAGE)))
    kept = (col("cnt") > col("total") * share) & (col("cnt") >= least)
    if protected is not None:
        counts = counts.join(protected.select("r", "g", "b").distinct().withColumn("_p", F.lit(True)), ["r", "g", "b"], "left")
        kept = kept | F.coalesce("_p", F.lit(False))
    ranked = counts.where(kept).withColumn("idx", F.row_number().over(Window.partitionBy(IMAGE).orderBy(F.desc("cnt"), "first")) - 1)
    return ranked.where(col("idx") < top).select(IMAGE, "idx", "r", "g", "b", "cnt")


def dominant_color(px: DataFrame, groups: tuple[str, ...] = (IMAGE,), bits: int = 5, alpha: int = 128) -> DataFrame:
    """(groups, r, g, b, cnt): of the fullest bucket the first pixel's colour; equal buckets in pixel order."""
    opaque = px.where(col("a") >= alpha)
    buckets = opaque.groupBy(*groups, bucket_key(bits, col("r"), col("g"), col("b")).alias("key")).agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("y", "x", "r", "g", "b")).alias("first"))
    best = buckets.groupBy(*groups).agg(F.min(F.struct((-col("cnt")).alias("n"), "first")).alias("best"))
    return best.select(*groups, "best.first.r", "best.first.g", "best.first.b", (-col("best.n")).alias("cnt"))


#: The verdicts, and the shares of kept pixels below and above which they are given.
VANISHED, UNTOUCHED = (0.015, "subject-vanished"), (0.985, "nothing-removed")


def alpha_fractions(px: DataFrame) -> DataFrame:
    """(image_id, kept, translucent, verdict): shares of kept and translucent pixels, and the quality verdict."""
    shares = px.groupBy(IMAGE).agg((F.count_if(col("a") > 128) / F.count(F.lit(1))).alias("kept"), (F.count_if(col("a") < 239) / F.count(F.lit(1))).alias("translucent"))
    return shares.withColumn("verdict", F.when(col("kept") < VANISHED[0], VANISHED[1]).when(col("kept") > UNTOUCHED[0], UNTOUCHED[1]).otherwise("ok"))


def channel_variance(px: DataFrame) -> DataFrame:
    """(image_id, channel, spread): the channel with the largest n * sum of squares - square of the sum; the first on a tie."""
    spread = lambda c: F.count(F.lit(1)) * F.sum(col(c).cast("long") * col(c)) - F.sum(c) * F.sum(c)
    stats = px.where(col("a") > 0).groupBy(IMAGE).agg(*(spread(c).alias(f"v{c}") for c in "rgb"))
    best = F.array_max(F.array(*(F.struct(col(f"v{c}").alias("v"), F.lit(-i).alias("i")) for i, c in enumerate("rgb"))))
    return stats.withColumn("best", best).select(IMAGE, F.element_at(F.array(*map(F.lit, "rgb")), 1 - col("best.i")).alias("channel"), col("best.v").alias("spread"))


def region_shapes(regions: DataFrame) -> DataFrame:
    """(image_id, region_id, area, aspect, fill, ...) of pixels with a region: what tells circles."""
    stats = regions.groupBy(IMAGE, "region_id").agg(
        F.count(F.lit(1)).alias("area"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(col("x").cast("long") * col("x") + col("y").cast("long") * col("y")).alias("s2"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"),
    )
    cx, cy = col("sx") / col("area"), col("sy") / col("area")
    return stats.select(IMAGE, "region_id", "area", cx.alias("cx"), cy.alias("cy"), ratio(col("bw"), col("bh")).alias("aspect"), ratio(col("area"), col("bw") * col("bh")).alias("fill"), F.round(col("s2") / col("area") - cx * cx - cy * cy, 6).alias("moment"))


def circles(regions: DataFrame, least: int, aspect_from: float, aspect_to: float, fill_from: float, fill_to: float, deviation: float, error: float) -> DataFrame:
    """(image_id, region_id, area, cx, cy, r): the regions (image_id, region_id, x, y) that are circles by aspect, fill, the spread of
    the border's distance from the centre, and the radius that follows from the area."""
    key = [IMAGE, "region_id"]
    n = F.count(F.lit(1))
    stats = regions.groupBy(*key).agg(n.alias("area"), (F.sum("x") / n).alias("cx"), (F.sum("y") / n).alias("cy"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"))
    distance = F.sqrt((col("x") - col("cx")) * (col("x") - col("cx")) + (col("y") - col("cy")) * (col("y") - col("cy")))
    border = border_ring(regions, tuple(key)).join(stats, key).select(*key, distance.alias("d")).groupBy(*key).agg(F.avg("d").alias("m"), F.avg(col("d") * col("d")).alias("m2"))
    radius = F.sqrt(col("area") / F.lit(math.pi))
    aspect, fill = col("bw") / col("bh"), col("area") / (col("bw") * col("bh"))
    spread = F.sqrt(F.greatest(F.lit(0.0), col("m2") - col("m") * col("m"))) / col("m")
    fits = (aspect > aspect_from) & (aspect < aspect_to) & (fill > fill_from) & (fill < fill_to) & (spread < deviation) & (F.abs(col("m") - radius) / radius < error)
    found = stats.where(col("area") >= least).join(border, key).where(fits)
    return found.select(*key, "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round((col("m") + radius) / 2, 6).alias("r"))


def clean_flag(near: DataFrame, off: int = 30, fraction: float = 0.12, least_side: int = 600) -> DataFrame:
    """(image_id, fraction, clean) of pixels with the distance d2 to their palette: few opaque ones are off, and the image is not small."""
    opaque = F.count_if(col("a") >= 128)
    share = F.count_if((col("a") >= 128) & (col("d2") > off * off)) / F.greatest(F.lit(1), opaque)
    found = near.groupBy(IMAGE).agg(share.alias("_s"), (F.greatest(F.max("x"), F.max("y")) + 1).alias("_d"))
    return found.select(IMAGE, F.round("_s", 9).alias("fraction"), ((col("_s") < fraction) & (col("_d") >= least_side)).alias("clean"))


def thin_colors(labels: DataFrame, core: DataFrame, area: float = 0.05, kept: float = 0.35) -> DataFrame:
    """Labels that cover less than `area` of the image and lose more than 1 - `kept` of it by erosion (core: what is left)."""
    full = labels.groupBy(IMAGE, "label").agg(F.count(F.lit(1)).alias("cnt")).withColumn("total", F.sum("cnt").over(Window.partitionBy(IMAGE)))
    left = core.groupBy(IMAGE, "label").agg(F.count(F.lit(1)).alias("core"))
    joined = full.join(left, [IMAGE, "label"], "left").withColumn("core", F.coalesce("core", F.lit(0).cast("long")))
    return joined.where((col("cnt") < col("total") * area) & (col("core") < col("cnt") * kept)).select(IMAGE, "label", "cnt", "core")


def exact_keys(px: DataFrame) -> DataFrame:
    return px.withColumn("key", exact_key(col("r"), col("g"), col("b")))
