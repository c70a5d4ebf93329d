"""Rasters at another size, by any ratio. Each axis is a pass of its own: a source pixel is dealt to the target pixels that it reaches, and
their weighted sums combine before the shuffle, so an image spreads over its rows and columns and never meets in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up, store_byte
from .windows import IMAGE, sized

#: Fixed value: the longer side, at most, of an image whose content is analysed.
ANALYSIS_SIDE = 256


def col(name: str) -> Column:
    return F.col(name)


def inside(side: int) -> tuple[Column, Column]:
    """Width and height (of _w and _h) with the longer side cut to `side` and the aspect kept; smaller images keep theirs."""
    longer = F.greatest("_w", "_h")
    fit = lambda v: F.when(longer <= side, col(v)).otherwise(F.greatest(F.lit(1), half_up(col(v) * F.lit(float(side)) / longer))).cast("int")
    return fit("_w"), fit("_h")


def _shrunken_axis(px: DataFrame, axis: str, source: str, target: str, sums: list[str]) -> DataFrame:
    """Sums over the parts of source pixels that a target pixel covers. In units of 1 / target a source pixel is `target` long and a target
    pixel `source` long, so that all shares are whole numbers."""
    other = "y" if axis == "x" else "x"
    a, n, m = col(axis).cast("long"), col(source), col(target)
    first, last = F.floor(a * m / n), F.floor(((a + 1) * m - 1) / n)
    dealt = px.withColumn("_t", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    part = F.least((a + 1) * m, (col("_t") + 1) * n) - F.greatest(a * m, col("_t") * n)
    keys = [IMAGE, other, "_w", "_h", "_tw", "_th"]
    return dealt.groupBy(*keys, col("_t").alias(axis)).agg(*(F.sum(col(s) * part).alias(s) for s in sums))


def shrunken(px: DataFrame, side: int = ANALYSIS_SIDE) -> DataFrame:
    """px (image_id, x, y, r, g, b, a) with the longer side of each image cut to `side`: each pixel is the mean of the area that it covers,
    colours weighed by alpha; a clear pixel is black. Sums are whole numbers, so the result is exact. Images that fit already pass."""
    tw, th = inside(side)
    whole = sized(px).withColumns({"_tw": tw, "_th": th}).drop("_n")
    small = (col("_tw") == col("_w")) & (col("_th") == col("_h"))
    parts = whole.where(~small).select(IMAGE, "x", "y", "_w", "_h", "_tw", "_th", *((col(c) * col("a")).cast("long").alias(c) for c in "rgb"), col("a").cast("long").alias("a"))
    for axis, source, target in (("x", "_w", "_tw"), ("y", "_h", "_th")):
        parts = _shrunken_axis(parts, axis, source, target, list("rgba"))
    area = col("_w").cast("long") * col("_h")
    colors = (F.when(col("a") > 0, store_byte(F.try_divide(col(c).cast("double"), col("a").cast("double")))).otherwise(0).alias(c) for c in "rgb")
    done = parts.select(IMAGE, "x", "y", *colors, store_byte(col("a") / area).alias("a"))
    return whole.where(small).select(IMAGE, "x", "y", "r", "g", "b", "a").unionByName(done)


def _lobed(t: Column, lobes: int) -> Column:
    """The windowed sinc, 0 from `lobes` on."""
    sinc = lambda v: F.when(v == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(F.lit(math.pi) * v), F.lit(math.pi) * v))
    return F.when(F.abs(t) < lobes, sinc(t) * sinc(t / lobes)).otherwise(0.0)


def lanczos_scaled(px: DataFrame, value: str, scale: float, lobes: int = 3) -> DataFrame:
    """(image_id, x, y, v): a byte value on a grid `scale` times as fine (below 1: coarser), sizes rounded. Weights are those of the
    offsets from the target's centre, stretched where it shrinks, and have the sum 1; beyond the border the edge pixel is repeated."""
    size = lambda v: F.greatest(F.lit(1), half_up(col(v) * F.lit(float(scale)))).cast("int")
    v = sized(px).select(IMAGE, "x", "y", "_w", "_h", size("_w").alias("_tw"), size("_h").alias("_th"), col(value).cast("double").alias("v"))
    for axis, source, target in (("x", "_w", "_tw"), ("y", "_h", "_th")):
        other = "y" if axis == "x" else "x"
        step = col(source) / col(target).cast("double")
        wide = F.greatest(F.lit(1.0), step)
        reach = F.ceil(wide * lobes).cast("int")
        # a border pixel stands also for the places beyond it that a target can reach
        places = F.sequence(F.when(col(axis) == 0, -reach).otherwise(col(axis)), F.when(col(axis) == col(source) - 1, col(axis) + reach).otherwise(col(axis)))
        spread = v.withColumn("_p", F.explode(places))
        low = F.greatest(F.lit(0), F.ceil((col("_p") + 0.5 - wide * lobes) / step - 0.5).cast("int"))
        high = F.least(col(target) - 1, F.floor((col("_p") + 0.5 + wide * lobes) / step - 0.5).cast("int"))
        dealt = spread.where(low <= high).withColumn("_t", F.explode(F.sequence(low, high)))
        centre = (col("_t") + 0.5) * step - 0.5
        dealt = dealt.withColumn("_k", _lobed((col("_p") - centre) / wide, lobes))
        keys = [IMAGE, other, "_w", "_h", "_tw", "_th"]
        v = dealt.groupBy(*keys, col("_t").alias(axis)).agg((F.sum(col("v") * col("_k")) / F.sum("_k")).alias("v"))
    return v.select(IMAGE, "x", "y", store_byte(F.round("v", 6)).alias("v"))
