"""Brushes, colour filters and vignettes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, clamp_byte
from .windows import IMAGE, along, gaussian_weights, sized

AT = [IMAGE, "x", "y"]
#: Side of the cells in which strokes and pixels meet.
CELL = 32


def col(name: str) -> Column:
    return F.col(name)


# --- brushes -------------------------------------------------------------------------------------------------------------


def _segments(strokes: DataFrame) -> DataFrame:
    """Each point of a stroke with the one that follows, or itself where none does and it is the only one."""
    w = Window.partitionBy(IMAGE, "stroke").orderBy("seq")
    ends = strokes.withColumns({"_x1": F.lead("x").over(w), "_y1": F.lead("y").over(w), "_first": F.lag("seq").over(w).isNull()})
    ends = ends.where(col("_x1").isNotNull() | col("_first"))
    return ends.select(IMAGE, "stroke", "radius", "hardness", "flow", "mode", col("x").alias("x0"), col("y").alias("y0"), F.coalesce("_x1", "x").alias("x1"), F.coalesce("_y1", "y").alias("y1"))


def _distance(x: Column, y: Column) -> Column:
    """From a point to the segment (x0, y0) - (x1, y1)."""
    dx, dy = col("x1") - col("x0"), col("y1") - col("y0")
    along_it = F.coalesce(F.try_divide((x - col("x0")) * dx + (y - col("y0")) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = clamp(along_it, 0.0, 1.0)
    px, py = col("x0") + t * dx - x, col("y0") + t * dy - y
    return F.sqrt(px * px + py * py)


def strengths(px: DataFrame, strokes: DataFrame) -> DataFrame:
    """(image_id, x, y, stroke, mode, strength) of the pixels that a stroke reaches: its highest opacity there, which is the flow up to the
    hard core of the radius (given as a share of it; none at 0 and at 100) and falls evenly to nothing at its end. strokes: points (image_id,
    stroke, seq, x, y, radius, hardness, flow, mode). Segments are dealt to the cells that they come near, and meet only their pixels."""
    reach = F.greatest(F.lit(0.01), col("radius"))
    found = _segments(strokes).withColumn("radius", reach)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - col("radius")) / CELL).cast("int"), F.floor((F.greatest(a, b) + col("radius")) / CELL).cast("int"))
    dealt = found.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    dealt = dealt.where(_distance((col("_cx") + 0.5) * CELL, (col("_cy") + 0.5) * CELL) <= col("radius") + CELL * 0.75)
    places = px.select(*AT, F.floor(col("x") / CELL).cast("int").alias("_cx"), F.floor(col("y") / CELL).cast("int").alias("_cy"))
    met = places.join(dealt, [IMAGE, "_cx", "_cy"]).withColumn("_t", _distance(col("x") + 0.5, col("y") + 0.5) / col("radius")).where("_t < 1")
    hard = col("hardness") / F.lit(100.0)
    core = F.when((hard > 0) & (hard < 1), hard).otherwise(0.0)
    flow = clamp(col("flow") / F.lit(100.0), 0.0, 1.0)
    value = F.when(col("_t") <= core, flow).otherwise(flow * (1 - (col("_t") - core) / (1 - core)))
    return met.groupBy(*AT, "stroke", "mode").agg(F.max(value).alias("strength"))


def brushed(px: DataFrame, strokes: DataFrame, original: DataFrame) -> DataFrame:
    """px after all strokes, in their order: erase takes alpha off, restore lays the original over what is there. A pixel's strokes meet in
    one row, as many as have touched it; pixels that none touches pass."""
    touched = strengths(px, strokes).groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("stroke", "mode", "strength"))).alias("_s"))
    source = original.select(*AT, *(col(c).alias(f"_{c}") for c in "rgba"))
    joined = px.join(touched, AT, "left").join(source, AT, "left")
    own = lambda c: F.coalesce(f"_{c}", F.lit(0)).cast("double")
    start = F.struct(*(col(c).cast("double").alias(c) for c in "rgb"), (col("a") / F.lit(255.0)).alias("a"))

    def step(s: Column, e: Column) -> Column:
        back = e["mode"] == "restore"
        laid = own("a") / 255.0 * e["strength"]
        alpha = F.when(back, laid + s["a"] * (1 - laid)).otherwise(s["a"] * (1 - e["strength"]))
        mixed = lambda c: F.when(back & (alpha > 0), F.try_divide(own(c) * laid + s[c] * s["a"] * (1 - laid), alpha)).otherwise(s[c])
        return F.struct(*(mixed(c).alias(c) for c in "rgb"), alpha.alias("a"))

    done = joined.withColumn("_d", F.when(col("_s").isNotNull(), F.aggregate("_s", start, step)))
    out = lambda c: clamp_byte(F.round(col(f"_d.{c}") * (255 if c == "a" else 1), 6))
    return done.select(*AT, *(F.when(col("_s").isNull(), col(c)).otherwise(out(c)).alias(c) for c in "rgba"))


# --- colour filters ------------------------------------------------------------------------------------------------------

Matrix = tuple[tuple[float, float, float, float], ...]
#: Weights of the channels in saturation and hue, in grey, and in sepia, as the CSS filter effects define them.
SATURATION, GREY = (0.213, 0.715, 0.072), (0.2126, 0.7152, 0.0722)
HUE_SINE = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


def _toward(weights: Sequence[Sequence[float]], share: float) -> Matrix:
    """`share` of the way from the colour itself to the weighted one."""
    return tuple((*((1 - share) * (i == j) + share * weights[i][j] for j in range(3)), 0.0) for i in range(3))


def filter_matrix(name: str, amount: float) -> Matrix:
    """A filter as a matrix on colours from 0 to 1 with a constant in the last column. amount: percent, degrees for hue-rotate."""
    p = amount / 100
    if name in ("brightness", "contrast", "invert"):
        slope, shift = {"brightness": (p, 0.0), "contrast": (p, 0.5 - 0.5 * p), "invert": (1 - 2 * min(1.0, p), min(1.0, p))}[name]
        return tuple((*(slope * (i == j) for j in range(3)), shift) for i in range(3))
    if name == "saturate":
        return _toward([SATURATION] * 3, 1 - p)
    if name in ("grayscale", "sepia"):
        return _toward([GREY] * 3 if name == "grayscale" else SEPIA, min(1.0, p))
    if name == "hue-rotate":
        c, s = math.cos(math.radians(amount)), math.sin(math.radians(amount))
        return tuple((*(SATURATION[j] + c * ((i == j) - SATURATION[j]) + s * HUE_SINE[i][j] for j in range(3)), 0.0) for i in range(3))
    raise ValueError(f"no filter {name}")


def stays_inside(m: Matrix) -> bool:
    """Whether a matrix takes every colour from 0 to 1 to another one."""
    return all(row[3] + sum(min(0.0, v) for v in row[:3]) >= -1e-12 and row[3] + sum(max(0.0, v) for v in row[:3]) <= 1 + 1e-12 for row in m)


def folded(filters: Sequence[tuple[str, float]]) -> list[Matrix]:
    """The filters as few matrices, between which colours are cut to 0..1: a filter joins the one before if that needs no cut."""
    out: list[Matrix] = []
    for name, amount in filters:
        m = filter_matrix(name, amount)
        if out and stays_inside(out[-1]):
            last = out.pop()
            m = tuple((*(sum(m[i][k] * last[k][j] for k in range(3)) for j in range(3)), sum(m[i][k] * last[k][3] for k in range(3)) + m[i][3]) for i in range(3))
        out.append(m)
    return out


def _through(colors: list[Column], matrices: list[Matrix]) -> list[Column]:
    for m in matrices:
        colors = [clamp(sum((c * F.lit(v) for c, v in zip(colors, row, strict=False)), F.lit(row[3])), 0.0, 1.0) for row in m]
    return colors


def filtered(px: DataFrame, filters: Sequence[tuple[str, float]]) -> DataFrame:
    """px through a chain of CSS filters (brightness, contrast, saturate, hue-rotate, blur in pixels, grayscale, sepia, invert); alpha
    stays, but for blur. Without a blur the whole chain is one projection."""
    names = px.columns
    work = px.withColumns({f"_{c}": col(c) / F.lit(255.0) for c in "rgba"})
    part: list[tuple[str, float]] = []
    for name, amount in [*filters, ("", 0.0)]:
        if name and name != "blur":
            part.append((name, amount))
            continue
        work = work.withColumns(dict(zip(("_r", "_g", "_b"), _through([col(f"_{c}") for c in "rgb"], folded(part)), strict=True)))
        part = []
        if name and amount > 0:
            work = _blurred(work, amount)
    return work.select(*(clamp_byte(F.round(col(f"_{c}") * 255, 6)).alias(c) if c in "rgba" else col(c) for c in names))


def _blurred(work: DataFrame, sigma: float) -> DataFrame:
    """Colours weighed by alpha, and alpha itself, averaged by a normal curve; beyond the border all is clear."""
    work = work.withColumns({f"_{c}": col(f"_{c}") * col("_a") for c in "rgb"})
    for axis in "xy":
        o = along(axis)
        near = lambda v, k: col(v) if k == 0 else F.coalesce((F.lag(v, -k) if k < 0 else F.lead(v, k)).over(o), F.lit(0.0))  # noqa: B023, E731
        work = work.withColumns({f"_{c}": sum((near(f"_{c}", k) * F.lit(w) for k, w in gaussian_weights(sigma).items()), F.lit(0.0)) for c in "rgba"})
    return work.withColumns({f"_{c}": F.when(col("_a") > 0, F.least(F.lit(1.0), F.try_divide(f"_{c}", "_a"))).otherwise(0.0) for c in "rgb"})


#: Where the vignette begins and ends, as shares of the shorter and the longer side, and its darkness at the end.
VIGNETTE = (0.32, 0.72, 0.75)


def vignetted(px: DataFrame, amount: float) -> DataFrame:
    """px under a black veil that grows from the centre to the corners."""
    inner, outer = F.least("_w", "_h") * F.lit(VIGNETTE[0]), F.greatest("_w", "_h") * F.lit(VIGNETTE[1])
    dx, dy = col("x") + 0.5 - col("_w") / 2, col("y") + 0.5 - col("_h") / 2
    veil = clamp((F.sqrt(dx * dx + dy * dy) - inner) / (outer - inner), 0.0, 1.0) * F.lit(amount / 100 * VIGNETTE[2])
    work = sized(px).withColumn("_v", veil).withColumn("_o", col("_v") + col("a") / F.lit(255.0) * (1 - col("_v")))
    dark = lambda c: F.when(col("_o") > 0, F.try_divide(col(c) * (col("a") / F.lit(255.0)) * (1 - col("_v")), col("_o"))).otherwise(F.lit(0.0))
    laid = lambda c: clamp_byte(F.round(col("_o") * 255 if c == "a" else dark(c), 6)).alias(c)
    return work.select(*(laid(c) if c in "rgba" else col(c) for c in px.columns))
