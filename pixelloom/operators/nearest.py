"""Nearest marked pixels by windows over rows and columns, and the recovery of fine edges that builds on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import distance2
from ..functions.numeric import clamp, half_up
from .windows import IMAGE, dealt, sized


def col(name: str) -> Column:
    return F.col(name)


def nearest_marked(px: DataFrame, marks: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """px plus, for each name of marks, a struct (d, part, x, y, and that pixel's `carry` columns): city-block distance to the nearest
    marked pixel, and that pixel; null in images without any. Of equally near ones, part 0 (not to the right, not below) is
    taken first, then 1 (right, not below), 2 (right, below) and 3 (not right, below); within a part the leftmost, in part 2 the
    rightmost. Rows and columns are windows of their own, so a large image spreads over both, and nothing meets as a whole."""
    forward = {a: Window.partitionBy(IMAGE, b).orderBy(a).rowsBetween(Window.unboundedPreceding, 0) for a, b in ("xy", "yx")}
    backward = {a: Window.partitionBy(IMAGE, b).orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1) for a, b in ("xy", "yx")}
    rest = [c for c in ("x", "y", *carry)]
    pixel = F.struct(*rest)
    beside = {f"_{n}_{side}": F.last(F.when(m, pixel), ignorenulls=True).over(w["x"]) for n, m in marks.items() for side, w in (("l", forward), ("r", backward))}
    rows = px.withColumns(beside)

    def along_column(side: Column, order: Column, tie: Column, best, over: Window) -> Column:
        return best(F.when(side.isNotNull(), F.struct(order.alias("order"), tie.alias("tie"), side.alias("at")))).over(over)

    columns = {}
    for n in marks:
        left, right = col(f"_{n}_l"), col(f"_{n}_r")
        columns[f"_{n}_0"] = along_column(left, left["x"] + left["y"], -left["x"], F.max, forward["y"])
        columns[f"_{n}_1"] = along_column(right, right["y"] - right["x"], -right["x"], F.max, forward["y"])
        columns[f"_{n}_2"] = along_column(right, right["x"] + right["y"], -right["x"], F.min, backward["y"])
        columns[f"_{n}_3"] = along_column(left, left["y"] - left["x"], left["x"], F.min, backward["y"])
    every = rows.withColumns(columns)

    def found(n: str) -> Column:
        def part(k: int) -> Column:
            at = col(f"_{n}_{k}")["at"]
            d = F.abs(at["x"] - col("x")) + F.abs(at["y"] - col("y"))
            return F.when(at.isNotNull(), F.struct(d.alias("d"), F.lit(k).alias("part"), *(at[c].alias(c) for c in rest)))

        return F.least(*(part(k) for k in range(4)))

    return every.select(*px.columns, *(found(n).alias(n) for n in marks))


def recovered(px: DataFrame, original: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a): a cut-out takes back pixels of the original (r, g, b and a mask m) where the mask is above its
    alpha: within a band around what is solid, faded out at the band's end, and only where the original's colour is as near to the
    nearest solid pixel as to the nearest clear one. Colours are compared with the cut-out as given, so no pixel depends on what
    another took back. Pixels that the original lacks stay."""
    near = nearest_marked(sized(dealt(px)).select(*px.columns, "_w", "_h"), {"_fg": col("a") > 128, "_bg": col("a") < 16}, "rgb")
    source = original.select(IMAGE, "x", "y", *(col(c).alias(f"_{c}") for c in "rgb"), col("m").alias("_m"))
    joined = near.join(source, [IMAGE, "x", "y"], "left")
    band = clamp(half_up(F.greatest("_w", "_h") * 0.02), 10, 60)
    joined = joined.withColumn("_band", band).withColumn("_fade", F.greatest(F.lit(4), half_up(col("_band") / 4)))
    left = col("_band") - col("_fg.d")
    mask = F.when(left < col("_fade"), half_up(col("_m") * left / col("_fade"))).otherwise(col("_m"))
    colors = [col(f"_{c}") for c in "rgb"]
    to = {k: distance2([col(f"{k}.{c}") for c in "rgb"], colors) for k in ("_fg", "_bg")}
    like_clear = col("_bg").isNotNull() & (to["_bg"] < to["_fg"])
    take = F.coalesce((left >= 0) & (mask > col("a")) & ~like_clear, F.lit(False))
    return joined.select(IMAGE, "x", "y", *(F.when(take, col(f"_{c}")).otherwise(col(c)).alias(c) for c in "rgb"), F.when(take, mask).otherwise(col("a")).cast("int").alias("a"))
