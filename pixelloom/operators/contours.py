"""Edges of soft masks: refined region edges, contour cells, texture in flat dark zones, median filters, job timeouts. Contour lines are
in contour_lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import luma
from ..functions.numeric import clamp, half_up
from .windows import IMAGE, along, box_mean, box_sums


def col(name: str) -> Column:
    return F.col(name)


def refined_edges(px: DataFrame, region: Column, r: int = 5, eps: float = 4e-4, band: float = 0.16) -> DataFrame:
    """(image_id, x, y, alpha): a region's binary mask, grown by a pixel, smoothed along the image's own edges, and steepened
    about one half."""
    px = box_mean(px.withColumn("_m", F.when(region, 1.0).otherwise(0.0)), "_m", 1, "_mean")
    px = px.withColumns({"p": F.when(col("_mean") > 0.05, 1.0).otherwise(0.0), "i": luma(col("r"), col("g"), col("b")) / F.lit(255.0)})
    px = box_sums(px.withColumns({"ii": col("i") * col("i"), "ip": col("i") * col("p")}), ["i", "p", "ii", "ip"], r)
    mean = {v: col(f"s_{v}") / col("n") for v in ("i", "p", "ii", "ip")}
    px = px.withColumn("_a", (mean["ip"] - mean["i"] * mean["p"]) / (mean["ii"] - mean["i"] * mean["i"] + F.lit(eps)))
    px = px.withColumn("_b", mean["p"] - col("_a") * mean["i"]).drop("s_i", "s_p", "s_ii", "s_ip", "n")
    px = box_sums(px, ["_a", "_b"], r)
    q = col("s__a") / col("n") * col("i") + col("s__b") / col("n")
    px = px.withColumn("_t", clamp(F.round((q - (0.5 - band)) / (2 * band), 9), 0.0, 1.0))
    return px.select(IMAGE, "x", "y", half_up(col("_t") * col("_t") * (3 - 2 * col("_t")) * 255).alias("alpha"))


def contour_cells(px: DataFrame, iso: int = 128) -> DataFrame:
    """(image_id, x, y, code): cells of 2 x 2 pixel centres that the contour crosses; code has a bit for each corner at or above
    the level (1 upper left, 2 upper right, 4 lower right, 8 lower left). Pixels beyond the border are below it."""
    bit = (col("a") >= iso).cast("int")
    corner = lambda dx, dy, k: px.select(IMAGE, (col("x") - dx).alias("x"), (col("y") - dy).alias("y"), (bit * k).alias("code"))
    every = corner(0, 0, 1).union(corner(1, 0, 2)).union(corner(1, 1, 4)).union(corner(0, 1, 8))
    return every.groupBy(IMAGE, "x", "y").agg(F.sum("code").cast("int").alias("code")).where("code NOT IN (0, 15)")


def contour_length(cells: DataFrame) -> DataFrame:
    """(image_id, segments): saddle cells hold two segments, all others one."""
    return cells.groupBy(IMAGE).agg(F.sum(F.when(col("code").isin(5, 10), 2).otherwise(1)).alias("segments"))


def median_filtered(px: DataFrame, value: str = "a", r: int = 1) -> DataFrame:
    """(image_id, x, y, v): upper median of the box, cut at the border."""
    rows = px.withColumn("_r", F.collect_list(value).over(along("x").rangeBetween(-r, r)))
    box = rows.withColumn("_b", F.array_sort(F.flatten(F.collect_list("_r").over(along("y").rangeBetween(-r, r)))))
    return box.select(IMAGE, "x", "y", F.element_at("_b", F.floor(F.size("_b") / 2).cast("int") + 1).alias("v"))


def texture_restored(px: DataFrame, original: DataFrame, flat_below: float = 8.0, lean: float = 0.35) -> DataFrame:
    """(image_id, x, y, r, g, b): where the image has hardly any detail, it leans to the original. (The random grain of dark flat
    zones is left out: a result must not change between runs.)"""
    px = box_sums(px.withColumn("_l", luma(col("r"), col("g"), col("b"))), ["_l"], 1)
    detail = F.abs(col("_l") - col("s__l") / col("n"))
    px = px.withColumn("_f", F.when(detail < flat_below, (1 - detail / F.lit(flat_below)) * F.lit(lean)).otherwise(0.0))
    source = original.select(IMAGE, "x", "y", *(col(c).alias(f"o{c}") for c in "rgb"))
    joined = px.join(source, [IMAGE, "x", "y"])
    return joined.select(IMAGE, "x", "y", *(half_up(F.round(col(c) * (1 - col("_f")) + col(f"o{c}") * col("_f"), 6)).alias(c) for c in "rgb"))


def timed_out(events: DataFrame, key: str, limit_seconds: int) -> DataFrame:
    """(key, seq, answered): events after which their key stayed silent for longer than the limit, up to its next event or, where none
    ever came, up to the newest time of all events."""
    micros = F.unix_micros(col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("ts", "seq")
    now = events.agg(F.max(micros).alias("_now"))
    waits = events.select(key, "seq", micros.alias("_at"), F.lead(micros).over(w).alias("_next")).join(F.broadcast(now))
    return waits.where(F.coalesce("_next", "_now") - col("_at") > limit_seconds * 1_000_000).select(key, "seq", col("_next").isNotNull().alias("answered"))
