"""Adapters from the driver tables to the shapes that the operators take (rasters, regions, candidates, edit logs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte(v: Column, factor: int = 1) -> Column:
    return clamp(F.floor((v.cast("double") * factor + F.lit(0.5)) * 255 + F.lit(0.5)), 0, 255).cast("int")


def _channels(i: Column) -> list[Column]:
    at = lambda k: F.element_at("embedding", F.pmod(i + k, F.lit(64)).cast("int") + 1)
    return [_byte(at(0)).alias("r"), _byte(at(1)).alias("g"), _byte(at(2)).alias("b"), _byte(at(3), 4).alias("a")]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 image for each embedding."""
    i = F.col("i")
    return _cells(spark, sf_dir).select(F.col("vec_id").alias("image_id"), (i % 8).cast("int").alias("x"), F.floor(i / 8).cast("int").alias("y"), *_channels(i))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image, 64 wide, with a row for each embedding."""
    i = F.col("i")
    return _cells(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), i.alias("x"), F.col("vec_id").cast("int").alias("y"), *_channels(i))


#: The flat colours of the status raster.
STATUS_COLORS = {"F": (220, 20, 60), "O": (30, 144, 255), "P": (34, 139, 34)}


def status_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image, 128 wide, with a flat opaque colour for each order by its status."""
    key = F.col("o_orderkey")
    channel = lambda k: F.element_at(F.create_map(*(F.lit(x) for s, c in STATUS_COLORS.items() for x in (s, c[k]))), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.lit(0).cast("long").alias("image_id"), (key % 128).cast("int").alias("x"), F.floor(key / 128).cast("int").alias("y"),
        channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), F.lit(255).alias("a"),
    )


def region_of(x: Column, y: Column) -> Column:
    """Regions of 16 x 16 pixels, four in a row, from 1."""
    return F.lit(1) + F.floor(x / 16).cast("int") + 4 * F.floor(y / 16).cast("int")


def residue_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet with planted residue: regions removed, kept brighter, or left with the removed colours."""
    i = F.col("i")
    at = F.element_at("embedding", F.pmod(i + 3, F.lit(64)).cast("int") + 1)
    base = _cells(spark, sf_dir).select(F.lit(0).cast("long").alias("image_id"), i.alias("x"), F.col("vec_id").cast("int").alias("y"), *_channels(i)[:3], _byte(at).alias("_t"))
    kind = F.col("region_id") * 7 % 10
    lift = lambda c: F.when((kind >= 4) & (kind <= 7), F.least(F.lit(255), F.col(c) + 110)).otherwise(F.col(c)).alias(c)
    alpha = F.when(kind < 4, 0).when(F.col("_t") < 90, 40).otherwise(255).alias("a")
    return base.withColumn("region_id", region_of(F.col("x"), F.col("y"))).select("image_id", "x", "y", lift("r"), lift("g"), lift("b"), alpha, "region_id")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cand_no, x0, y0, x1, y1, score): boxes with inclusive corners, one for each part."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    x0, y0 = k * 37 % 240, k * 91 % 240
    return table(spark, sf_dir, "part").select(k.alias("cand_no"), x0.alias("x0"), y0.alias("y0"), (x0 + 4 + s % 16).alias("x1"), (y0 + 4 + 7 * s % 16).alias("y1"), F.col("p_retailprice").alias("score"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles with a background of almost one colour around their inner 4 x 4 pixels; every tenth one is clear on one side."""
    inner = F.col("x").between(2, 5) & F.col("y").between(2, 5)
    plain = lambda c: F.when(inner, F.col(c)).otherwise(F.lit(120) + F.floor(F.col(c) / 16).cast("int")).alias(c)
    clear = (F.col("image_id") % 10 == 0) & (F.col("x") < 3)
    return tiles(spark, sf_dir).select("image_id", "x", "y", plain("r"), plain("g"), plain("b"), F.when(clear, 0).otherwise(255).alias("a"))


#: Colours of the patches in turn (the second and third are alike, the fifth is near the palette), and the palette.
PATCH_COLORS = ((200, 10, 20), (10, 20, 220), (14, 28, 200), (10, 180, 40), (180, 180, 243))
PATCH_PALETTE = ((243, 243, 243), (130, 185, 250))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet as a light ground with a patch of 24 x 16 pixels every 40 rows."""
    inside = F.col("x").between(8, 31) & (F.col("y") % 40).between(4, 19)
    colors = F.array(*(F.array(*map(F.lit, c)) for c in PATCH_COLORS))
    patch = F.element_at(colors, F.floor(F.col("y") / 40).cast("int") % 5 + 1)
    part = lambda k, c: F.when(inside, F.element_at(patch, k + 1)).otherwise(240) + F.floor(F.col(c) / 32).cast("int")
    return sheet(spark, sf_dir).select("image_id", "x", "y", *(part(k, c).alias(c) for k, c in enumerate("rgb")), F.lit(255).alias("a"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, cand_no, x, y, score): each embedding is a candidate mask of 8 x 8 pixels on the image of its label."""
    found = tiles(spark, sf_dir).where("a >= 128").select(F.col("image_id").alias("cand_no"), "x", "y")
    about = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cand_no"), F.col("label").cast("long").alias("image_id"), F.element_at("embedding", 1).cast("double").alias("score"))
    return found.join(about, "cand_no").select("image_id", "cand_no", "x", "y", "score")


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, point, k, iou, x, y, logit): four candidates for each point (embedding) on the image of its label, 8 x 8 logits each."""
    at = lambda i: F.element_at("embedding", i.cast("int")).cast("double")
    cells = table(spark, sf_dir, "embeddings").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    cells = cells.select("*", (F.lit(0.8) + at(F.col("k") + 1)).alias("iou"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    logit = at(F.pmod(F.col("i") + F.col("k") * 16, F.lit(64)) + 1)
    return cells.select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("point"), "k", "iou", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), logit.alias("logit"))


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, region_id, x, y): for each supplier a disc, every fourth one stretched, on 61 x 61 pixels."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("image_id"), (6 + F.col("s_suppkey") % 20).alias("_r"), F.when(F.col("s_suppkey") % 4 == 0, 9).otherwise(16).alias("_k"))
    grid = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("y"))
    inside = (F.col("x") - 30) * (F.col("x") - 30) * F.col("_k") + (F.col("y") - 30) * (F.col("y") - 30) * 16 <= F.col("_r") * F.col("_r") * 16
    return grid.where(inside).select("image_id", F.lit(1).alias("region_id"), "x", "y")


#: What each drawing begins with, and the fills of its elements in turn: attribute, what is left of it without its fill, colour.
DRAWING_HEAD = '<svg width="64" height="48"><defs><linearGradient id="g"/></defs>'
FILLS = (
    (' fill="#1e90ff"', "", "#1e90ff"),
    (' style="stroke:red;fill: rgb(10, 20,30);x:1"', ' style="stroke:red;x:1"', "#0a141e"),
    (' fill="url(#g)"', ' fill="url(#g)"', None),
    (' fill="Red"', "", "#ff0000"),
    ("", "", None),
)


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, svg): a drawing for every 20 parts, an element for each; three neighbours have one fill."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    fill = F.element_at(F.array(*(F.lit(f[0]) for f in FILLS)), (F.floor(key / 3) % 5 + 1).cast("int"))
    shape = (
        F.when(key % 3 == 0, F.concat(F.lit("<path"), fill, F.lit(' d="M'), size, F.lit('"/>')))
        .when(key % 3 == 1, F.concat(F.lit("<circle"), fill, F.lit("><title>"), "p_brand", F.lit("</title></circle>")))
        .otherwise(F.concat(F.lit("<rect"), fill, F.lit("/>")))
    )
    docs = table(spark, sf_dir, "part").groupBy(F.floor(key / 20).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", shape.alias("s")))).alias("all"))
    body = F.array_join(F.transform("all", lambda e: e["s"]), "\n")
    return docs.select("doc_id", F.concat(F.lit(DRAWING_HEAD), body, F.lit("</svg>")).alias("svg"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, stroke, seq, x, y, radius, hardness, flow, mode): points of four strokes over the sheet, by turns for each supplier."""
    key = F.col("s_suppkey")
    kind = key % 4
    return table(spark, sf_dir, "supplier").select(
        F.lit(0).cast("long").alias("image_id"), kind.cast("int").alias("stroke"), key.alias("seq"), (key * 37 % 64).cast("double").alias("x"), (key * 53 % 120).cast("double").alias("y"),
        (kind * 3 + 4).cast("double").alias("radius"), (kind * 30).cast("double").alias("hardness"), F.lit(70.0).alias("flow"), F.when(kind % 2 == 1, "restore").otherwise("erase").alias("mode"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, op, event_id, ts): error is undo, signup is redo, all else an edit."""
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("op"), "ts", "value")


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, seq, stage, progress)"""
    progress = F.least(F.lit(1.0), F.col("value") / 500)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), progress.alias("progress"))
