"""Set algebra on masks: relations (image_id, x, y) in which a row means that the pixel is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = ["image_id", "x", "y"]


def union(*masks: DataFrame) -> DataFrame:
    every = masks[0].select(*AT)
    for m in masks[1:]:
        every = every.union(m.select(*AT))
    return every.distinct()


def minus(mask: DataFrame, *others: DataFrame) -> DataFrame:
    return mask.select(*AT).join(union(*others), AT, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AT).join(b.select(*AT), AT, "left_semi").distinct()


def effective(adds: list[DataFrame], subs: list[DataFrame]) -> DataFrame:
    return minus(union(*adds), *subs) if subs else union(*adds)


def toggled(pins: DataFrame, key: str) -> DataFrame:
    """Keys that were switched an odd number of times."""
    return pins.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key)


def bitmap(mask: DataFrame, width: int) -> DataFrame:
    """(image_id, bucket, bits): the mask as bitmaps of row-major positions."""
    p = (F.col("y") * width + F.col("x")).cast("long")
    placed = mask.select("image_id", F.bitmap_bucket_number(p).alias("bucket"), F.bitmap_bit_position(p).alias("bit"))
    return placed.groupBy("image_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


# --- masks as words: 8 x 8 pixels in the bits of one long ------------------------------------------------------------------

TILE = ["image_id", "tx", "ty"]


def packed(mask: DataFrame) -> DataFrame:
    """(image_id, tx, ty, w): bit 8 * row + column of each tile that has pixels."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod("y", F.lit(8)) * 8 + F.pmod("x", F.lit(8))).cast("int"))
    return mask.groupBy("image_id", F.floor(F.col("x") / 8).cast("int").alias("tx"), F.floor(F.col("y") / 8).cast("int").alias("ty")).agg(F.bit_or(bit).alias("w"))


def unpacked(words: DataFrame) -> DataFrame:
    """The mask of packed()."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("w"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return words.select(*TILE, F.explode(bits).alias("i")).select("image_id", (F.col("tx") * 8 + F.col("i") % 8).cast("int").alias("x"), (F.col("ty") * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"))


def packed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy(*TILE).agg(F.bit_or("w").alias("w"))


def packed_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select(*TILE, F.col("w").alias("_w")), TILE)
    return both.select(*TILE, F.col("w").bitwiseAND(F.col("_w")).alias("w")).where("w <> 0")


def packed_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.select(*TILE, F.col("w").alias("_w")), TILE, "left")
    return both.select(*TILE, F.col("w").bitwiseAND(F.bitwise_not(F.coalesce("_w", F.lit(0).cast("long")))).alias("w")).where("w <> 0")


def packed_areas(words: DataFrame) -> DataFrame:
    return words.groupBy("image_id").agg(F.sum(F.bit_count("w")).alias("area"))


def mask_pixels(mask: DataFrame) -> DataFrame:
    """A mask as an image: black, opaque where it is set; what formats.encoded() makes a file of."""
    return mask.select(*AT, *(F.lit(0).alias(c) for c in "rgb"), F.lit(255).alias("a"))


def mask_scaled(px: DataFrame, sizes: DataFrame, width: int, height: int) -> DataFrame:
    """The mask (image_id, x, y) of an image's opaque pixels (a >= 128) at another size: each pixel takes the nearest one's state. sizes:
    (image_id, w, h) of the images. Only set pixels are dealt, each to the targets whose centres lie in it."""
    found = px.where("a >= 128").select(*AT).join(sizes, "image_id")
    for axis, n, m in (("x", "w", width), ("y", "h", height)):
        first = lambda v: F.ceil((2 * v * m - F.col(n)) / (2 * F.col(n))).cast("int")  # noqa: B023, E731
        low, high = first(F.col(axis)), first(F.col(axis) + 1) - 1
        found = found.where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
    return found.select(*AT)


def mask_component(mask: DataFrame) -> DataFrame:
    """(image_id, seed_x, seed_y, x0, y0, x1, y1, area): a mask as one selection, with its first pixel in row order."""
    found = mask.groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("s"), *(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))), F.count(F.lit(1)).alias("area"))
    return found.select("image_id", F.col("s.x").alias("seed_x"), F.col("s.y").alias("seed_y"), "x0", "y0", "x1", "y1", "area")
