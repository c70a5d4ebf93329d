"""Which regions of a cut-out are left-over background: their colours are those of the removed pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import background_histogram, histogram_stats
from ..operators.joins import with_frequency
from ..operators.windows import IMAGE


def residue_regions(source: DataFrame, matte: DataFrame, labels: DataFrame, solid: float = 0.8, least: float = 0.1, times: float = 3.0, sure: float = 0.18) -> DataFrame:
    """(image_id, region_id, score, kept, size, x0, y0, x1, y1) of regions that match the removed colours far more than others do.
    A pixel matches by its colour bin's share among the removed pixels: min(1, 3 * share / largest share)."""
    at = [IMAGE, "x", "y"]
    px = source.drop("a", "region_id").join(matte.select(*at, "a"), at).join(labels.select(*at, "region_id"), at)
    hist = background_histogram(px)
    stats = histogram_stats(hist).select(IMAGE, "max_freq")
    matched = with_frequency(px, hist).join(stats, IMAGE).withColumn("match", F.least(F.lit(1.0), F.col("freq") * 3 / F.col("max_freq")))
    regions = matched.groupBy(IMAGE, "region_id").agg(
        F.round(F.avg("match"), 6).alias("score"), (F.count_if(F.col("a") > 128) / F.count(F.lit(1))).alias("kept"), F.count(F.lit(1)).alias("size"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    )
    whole = regions.where(F.col("kept") >= solid)
    typical = whole.groupBy(IMAGE).agg(F.median("score").alias("typical"))
    chosen = (F.col("score") > least) & ((F.col("score") > F.col("typical") * times) | (F.col("score") >= sure))
    return whole.join(typical, IMAGE).where(chosen).drop("typical")
