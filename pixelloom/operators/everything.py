"""Segment everything, after the decode: candidates of a point grid are filtered by predicted overlap, stability and area, each
point keeps its best, overlapping masks of an image are suppressed, and what is left becomes a label map and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import discard, stored
from .graph import greedy
from .joins import close_pairs, close_to, packed_masks
from .windows import IMAGE

POINT = [IMAGE, "point"]


def col(name: str) -> Column:
    return F.col(name)


def best_candidates(decoded: DataFrame, least_iou: float, offset: float, least_stability: float, least_area: float) -> DataFrame:
    """(image_id, point, k, score, area, x0, y0, x1, y1) of decoded masks (image_id, point, k, iou, x, y, logit): of each point the candidate
    of the highest score (overlap times stability), the first on a tie. Where a point has four, the first one is left out."""
    on = col("logit") > 0
    stats = decoded.groupBy(*POINT, "k").agg(
        F.max("iou").alias("iou"), F.count_if(col("logit") > offset).alias("_hi"), F.count_if(col("logit") > -offset).alias("_lo"), F.count_if(on).alias("area"),
        *(f(F.when(on, col(c))).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))),
    )
    stability = F.when(col("_lo") == 0, 0.0).otherwise(col("_hi") / col("_lo"))
    fit = stats.withColumn("_s", stability).where((col("iou") >= least_iou) & (col("_s") >= least_stability) & (col("area") >= least_area))
    most = stats.groupBy(*POINT).agg(F.max("k").alias("_most"))
    fit = fit.join(most, POINT).where((col("_most") < 3) | (col("k") > 0)).withColumn("score", col("iou") * col("_s"))
    best = fit.groupBy(*POINT).agg(F.max(F.struct("score", (-col("k")).alias("n"), "area", "x0", "y0", "x1", "y1")).alias("m"))
    return best.select(*POINT, (-col("m.n")).alias("k"), *(f"m.{c}" for c in ("score", "area", "x0", "y0", "x1", "y1")))


#: Masks of an image, about, that the first round of suppression looks at; each further round takes four times as many.
FIRST = 256
_SHARES = 40


def _best(open_: DataFrame, most: int) -> DataFrame:
    """(image_id, _all, _cut): of each image's open masks, the value of s up to which there are some `most` of them, equal ones together;
    _all: whether there are no more. Nothing is sorted: shares are powers of a half, and their values come from partial sketches."""
    shares = F.percentile_approx("s", F.array(*(F.lit(0.5**k) for k in range(_SHARES))), F.lit(10_000))
    found = open_.groupBy(IMAGE).agg(F.count(F.lit(1)).alias("_n"), shares.alias("_v"), F.min("s").alias("_least"))
    halves = F.least(F.lit(_SHARES), F.greatest(F.lit(1), F.ceil(F.log2(col("_n") / most)) + 1)).cast("int")
    return found.select(IMAGE, (col("_n") <= most).alias("_all"), F.greatest("_least", F.element_at("_v", halves)).alias("_cut"))


def suppressed(masks: DataFrame, scores: DataFrame, above: float) -> DataFrame:
    """(image_id, cand_no, kept): greedy suppression within each image, best scores first, lower numbers first on a tie. A mask goes if
    one that stays shares more than `above` of their union with it. masks: (image_id, cand_no, x, y), scores: (image_id, cand_no, score).
    A round settles the best open masks of each image among themselves and drops all others that one of those that stay suppresses,
    so that masks meet those that stay, not all pairs of them."""
    key = [IMAGE, "cand_no"]
    words, boxes = packed_masks(masks)
    every = stored(scores.select(*key, (-col("score")).alias("s")), "ranks")
    open_, most, chosen = every, FIRST, []
    while not open_.isEmpty():
        cut = open_.join(_best(open_, most), IMAGE)
        cut = stored(cut.withColumn("_best", col("_all") | col("s").isNull() | (col("s") <= col("_cut"))).select(*key, "s", F.coalesce("_best", F.lit(True)).alias("_best")), "cut")
        best, rest = cut.where("_best").select(*key, "s"), cut.where("NOT _best").select(*key, "s")
        ranks = best.select(F.struct(*key).alias("node"), F.struct("s", "cand_no").alias("rank"))
        clash = close_pairs(*(t.join(best.select(*key), key, "left_semi") for t in (words, boxes)), above)
        ra, rb = (best.select(IMAGE, col("cand_no").alias(c), F.struct("s", "cand_no").alias(f"_{c}")) for c in "ab")
        sides = clash.join(ra, [IMAGE, "a"]).join(rb, [IMAGE, "b"])
        first = col("_a") < col("_b")
        side = lambda x, y: F.struct(col(IMAGE), F.when(first, col(x)).otherwise(col(y)).alias("cand_no"))  # noqa: B023, E731
        found = greedy(ranks, sides.select(side("a", "b").alias("better"), side("b", "a").alias("worse")))
        kept = stored(found.where("kept").select(f"node.{IMAGE}", "node.cand_no"), "kept")
        chosen.append(kept)
        left = stored(rest.join(close_to(words, boxes, rest.select(*key), kept, above), key, "left_anti"), "open")
        discard(cut, *([open_] if open_ is not every else []))
        open_, most = left, most * 4
    kept = every.select(*key).limit(0)
    for part in chosen:
        kept = kept.union(part)
    return every.select(*key).join(kept.withColumn("kept", F.lit(True)), key, "left").select(*key, F.coalesce("kept", F.lit(False)).alias("kept"))


def everything(decoded: DataFrame, least_iou: float = 0.8, offset: float = 1.0, least_stability: float = 0.9, least_area: float = 0.0, overlap: float = 0.7) -> DataFrame:
    """(image_id, idx, point, k, score, area, x0, y0, x1, y1) of the masks that stay, numbered by score."""
    best = stored(best_candidates(decoded, least_iou, offset, least_stability, least_area), "best")
    masks = decoded.where("logit > 0").join(best.select(*POINT, "k"), [*POINT, "k"], "left_semi").select(IMAGE, col("point").alias("cand_no"), "x", "y")
    kept = suppressed(masks, best.select(IMAGE, col("point").alias("cand_no"), "score"), overlap).where("kept").select(IMAGE, col("cand_no").alias("point"))
    order = Window.partitionBy(IMAGE).orderBy(F.desc("score"), "point")
    return best.join(kept, POINT, "left_semi").select(IMAGE, (F.row_number().over(order) - 1).alias("idx"), "point", "k", "score", "area", "x0", "y0", "x1", "y1")


def label_map(decoded: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, x, y, label, grey): number of the smallest mask on each pixel, from 1, the lower one on a tie; 0 where there is none.
    grey: the label as a byte."""
    px = decoded.select(IMAGE, "x", "y").distinct()
    masks = decoded.where("logit > 0").join(found.select(*POINT, "k", "idx", "area"), [*POINT, "k"])
    best = masks.groupBy(IMAGE, "x", "y").agg(F.min(F.struct("area", "idx")).alias("m")).select(IMAGE, "x", "y", (col("m.idx") + 1).alias("_l"))
    label = F.coalesce("_l", F.lit(0))
    return px.join(best, [IMAGE, "x", "y"], "left").select(IMAGE, "x", "y", label.alias("label"), F.least(F.lit(255), label).alias("grey"))


def summary(found: DataFrame) -> DataFrame:
    """(image_id, summary): one JSON text for each image with its masks, in their order."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "point", "k", "area", F.array("x0", "y0", "x1", "y1").alias("bbox"))))
    return found.groupBy(IMAGE).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"), rows.alias("masks"))).alias("summary"))
