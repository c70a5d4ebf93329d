"""Queries on histograms, palettes, joins, windows and stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up, percentile_95, pick
from ..functions.text import crop_boxes, grid_points
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import nearest as nr
from ..operators import palettes as pl
from ..operators import windows as wn
from ..sources import fixtures as fx
from .catalogue import BIN, DISCS, LUMA, MASKS, MEDIAN, PALETTE, RECTANGLES, RESIDUE, SHEET, SIZED, STATUS, TILES, bucket_sql, col, d2_sql, query, sql_even
from .image_plan import Options, features, run_plan
from .residue import residue_regions as residue

AT = ["image_id", "x", "y"]
HIST = f"hist AS (SELECT image_id, bin, cnt, cnt::DOUBLE / sum(cnt) OVER (PARTITION BY image_id) AS freq FROM (SELECT image_id, {BIN} AS bin, count(*) AS cnt FROM px WHERE a < 26 GROUP BY 1, 2))"

# --- aggregates ----------------------------------------------------------------------------------------------------------


@query("A1 J1", f"WITH {SHEET}, {HIST} SELECT * FROM hist")
def bg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.background_histogram(fx.sheet(spark, sf_dir))


@query("A1", f"WITH {TILES}, {HIST} SELECT image_id, max(freq) AS max_freq, sum(cnt)::BIGINT AS bg_pixels, count(*) AS nonzero_bins FROM hist GROUP BY image_id")
def bg_histogram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.histogram_stats(ag.background_histogram(fx.tiles(spark, sf_dir)))


@query("A2", f"""WITH {SHEET}, {SIZED}, outer_px AS (SELECT * FROM sized WHERE NOT (x >= w * 0.225e0 AND x < w * 0.775e0 AND y >= h * 0.225e0 AND y < h * 0.775e0))
SELECT image_id, {BIN} AS bin, count(*) AS cnt FROM outer_px WHERE a < 26 GROUP BY 1, 2""")
def frame_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.background_histogram(ag.outside_box(fx.sheet(spark, sf_dir))).drop("freq")


@query("A3", f"WITH {TILES} SELECT image_id, count(DISTINCT {bucket_sql(4)}) AS unique_colors FROM px WHERE a > 16 GROUP BY image_id")
def color_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.color_cardinality(fx.tiles(spark, sf_dir))


SOBEL_SQL = f"""l AS (SELECT image_id, x, y, {LUMA} AS l FROM px),
row_parts AS (SELECT image_id, x, y, lead(l) OVER w - lag(l) OVER w AS d, lag(l) OVER w + 2 * l + lead(l) OVER w AS m FROM l WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
sobel AS (SELECT image_id, x, y, abs(lag(d) OVER h + 2 * d + lead(d) OVER h) + abs(lead(m) OVER h - lag(m) OVER h) AS magnitude FROM row_parts WINDOW h AS (PARTITION BY image_id, x ORDER BY y))"""


@query("S1", f"WITH {TILES}, {SOBEL_SQL} SELECT * FROM sobel WHERE magnitude IS NOT NULL")
def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.sobel(fx.tiles(spark, sf_dir))


@query("A4", f"WITH {TILES}, {SOBEL_SQL} SELECT image_id, count(*) FILTER (magnitude > 48)::DOUBLE / count(*) AS edge_density FROM sobel WHERE magnitude IS NOT NULL GROUP BY image_id")
def edge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.sobel(fx.tiles(spark, sf_dir)).groupBy("image_id").agg((F.count_if(col("magnitude") > 48) / F.count(F.lit(1))).alias("edge_density"))


@query("A7 W9", f"WITH {TILES}, {MEDIAN} SELECT * FROM median")
def border_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.border_median(fx.tiles(spark, sf_dir))


UNIFORM_SQL = "uniform AS (SELECT b.image_id, count(*) FILTER (sqrt(((b.r - m.r) * (b.r - m.r) + (b.g - m.g) * (b.g - m.g) + (b.b - m.b) * (b.b - m.b))::DOUBLE) < 40)::DOUBLE / count(*) AS uniformity FROM border b JOIN median m USING (image_id) GROUP BY b.image_id)"


@query("A5 A6", f"WITH {TILES}, {MEDIAN}, {UNIFORM_SQL} SELECT image_id, uniformity, uniformity > 0.62e0 AS flat FROM uniform")
def flat_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.border_uniformity(fx.tiles(spark, sf_dir)).withColumn("flat", col("uniformity") > 0.62)


@query("A4 A5 PF25 PF26 O3", f"""WITH {TILES}, {MEDIAN}, {UNIFORM_SQL}, {SOBEL_SQL},
e AS (SELECT image_id, count(*) FILTER (magnitude > 48)::DOUBLE / count(*) AS edge_density FROM sobel WHERE magnitude IS NOT NULL GROUP BY image_id),
c AS (SELECT image_id, count(DISTINCT {bucket_sql(4)}) FILTER (a > 16) AS unique_colors FROM px GROUP BY image_id)
SELECT image_id, unique_colors, edge_density, uniformity, CASE WHEN uniformity >= 0.7e0 AND unique_colors <= 90 THEN 'logo' WHEN uniformity >= 0.7e0 THEN 'ilustracion'
 WHEN uniformity >= 0.45e0 AND unique_colors >= 1500 AND edge_density < 0.16e0 THEN 'producto' ELSE 'foto' END AS profile FROM c JOIN e USING (image_id) JOIN uniform USING (image_id)""")
def profile_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(fx.tiles(spark, sf_dir))


@query("A8 A19 PF27", f"""WITH {TILES}, f AS (SELECT image_id, count(*) FILTER (a > 128)::DOUBLE / count(*) AS kept, count(*) FILTER (a < 239)::DOUBLE / count(*) AS translucent FROM px GROUP BY image_id)
SELECT *, CASE WHEN kept < 0.015e0 THEN 'subject-vanished' WHEN kept > 0.985e0 THEN 'nothing-removed' ELSE 'ok' END AS verdict FROM f""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.alpha_fractions(fx.tiles(spark, sf_dir))


@query("A9", f"WITH {TILES} SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM px WHERE a > 200 GROUP BY image_id")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.bounding_box(fx.tiles(spark, sf_dir), 200)


@query("", f"""WITH {RESIDUE}, s AS (SELECT image_id, region_id, count(*) AS area, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x::BIGINT * x + y::BIGINT * y)::BIGINT AS s2, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM px WHERE a > 128 GROUP BY 1, 2)
SELECT image_id, region_id, area, sx::DOUBLE / area AS cx, sy::DOUBLE / area AS cy, bw::DOUBLE / bh AS aspect, area::DOUBLE / (bw * bh) AS fill, round(s2::DOUBLE / area - (sx::DOUBLE / area) * (sx::DOUBLE / area) - (sy::DOUBLE / area) * (sy::DOUBLE / area), 6) AS moment FROM s""")
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.region_shapes(fx.residue_raster(spark, sf_dir).where("a > 128"))


#: Least area, then limits of aspect (both), fill (both), border deviation and radius error, for a mask and for a component.
CIRCLES = {"mask": (200, 0.93, 1.07, 0.74, 0.83, 0.045, 0.06), "component": (0, 0.91, 1.1, 0.73, 0.84, 0.055, 0.07)}


def _circle_sql(kind: str) -> str:
    least, a0, a1, f0, f1, dev, err = CIRCLES[kind]
    return f"""WITH {DISCS}, s AS (SELECT image_id, region_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, (max(x) - min(x) + 1)::DOUBLE AS bw, (max(y) - min(y) + 1)::DOUBLE AS bh FROM discs GROUP BY 1, 2),
n AS (SELECT *, coalesce(lag(x) OVER w = x - 1, false) AND coalesce(lead(x) OVER w = x + 1, false) AND coalesce(lag(y) OVER h = y - 1, false) AND coalesce(lead(y) OVER h = y + 1, false) AS core FROM discs
  WINDOW w AS (PARTITION BY image_id, region_id, y ORDER BY x), h AS (PARTITION BY image_id, region_id, x ORDER BY y)),
d AS (SELECT image_id, region_id, avg(d) AS m, avg(d * d) AS m2 FROM (SELECT n.image_id, n.region_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM n JOIN s USING (image_id, region_id) WHERE NOT core) GROUP BY 1, 2),
f AS (SELECT *, sqrt(area / pi()) AS radius, sqrt(greatest(0e0, m2 - m * m)) / m AS dev FROM s JOIN d USING (image_id, region_id) WHERE area >= {least})
SELECT image_id, region_id, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round((m + radius) / 2, 6) AS r FROM f WHERE bw / bh > {a0}e0 AND bw / bh < {a1}e0 AND area / (bw * bh) > {f0}e0 AND area / (bw * bh) < {f1}e0 AND dev < {dev}e0 AND abs(m - radius) / radius < {err}e0"""


@query("A10", _circle_sql("mask"))
def circle_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.circles(fx.discs(spark, sf_dir), *CIRCLES["mask"])


@query("A10", _circle_sql("component"))
def circle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.circles(fx.discs(spark, sf_dir), *CIRCLES["component"])


@query("A11 T1", f"WITH {SHEET}, {PALETTE} SELECT * FROM palette")
def palette_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.palette(fx.sheet(spark, sf_dir))


_EXACT = "exact AS (SELECT *, sum(cnt) OVER (PARTITION BY image_id)::BIGINT AS total FROM (SELECT image_id, r, g, b, count(*) AS cnt, min((y, x)) AS first FROM px WHERE a >= 128 GROUP BY 1, 2, 3, 4))"


@query("A12 A27", f"""WITH {SHEET}, {_EXACT}, kept AS (SELECT * FROM exact WHERE cnt > total * 0.001e0 OR (r, g, b) IN (SELECT DISTINCT r, g, b FROM px WHERE x = y AND a >= 128))
SELECT image_id, CAST(idx AS INT) AS idx, r, g, b, cnt FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first) - 1 AS idx FROM kept) WHERE idx < 64""")
def exact_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return ag.exact_palette(px, share=0.001, protected=px.where("x = y AND a >= 128"))


@query("A14", f"""WITH {STATUS}, {_EXACT} SELECT image_id, CAST(idx AS INT) AS idx, r, g, b, cnt FROM (
 SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first) - 1 AS idx FROM exact WHERE cnt > total * 0.004e0 AND cnt >= 24) WHERE idx < 10""")
def mini_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.exact_palette(fx.status_raster(spark, sf_dir), share=0.004, top=10, least=24)


_DOMINANT = f"""d AS (SELECT image_id, {bucket_sql(5)} AS key, count(*) AS cnt, min({{'y': y, 'x': x, 'r': r, 'g': g, 'b': b}}) AS first FROM px WHERE a >= 128 GROUP BY 1, 2),
dominant AS (SELECT image_id, first.r AS r, first.g AS g, first.b AS b, cnt FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first) AS k FROM d) WHERE k = 1)"""


@query("A13 H8", f"WITH {TILES}, {_DOMINANT} SELECT * FROM dominant")
def dominant_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.dominant_color(fx.tiles(spark, sf_dir))


@query("S20 T10", f"WITH {SHEET.replace('px AS', 'every AS')}, px AS (SELECT * FROM every WHERE x BETWEEN 8 AND 40 AND y BETWEEN 10 AND 300), {_DOMINANT} SELECT * FROM dominant")
def marquee_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.dominant_color(fx.sheet(spark, sf_dir).where(col("x").between(8, 40) & col("y").between(10, 300)))


@query("A20", f"""WITH {TILES}, s AS (SELECT image_id, {', '.join(f'count(*) * sum({c} * {c})::BIGINT - sum({c})::BIGINT * sum({c})::BIGINT AS v{c}' for c in 'rgb')} FROM px WHERE a > 0 GROUP BY image_id)
SELECT image_id, CASE WHEN vr >= vg AND vr >= vb THEN 'r' WHEN vg >= vb THEN 'g' ELSE 'b' END AS channel, greatest(vr, vg, vb) AS spread FROM s""")
def channel_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.channel_variance(fx.tiles(spark, sf_dir))


@query("A18", "SELECT vec_id, label, hi, lo, CASE WHEN lo = 0 THEN 0e0 ELSE hi::DOUBLE / lo END AS stability FROM (SELECT vec_id, label, len(list_filter(embedding, lambda v: v > 0.05e0)) AS hi, len(list_filter(embedding, lambda v: v > -0.05e0)) AS lo FROM embeddings)")
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = lambda t: F.size(F.filter("embedding", lambda v: v.cast("double") > t)).cast("long")
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", "label", over(0.05).alias("hi"), over(-0.05).alias("lo"))
    return e.withColumn("stability", F.when(col("lo") == 0, 0.0).otherwise(col("hi") / col("lo")))


@query("A23", "SELECT p_brand AS brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS pos, p_partkey AS member, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part")
def group_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's members in order, a row for each, and the category's first one, by which categories are ordered."""
    w = Window.partitionBy("p_brand")
    ordered = w.orderBy("p_partkey")
    return fx.table(spark, sf_dir, "part").select(col("p_brand").alias("brand"), (F.row_number().over(ordered) - 1).alias("pos"), col("p_partkey").alias("member"), F.first("p_partkey").over(ordered).alias("first"))


@query("A24 A25 A27b", """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS done, sum(CAST(floor(value * 100 + 0.5e0) AS BIGINT))::BIGINT AS cents FROM events GROUP BY user_id""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.floor(col("value") * 100 + 0.5).cast("long")
    return fx.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(col("event_type") == "error").alias("errors"), F.count_if(col("event_type") == "purchase").alias("done"), F.sum(cents).alias("cents"))


_BRIGHT = "marked AS (SELECT *, CASE WHEN r >= 128 THEN 1 ELSE 0 END AS m FROM px)"


def _box(values: str, r: int, frame: str = "RANGE") -> str:
    """SQL of box sums: cols v -> s over x, then over y."""
    return f"""bx AS (SELECT *, sum({values}) OVER w AS sx, count(*) OVER w AS nx FROM src WINDOW w AS (PARTITION BY image_id, y ORDER BY x {frame} BETWEEN {r} PRECEDING AND {r} FOLLOWING)),
by_ AS (SELECT *, sum(sx) OVER w AS s, sum(nx) OVER w AS n FROM bx WINDOW w AS (PARTITION BY image_id, x ORDER BY y {frame} BETWEEN {r} PRECEDING AND {r} FOLLOWING))"""


@query("A15", f"""WITH {SHEET}, labels AS (SELECT image_id, x, y, CAST(r // 16 AS INT) AS label FROM px),
n AS (SELECT *, lag(label) OVER w AS l1, lead(label) OVER w AS l2, lag(label) OVER h AS l3, lead(label) OVER h AS l4 FROM labels WINDOW w AS (PARTITION BY image_id, y ORDER BY x), h AS (PARTITION BY image_id, x ORDER BY y)),
f AS (SELECT image_id, label, count(*) AS cnt, count(*) FILTER (l1 = label AND l2 = label) AS core FROM n GROUP BY 1, 2), t AS (SELECT *, sum(cnt) OVER () AS total FROM f)
SELECT image_id, label, cnt, core FROM t WHERE cnt < total * 0.05e0 AND core < cnt * 0.35e0""")
def thin_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.sheet(spark, sf_dir).select(*AT, F.floor(col("r") / 16).cast("int").alias("label"))
    w = wn.along("x")
    core = labels.withColumns({"_l": F.lag("label").over(w), "_r": F.lead("label").over(w)}).where("_l = label AND _r = label")
    return ag.thin_colors(labels, core)


@query("A16 A17 J7 flagship", f"""WITH {RESIDUE}, {HIST}, stats AS (SELECT image_id, max(freq) AS max_freq FROM hist GROUP BY 1),
m AS (SELECT p.*, least(1e0, coalesce(h.freq, 0e0) * 3 / s.max_freq) AS match FROM (SELECT *, {BIN} AS bin FROM px) p LEFT JOIN hist h USING (image_id, bin) JOIN stats s USING (image_id)),
r AS (SELECT image_id, region_id, round(avg(match), 6) AS score, count(*) FILTER (a > 128)::DOUBLE / count(*) AS kept, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY 1, 2),
k AS (SELECT *, median(score) OVER (PARTITION BY image_id) AS typical FROM r WHERE kept >= 0.8e0)
SELECT image_id, region_id, score, kept, size, x0, y0, x1, y1 FROM k WHERE score > 0.1e0 AND (score > typical * 3 OR score >= 0.18e0)""")
def residue_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.residue_raster(spark, sf_dir)
    return residue(px, px, px)


IOU = """areas AS (SELECT image_id, cand_no, count(*) AS area FROM masks GROUP BY 1, 2),
met AS (SELECT p.image_id, p.cand_no AS a, q.cand_no AS b, count(*) AS common FROM masks p JOIN masks q ON q.image_id = p.image_id AND p.x = q.x AND p.y = q.y AND p.cand_no < q.cand_no GROUP BY 1, 2, 3),
iou AS (SELECT m.image_id, a, b, common, na.area + nb.area - common AS joint FROM met m JOIN areas na ON na.image_id = m.image_id AND na.cand_no = a JOIN areas nb ON nb.image_id = m.image_id AND nb.cand_no = b)"""

# --- joins ---------------------------------------------------------------------------------------------------------------


@query("J1", f"WITH {TILES} SELECT s.image_id, s.x, s.y, s.r, s.g, s.b, m.a FROM px s JOIN px m ON s.image_id = m.image_id AND s.x = 7 - m.x AND s.y = m.y")
def source_with_matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.tiles(spark, sf_dir)
    return jn.source_with_matte(px, px.withColumn("x", 7 - col("x")))


@query("J2", f"WITH {SHEET}, {HIST} SELECT image_id, x, y, coalesce(freq, 0e0) AS freq FROM (SELECT *, {BIN} AS bin FROM px) LEFT JOIN hist USING (image_id, bin)")
def hist_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return jn.with_frequency(px, ag.background_histogram(px)).select(*AT, "freq")


_NEAREST = f"near AS (SELECT p.*, min({{'d2': ({d2_sql('p.', 'q.')}), 'idx': q.idx}}) AS best FROM px p JOIN palette q USING (image_id) GROUP BY ALL)"


@query("J3 H10", f"WITH {SHEET}, {PALETTE}, {_NEAREST} SELECT image_id, x, y, best.idx AS label, best.d2 AS d2 FROM near")
def nearest_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return jn.nearest(px, ag.palette(px)).select(*AT, "label", "d2")


@query("A21", f"WITH {SHEET}, {PALETTE}, {_NEAREST} SELECT image_id, round(count(*) FILTER (a >= 128 AND best.d2 > 30 * 30)::DOUBLE / greatest(1, count(*) FILTER (a >= 128)), 9) AS fraction, count(*) FILTER (a >= 128 AND best.d2 > 30 * 30)::DOUBLE / greatest(1, count(*) FILTER (a >= 128)) < 0.12e0 AND greatest(max(x), max(y)) + 1 >= 600 AS clean FROM near GROUP BY image_id")
def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return ag.clean_flag(jn.nearest(px, ag.palette(px)))


@query("J4", f"WITH {SHEET}, {PALETTE}, {_NEAREST} SELECT image_id, count(*) FILTER (a >= 128) AS opaque, count(*) FILTER (a >= 128 AND best.d2 > 48 * 48) AS far FROM near GROUP BY image_id")
def far_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    near = jn.nearest(px, ag.palette(px))
    return near.groupBy("image_id").agg(F.count_if(col("a") >= 128).alias("opaque"), F.count_if((col("a") >= 128) & (col("d2") > 48 * 48)).alias("far"))


@query("J5 O4", f"""WITH {RECTANGLES}, p AS (SELECT a.cand_no AS a, b.cand_no AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * (least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) AS common,
 (a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) + (b.x1 - b.x0 + 1) * (b.y1 - b.y0 + 1) AS total FROM boxes a JOIN boxes b ON a.cand_no < b.cand_no AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
SELECT a, b, common, total - common AS joint FROM p""")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.overlapping(fx.rectangles(spark, sf_dir))


@query("J6 D4", f"""WITH {MASKS}, {IOU} SELECT image_id, a, b, common, joint FROM iou WHERE common > joint * 0.45e0""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.iou_pairs(fx.masks(spark, sf_dir), 0.45)


@query("J7 J8", f"""WITH {SHEET}, labels AS (SELECT image_id, CAST(x // 2 AS INT) AS lx, CAST(y // 2 AS INT) AS ly, CAST(r // 16 AS INT) AS region_id FROM px WHERE x % 2 = 0 AND y % 2 = 0)
SELECT p.image_id, p.x, p.y, l.region_id FROM px p LEFT JOIN labels l ON l.image_id = p.image_id AND l.lx = CAST(floor(p.x / 2e0) AS INT) AND l.ly = CAST(floor(p.y / 2e0) AS INT)""")
def label_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    half = lambda c: F.floor(col(c) / 2).cast("int").alias(c)
    labels = px.where("x % 2 = 0 AND y % 2 = 0").select("image_id", half("x"), half("y"), F.floor(col("r") / 16).cast("int").alias("region_id"))
    return jn.rescaled(px, labels, 64, 2, 32, 1).select(*AT, "region_id")


_CROPS = [(0, 0, 0, 240, 240)] + [(1 + xi + 2 * yi, xi * 80, yi * 80, xi * 80 + 160, yi * 80 + 160) for yi in range(2) for xi in range(2)]


@query("J9", f"""WITH {RECTANGLES}, c(box_id, x0, y0, x1, y1) AS (VALUES {', '.join(map(str, _CROPS))}),
m AS (SELECT b.cand_no, b.x0 AS px, b.y0 AS py, min({{'size': (c.x1 - c.x0) * (c.y1 - c.y0), 'id': c.box_id}}) AS m FROM boxes b JOIN c ON b.x0 >= c.x0 AND b.x0 < c.x1 AND b.y0 >= c.y0 AND b.y0 < c.y1 GROUP BY 1, 2, 3)
SELECT cand_no, px, py, m.id AS box_id FROM m""")
def point_in_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(_CROPS, "box_id int, x0 int, y0 int, x1 int, y1 int")
    return jn.smallest_box(fx.rectangles(spark, sf_dir).select("cand_no", col("x0").alias("px"), col("y0").alias("py")), boxes)


_MASK = "mask AS (SELECT image_id, x, y FROM px WHERE r >= 154)"


@query("J10 PF22", f"WITH {SHEET}, {_MASK} SELECT p.image_id, p.x, p.y, p.a FROM px p SEMI JOIN mask USING (image_id, x, y) WHERE p.a >= 128")
def mask_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return px.where("a >= 128").join(px.where("r >= 154").select(*AT), AT, "left_semi").select(*AT, "a")


@query("J10 PF22", f"WITH {SHEET}, {_MASK} SELECT p.image_id, p.x, p.y, p.a FROM px p ANTI JOIN mask USING (image_id, x, y) WHERE p.a >= 128")
def mask_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return px.where("a >= 128").join(px.where("r >= 154").select(*AT), AT, "left_anti").select(*AT, "a")


@query("J11 D10", f"""WITH {STATUS} SELECT image_id, x, y, CASE WHEN r = 30 THEN 1 ELSE r END AS r, CASE WHEN r = 30 THEN 2 ELSE g END AS g, CASE WHEN r = 30 THEN 3 ELSE b END AS b, a FROM px WHERE r <> 220""")
def palette_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = spark.createDataFrame([(220, 20, 60, None, None, None, True), (30, 144, 255, 1, 2, 3, None)], "r int, g int, b int, tr int, tg int, tb int, remove boolean")
    return jn.edited(fx.status_raster(spark, sf_dir), edits)


@query("J12 W7 D17", """WITH f AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, role, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run, turn FROM f)
SELECT conv_id, run, CASE role WHEN 'user' THEN 'human' ELSE role END AS role, count(*) AS n, min(turn) AS first FROM r WHERE role <> 'system' GROUP BY 1, 2, 3""")
def color_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = jn.runs(fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")
    edits = spark.createDataFrame([("user", "human", False), ("system", None, True)], "role string, to string, remove boolean")
    joined = runs.join(F.broadcast(edits), "role", "left").where(~F.coalesce("remove", F.lit(False)))
    return joined.groupBy("conv_id", "run", F.coalesce("to", "role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))


# --- windows -------------------------------------------------------------------------------------------------------------


@query("W1 O7", f"WITH {SHEET}, src AS (SELECT * FROM px), {_box('a', 3)} SELECT image_id, x, y, (s / n)::DOUBLE AS mean FROM (SELECT image_id, x, y, s::DOUBLE AS s, n::DOUBLE AS n FROM by_)")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.box_mean(fx.sheet(spark, sf_dir), "a", 3, "mean").select(*AT, "mean")


def _pad_sql(axis: str, value: str, src: str, out: str, r: int) -> str:
    other = "y" if axis == "x" else "x"
    every = f"(PARTITION BY image_id, {other})"
    w = f"(PARTITION BY image_id, {other} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    low, high = f"greatest(0, {r} - ({axis} - min({axis}) OVER {every}))", f"greatest(0, {r} - (max({axis}) OVER {every} - {axis}))"
    return f"{out} AS (SELECT *, sum({value}) OVER {w} + {low} * arg_min({value}, {axis}) OVER {every} + {high} * arg_max({value}, {axis}) OVER {every} AS s_{axis} FROM {src})"


@query("W2", f"WITH {TILES}, {_pad_sql('x', 'a', 'px', 'p1', 2)}, {_pad_sql('y', 's_x', 'p1', 'p2', 2)} SELECT image_id, x, y, {sql_even('s_y::DOUBLE / 25e0')} AS a FROM p2")
def feather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.feather(fx.tiles(spark, sf_dir), 2).select(*AT, "a")


@query("W3", f"""WITH {SHEET}, h AS (SELECT *, sum(a) OVER (PARTITION BY image_id, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS t FROM px)
SELECT image_id, x, y, (sum(t) OVER (PARTITION BY image_id, x ORDER BY y ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM h""")
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.integral(fx.sheet(spark, sf_dir), "a").select(*AT, "total")


def _extreme(f: str, value: str, axis: str, r: int, src: str, out: str) -> str:
    other = "y" if axis == "x" else "x"
    w = f"(PARTITION BY image_id, {other} ORDER BY {axis} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    found = f"{f}({value}) OVER {w}"
    if f == "min":
        found = f"CASE WHEN count(*) OVER {w} < {2 * r + 1} THEN 0 ELSE {found} END"
    return f"{out} AS (SELECT image_id, x, y, {found} AS v FROM {src})"


_ERODE = f"{_extreme('min', 'a', 'x', 1, 'px', 'e1')}, {_extreme('min', 'v', 'y', 1, 'e1', 'e2')}"


@query("W4", f"WITH {TILES}, {_ERODE} SELECT image_id, x, y, v FROM e2")
def erode_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.eroded(fx.tiles(spark, sf_dir), "a", 1, "v").select(*AT, "v")


@query("W4", f"WITH {TILES}, {_ERODE}, {_extreme('max', 'v', 'x', 1, 'e2', 'd1')}, {_extreme('max', 'v', 'y', 1, 'd1', 'd2')} SELECT image_id, x, y, v FROM d2")
def open_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.opened(fx.tiles(spark, sf_dir), "a", 1, "v").select(*AT, "v")


_COVER = f"{RECTANGLES}, m AS (SELECT cand_no, x::BIGINT AS x, y::BIGINT AS y FROM boxes, range(240 + 40) a(x), range(240 + 40) b(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"


@query("W5 T11", f"WITH {_COVER} SELECT x, y, min(cand_no) AS cand_no FROM m GROUP BY x, y")
def partition_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.first_of(jn.box_pixels(fx.rectangles(spark, sf_dir).select("cand_no", col("cand_no").alias("pos"), "x0", "y0", "x1", "y1")))


@query("W6 T3 D5 IO15", f"WITH {_COVER}, n AS (SELECT cand_no, count(*) AS area FROM m GROUP BY 1), b AS (SELECT x, y, min((area, cand_no)) AS best FROM m JOIN n USING (cand_no) GROUP BY x, y) SELECT x, y, best[2] AS cand_no FROM b")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (col("x1") - col("x0") + 1) * (col("y1") - col("y0") + 1)
    return jn.smallest_label(jn.box_pixels(fx.rectangles(spark, sf_dir).select("cand_no", area.alias("area"), "x0", "y0", "x1", "y1")))


@query("W8 T2", f"WITH {RECTANGLES} SELECT cand_no, score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, cand_no) AS k FROM boxes) WHERE k <= 256")
def rank_and_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fx.rectangles(spark, sf_dir).orderBy(F.desc("score"), "cand_no").limit(256)
    return top.select("cand_no", "score", F.row_number().over(Window.orderBy(F.desc("score"), "cand_no")).alias("rank"))


@query("W9 H7", f"WITH {TILES}, k AS (SELECT image_id, a, row_number() OVER (PARTITION BY image_id ORDER BY a) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM px) SELECT image_id, a FROM k WHERE i = least(n - 1, CAST(floor(n * 0.95e0) AS BIGINT))")
def percentile_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick("a", percentile_95(), ["image_id"])(fx.tiles(spark, sf_dir).select("image_id", "a"))


@query("W10", """WITH s AS (SELECT event_id, user_id, least(1e0, value / 500) AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, (i + p) / n AS progress FROM s""")
def progress_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("job")
    e = fx.progress_events(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("seq")) - 1, "n": F.count(F.lit(1)).over(w)})
    return e.select(col("seq").alias("event_id"), ((col("i") + col("progress")) / col("n")).alias("progress"))


@query("W11 H11", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS k, list_max(embedding)::DOUBLE AS v FROM embeddings")
def best_per_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform("embedding", lambda v, k: F.struct(v.cast("double").alias("v"), (-k).alias("k")))
    best = F.array_max(entries)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", (-best["k"]).alias("k"), best["v"].alias("v"))


@query("W12 O11", f"WITH {STATUS}, l AS (SELECT CASE r WHEN 34 THEN 0 WHEN 30 THEN 1 ELSE 2 END AS label FROM px) SELECT i::INT AS layer, count(*) AS pixels FROM l, range(3) t(i) WHERE label >= i GROUP BY 1")
def cumulative_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(col("r") == 34, 0).when(col("r") == 30, 1).otherwise(2)
    return fx.status_raster(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), label)).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("pixels"))


@query("W14 IO17", "SELECT p_partkey, p_brand || CASE WHEN k = 1 THEN '' ELSE '-' || (k - 1) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return fx.table(spark, sf_dir, "part").withColumn("k", k).select("p_partkey", F.concat("p_brand", F.when(col("k") == 1, "").otherwise(F.concat(F.lit("-"), (col("k") - 1).cast("string")))).alias("name"))


# --- stencils ------------------------------------------------------------------------------------------------------------

_NB = "WINDOW w AS (PARTITION BY image_id, y ORDER BY x), h AS (PARTITION BY image_id, x ORDER BY y)"


@query("S3", f"""WITH {TILES}, v AS (SELECT *, CASE WHEN a > 0 THEN {{'r': r, 'g': g, 'b': b}} END AS c FROM px), n AS (SELECT *, coalesce(lag(c) OVER w, lead(c) OVER w, lag(c) OVER h, lead(c) OVER h) AS n FROM v {_NB}),
g AS (SELECT *, a = 0 AND n IS NOT NULL AS grown FROM n) SELECT image_id, x, y, CASE WHEN grown THEN n.r ELSE r END AS r, CASE WHEN grown THEN n.g ELSE g END AS g, CASE WHEN grown THEN n.b ELSE b END AS b, CASE WHEN grown THEN 255 ELSE a END AS a, grown FROM g""")
def dilate_1px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.dilated_one(fx.tiles(spark, sf_dir))


_ER = lambda src, out: f"{out} AS (SELECT image_id, x, y, CASE WHEN a > 30 AND (coalesce(lag(a) OVER w <= 30, false) OR coalesce(lead(a) OVER w <= 30, false) OR coalesce(lag(a) OVER h <= 30, false) OR coalesce(lead(a) OVER h <= 30, false)) THEN 0 ELSE a END AS a FROM {src} {_NB})"


@query("S2 H17", f"WITH {SHEET}, {_ER('px', 'p1')}, {_ER('p1', 'p2')} SELECT * FROM p2")
def erode_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.eroded_alpha(fx.sheet(spark, sf_dir), 2).select(*AT, "a")


def sums_sql(names: list[str], src: str, out: str, r: int) -> str:
    """out: src plus t_<name>, the sums over the box of radius r, and n, its pixels."""
    wx = f"(PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    wy = f"(PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    one = f"SELECT *, {', '.join(f'sum({v}) OVER {wx} AS s_{v}' for v in names)}, count(*) OVER {wx} AS nn FROM {src}"
    return f"{out} AS (SELECT * EXCLUDE ({', '.join('s_' + v for v in names)}, nn), {', '.join(f'sum(s_{v}) OVER {wy} AS t_{v}' for v in names)}, sum(nn) OVER {wy} AS n FROM ({one}))"


def _guided_sql(r: int, eps: float) -> str:
    sums = lambda names, src, out: sums_sql(names, src, out, r)
    return f"""l0 AS (SELECT *, {LUMA} AS l FROM px), l1 AS (SELECT *, l * l AS ll, l * a AS la, a::DOUBLE AS ad FROM l0), {sums(['l', 'll', 'la', 'ad'], 'l1', 'l2')},
l3 AS (SELECT image_id, x, y, l, n, t_l / n AS ml, t_ll / n AS mll, t_la / n AS mla, t_ad / n AS ma FROM l2), l4 AS (SELECT *, (mla - ml * ma) / (mll - ml * ml + {eps!r}e0) AS ka FROM l3), l5 AS (SELECT image_id, x, y, l, ka, ma - ka * ml AS kb FROM l4), {sums(['ka', 'kb'], 'l5', 'l6')}"""


@query("S4", f"WITH {TILES}, {_guided_sql(2, (0.012 * 255) ** 2)} SELECT image_id, x, y, round(t_ka / n * l + t_kb / n, 4) AS alpha FROM l6")
def guided_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.guided_alpha(fx.tiles(spark, sf_dir), 2)


@query("S5", f"""WITH {TILES}, b0 AS (SELECT image_id, x, y, CASE WHEN a >= 160 THEN 1 ELSE 0 END AS v FROM px), {_extreme('min', 'v', 'x', 1, 'b0', 'b1')}, {_extreme('min', 'v', 'y', 1, 'b1', 'b2')}, {_extreme('max', 'v', 'x', 1, 'b2', 'b3')}, {_extreme('max', 'v', 'y', 1, 'b3', 'b4')},
m AS (SELECT p.image_id, p.x, p.y, p.a, b4.v AS body, 1 - b4.v AS void FROM px p JOIN b4 USING (image_id, x, y)), {sums_sql(['body', 'void'], 'm', 'g', 2)},
k AS (SELECT image_id, x, y, a / 255e0 AS t, least(1e0, (t_body::DOUBLE / n) * (t_void::DOUBLE / n) / 0.25e0) AS k FROM g)
SELECT image_id, x, y, round(least(1e0, greatest(0e0, 0.5e0 + (t - 0.5e0) * (1e0 + 9e0 * k * k))), 6) AS alpha FROM k""")
def snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.snapped_alpha(fx.tiles(spark, sf_dir), r=1, window=2)


def _fringe_sql(src: str, out: str) -> str:
    return f"""{out}_n AS (SELECT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a, {', '.join(f'sum(q.{c}) FILTER (q.a > p.a + 8) AS s{c}, sum(q.{c}) FILTER (q.a > p.a) AS w{c}' for c in 'rgb')},
 count(*) FILTER (q.a > p.a + 8) AS ns, count(*) FILTER (q.a > p.a) AS nw FROM {src} p JOIN {src} q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) GROUP BY ALL),
{out} AS (SELECT image_id, x, y, {', '.join(f'CASE WHEN a > 0 AND a < 250 AND ns > 0 THEN CAST(s{c} // ns AS INT) WHEN a > 0 AND a < 250 AND nw > 0 THEN CAST(w{c} // nw AS INT) ELSE {c} END AS {c}' for c in 'rgb')}, a FROM {out}_n)"""


@query("S6 H3", f"WITH {TILES}, {_fringe_sql('px', 'f1')}, {_fringe_sql('f1', 'f2')} SELECT * FROM f2")
def defringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.defringed(fx.tiles(spark, sf_dir))


@query("S8 H2", f"""WITH {TILES} SELECT image_id, x, y, {', '.join(f"CASE WHEN a = 0 THEN {c} ELSE {sql_even(f'3.4e0 * {c} - 0.6e0 * (coalesce(lag({c}) OVER h, {c}) + coalesce(lead({c}) OVER h, {c}) + coalesce(lag({c}) OVER w, {c}) + coalesce(lead({c}) OVER w, {c}))')} END AS {c}" for c in 'rgb')}, a FROM px {_NB}""")
def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.unsharp(fx.tiles(spark, sf_dir), 50)


@query("S23", f"""WITH {SHEET}, mask AS (SELECT image_id, x, y FROM px WHERE a >= 128), n AS (SELECT m.image_id, m.x, m.y, count(q.x) AS k FROM mask m LEFT JOIN mask q ON q.image_id = m.image_id AND abs(q.x - m.x) + abs(q.y - m.y) = 1 GROUP BY ALL)
SELECT image_id, x, y FROM n WHERE k < 4""")
def border_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.border_ring(fx.sheet(spark, sf_dir).where("a >= 128").select(*AT))


_OUTLINE = f"""WITH {TILES}, e AS (SELECT image_id, greatest(1, CAST(floor(greatest(max(x) + 1, max(y) + 1) * 40 / 100e0 * 0.05e0 + 0.5e0) AS INT)) AS b, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY 1),
g AS (SELECT image_id, b, u::INT - (b + CAST(ceil(b * 0.6e0) AS INT)) AS x, v::INT - (b + CAST(ceil(b * 0.6e0) AS INT)) AS y FROM e, range(20) s(u), range(20) t(v) WHERE u < w + 2 * (b + ceil(b * 0.6e0)) AND v < h + 2 * (b + ceil(b * 0.6e0))),
s AS (SELECT image_id, x AS sx, y AS sy FROM px WHERE a >= 128), d AS (SELECT g.image_id, g.x, g.y, g.b, min(greatest(abs(g.x - sx), abs(g.y - sy)) + least(abs(g.x - sx), abs(g.y - sy)) * 0.4142136e0) AS d FROM g LEFT JOIN s ON s.image_id = g.image_id AND abs(g.x - sx) <= b AND abs(g.y - sy) <= b GROUP BY ALL),
o AS (SELECT d.image_id, d.x, d.y, coalesce(d.d <= d.b, false) AS band, p.r, p.g, p.b, coalesce(p.a, 0) AS a FROM d LEFT JOIN px p USING (image_id, x, y))
SELECT image_id, x, y, {', '.join(f"CASE WHEN band THEN CAST(floor(coalesce({c}, 0) * (a / 255e0) + {v} * (1 - a / 255e0) + 0.5e0) AS INT) ELSE coalesce({c}, 0) END AS {c}" for c, v in zip('rgb', (10, 200, 30)))}, CASE WHEN band OR a >= 128 THEN 255 ELSE 0 END AS a FROM o"""


@query("S24", _OUTLINE)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.outlined(fx.tiles(spark, sf_dir), 40, (10, 200, 30))


@query("", f"""WITH {TILES}, s AS (SELECT image_id, x, y FROM px WHERE a > 200), d AS (SELECT p.image_id, p.x, p.y, min(greatest(abs(p.x - s.x), abs(p.y - s.y)) + least(abs(p.x - s.x), abs(p.y - s.y)) * (sqrt(2e0) - 1)) AS d FROM px p JOIN s USING (image_id) GROUP BY ALL)
SELECT image_id, x, y, round(d, 6) AS d FROM d WHERE d <= 3""")
def distance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.distance_band(fx.tiles(spark, sf_dir), 3, 200)


@query("S30", f"""WITH {TILES}, up AS (SELECT image_id, 2 * x + k AS x, y, v + (CASE WHEN k = 0 THEN b ELSE f END - v) * 0.25e0 AS v FROM (
  SELECT image_id, x, y, a::DOUBLE AS v, coalesce(lag(a::DOUBLE) OVER w, a::DOUBLE) AS b, coalesce(lead(a::DOUBLE) OVER w, a::DOUBLE) AS f FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), (VALUES (0), (1)) t(k)),
dn AS (SELECT image_id, x, 2 * y + k AS y, v + (CASE WHEN k = 0 THEN b ELSE f END - v) * 0.25e0 AS v FROM (SELECT image_id, x, y, v, coalesce(lag(v) OVER w, v) AS b, coalesce(lead(v) OVER w, v) AS f FROM up WINDOW w AS (PARTITION BY image_id, x ORDER BY y)), (VALUES (0), (1)) t(k))
SELECT image_id, x, y, round(v, 6) AS v FROM dn""")
def upsample_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.bilinear(fx.tiles(spark, sf_dir), "a", 2)


@query("S31 O17", f"WITH {SHEET} SELECT tx::INT AS tile_x, ty::INT AS tile_y, count(*) AS pixels, count(*) FILTER (x // 32 = tx AND y // 32 = ty) AS core FROM px, range(3) a(tx), range(100) b(ty) WHERE x BETWEEN tx * 32 - 4 AND tx * 32 + 35 AND y BETWEEN ty * 32 - 4 AND ty * 32 + 35 GROUP BY 1, 2")
def tile_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = wn.tiles_with_halo(fx.sheet(spark, sf_dir), 32, 4)
    return dealt.groupBy("tile_x", "tile_y").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("core").alias("core"))


def _taps_sql(weights: dict[int, float], axis: str, value: str) -> str:
    other = "y" if axis == "x" else "x"
    o, every = f"(PARTITION BY image_id, {other} ORDER BY {axis})", f"(PARTITION BY image_id, {other})"
    at = lambda k: value if k == 0 else f"coalesce(lag({value}, {-k}) OVER {o}, arg_min({value}, {axis}) OVER {every})" if k < 0 else f"coalesce(lead({value}, {k}) OVER {o}, arg_max({value}, {axis}) OVER {every})"
    return " + ".join(f"{at(k)} * {w!r}::DOUBLE" for k, w in sorted(weights.items()))


@query("S29", f"""WITH {TILES}, v AS (SELECT image_id, x, y, a::DOUBLE AS v FROM px), h AS (SELECT image_id, x, y, {_taps_sql(wn.gaussian_weights(1.0), 'x', 'v')} AS v FROM v), t AS (SELECT image_id, x, y, {_taps_sql(wn.gaussian_weights(1.0), 'y', 'v')} AS v FROM h)
SELECT image_id, x, y, CASE WHEN round(v, 6) >= 128 THEN 255 ELSE 0 END AS v FROM t""")
def blur_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.blurred_mask(fx.tiles(spark, sf_dir), "a", 1.0)


def _lanczos_sql(axis: str, src: str, out: str) -> str:
    other = "y" if axis == "x" else "x"
    taps = ", ".join(f"{_taps_sql(wn.lanczos_weights(2, k), axis, 'v')} AS v{k}" for k in range(2))
    return f"{out} AS (SELECT image_id, {other}, 2 * {axis} + k AS {axis}, CASE WHEN k = 0 THEN v0 ELSE v1 END AS v FROM (SELECT *, {taps} FROM {src}), (VALUES (0), (1)) t(k))"


@query("S29", f"WITH {TILES}, v AS (SELECT image_id, x, y, a::DOUBLE AS v FROM px), {_lanczos_sql('x', 'v', 'h')}, {_lanczos_sql('y', 'h', 't')} SELECT image_id, x, y, {sql_even('round(v, 6)')} AS v FROM t")
def lanczos_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.lanczos(fx.tiles(spark, sf_dir), "a", 2)


@query("S31", f"WITH {SHEET}, src AS (SELECT * FROM px), {_box('a', 3)} SELECT image_id, x, y, (s / n)::DOUBLE AS mean FROM (SELECT image_id, x, y, s::DOUBLE AS s, n::DOUBLE AS n FROM by_)")
def tiled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.tiled(fx.sheet(spark, sf_dir), lambda px: wn.box_mean(px, "a", 3, "mean"), 32, 4).select(*AT, "mean")


# --- grouped Python and plans --------------------------------------------------------------------------------------------


@query("S19 H18")
def palette_agglomerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.agglomerated(ag.palette(fx.tiles(spark, sf_dir), share=0.0), 48, 6)


def _nearest_sql(name: str, mark: str) -> str:
    """name(image_id, x, y, m): the nearest marked pixel of px, as a struct (d, part, tie, x, y, r, g, b)."""
    return f"""{name}_s AS (SELECT image_id, x AS sx, y AS sy, r, g, b FROM px WHERE {mark}),
{name}_p AS (SELECT p.image_id, p.x, p.y, s.sx, s.sy, s.r, s.g, s.b, CASE WHEN sy <= p.y THEN CASE WHEN sx <= p.x THEN 0 ELSE 1 END WHEN sx > p.x THEN 2 ELSE 3 END AS part FROM px p JOIN {name}_s s USING (image_id)),
{name} AS (SELECT image_id, x, y, min({{'d': abs(x - sx) + abs(y - sy), 'part': part, 'tie': CASE WHEN part = 2 THEN -sx ELSE sx END, 'x': sx, 'y': sy, 'r': r, 'g': g, 'b': b}}) AS m FROM {name}_p GROUP BY image_id, x, y)"""


@query("J14", f"WITH {TILES}, {_nearest_sql('near', 'a > 200')} SELECT image_id, x, y, m.d AS d, m.x AS nx, m.y AS ny FROM near")
def feature_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nr.nearest_marked(fx.tiles(spark, sf_dir), {"near": col("a") > 200}).where("near IS NOT NULL")
    return found.select(*AT, col("near.d").alias("d"), col("near.x").alias("nx"), col("near.y").alias("ny"))


_MASKED = "CASE WHEN 10 - f.m.d < 4 THEN CAST(floor(o.g * (10 - f.m.d) / 4e0 + 0.5e0) AS INT) ELSE o.g END"


@query("S25", f"""WITH {TILES}, {_nearest_sql('fg', 'a > 128')}, {_nearest_sql('bg', 'a < 16')},
t AS (SELECT p.*, o.r AS nr, o.g AS ng, o.b AS nb, {_MASKED} AS m, coalesce(f.m.d <= 10 AND {_MASKED} > p.a AND NOT coalesce({d2_sql('bg.m.', 'o.')} < {d2_sql('f.m.', 'o.')}, false), false) AS take
  FROM px p JOIN px o ON o.image_id = p.image_id AND o.y = p.y AND o.x = 7 - p.x LEFT JOIN fg f ON f.image_id = p.image_id AND f.x = p.x AND f.y = p.y LEFT JOIN bg ON bg.image_id = p.image_id AND bg.x = p.x AND bg.y = p.y)
SELECT image_id, x, y, {', '.join(f'CASE WHEN take THEN n{c} ELSE {c} END AS {c}' for c in 'rgb')}, CASE WHEN take THEN m ELSE a END AS a FROM t""")
def edge_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.tiles(spark, sf_dir)
    return nr.recovered(px, px.withColumns({"x": 7 - col("x"), "m": col("g")}))


@query("D18 O2 O3")
def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_plan(fx.tiles(spark, sf_dir), Options(background=(255, 255, 255)))


@query("F15 stage", """WITH s AS (SELECT DISTINCT p_size, p_size * 20 AS w, p_size * 13 AS h FROM part), o AS (SELECT *, CAST(floor(512 / 1500e0 * least(w, h)) AS INT) AS o FROM s),
c AS (SELECT *, CAST(ceil((o + w) / 2e0) AS INT) AS cw, CAST(ceil((o + h) / 2e0) AS INT) AS ch FROM o),
b AS (SELECT p_size, 0 AS layer, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM s UNION ALL SELECT p_size, 1, (cw - o) * i, (ch - o) * j, least(w, (cw - o) * i + cw), least(h, (ch - o) * j + ch) FROM c, range(2) t(i), range(2) u(j))
SELECT p_size, layer, CAST(floor(x0 + (i + 0.5e0) / 8 * (x1 - x0) + 0.5e0) AS INT) AS x, CAST(floor(y0 + (j + 0.5e0) / 8 * (y1 - y0) + 0.5e0) AS INT) AS y FROM b, range(8) t(i), range(8) u(j)""")
def everything_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each crop of an 8 x 8 grid, for the fan-out of decodes: (part, layer, x, y)."""
    sizes = fx.table(spark, sf_dir, "part").select("p_size").distinct()
    crops = sizes.select("p_size", F.inline(crop_boxes(col("p_size") * 20, col("p_size") * 13, 1)))
    points = crops.select("p_size", "layer", "x0", "y0", "x1", "y1", F.inline(grid_points(8)))
    return points.select("p_size", "layer", half_up(col("x0") + col("px") * (col("x1") - col("x0"))).alias("x"), half_up(col("y0") + col("py") * (col("y1") - col("y0"))).alias("y"))
