"""Queries on contours, texture, protected pixels, the model registry and timeouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contour_lines as cn
from ..operators import contours as ct
from ..operators import curves as cv
from ..operators import sets as st
from ..sources import fixtures as fx
from .catalogue import LOG, LUMA, SHEET, TILES, col, query, sql_half_up
from .queries_regions import sums_sql
from .shared import stored

AT = ["image_id", "x", "y"]


@query("S7", f"""WITH {TILES}, m AS (SELECT *, CASE WHEN a >= 200 THEN 1e0 ELSE 0e0 END AS m FROM px), {sums_sql(['m'], 'm', 'g', 1)},
i AS (SELECT image_id, x, y, CASE WHEN t_m / n > 0.05e0 THEN 1e0 ELSE 0e0 END AS p, ({LUMA}) / 255e0 AS i FROM g), j AS (SELECT *, i * i AS ii, i * p AS ip FROM i), {sums_sql(['i', 'p', 'ii', 'ip'], 'j', 'k', 2)},
l AS (SELECT image_id, x, y, i, t_i / n AS mi, t_p / n AS mp, (t_ip / n - t_i / n * (t_p / n)) / (t_ii / n - t_i / n * (t_i / n) + 4e-4) AS ka FROM k), o AS (SELECT image_id, x, y, i, ka, mp - ka * mi AS kb FROM l), {sums_sql(['ka', 'kb'], 'o', 'q', 2)},
t AS (SELECT image_id, x, y, least(1e0, greatest(0e0, round((t_ka / n * i + t_kb / n - {0.5 - 0.16!r}e0) / 0.32e0, 9))) AS t FROM q) SELECT image_id, x, y, {sql_half_up('t * t * (3 - 2 * t) * 255')} AS alpha FROM t""")
def region_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.refined_edges(fx.tiles(spark, sf_dir), col("a") >= 200, r=2)


@query("", f"""WITH {TILES}, c AS (SELECT image_id, x - dx AS x, y - dy AS y, CASE WHEN a >= 128 THEN k ELSE 0 END AS code FROM px, (VALUES (0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)) t(dx, dy, k))
SELECT image_id, x, y, CAST(sum(code) AS INT) AS code FROM c GROUP BY image_id, x, y HAVING sum(code) NOT IN (0, 15)""")
def contour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.contour_cells(fx.tiles(spark, sf_dir))


@query("D22", f"""WITH {TILES}, c AS (SELECT image_id, x - dx AS x, y - dy AS y, CASE WHEN a >= 128 THEN k ELSE 0 END AS code FROM px, (VALUES (0, 0, 1), (1, 0, 2), (1, 1, 4), (0, 1, 8)) t(dx, dy, k)),
n AS (SELECT image_id, sum(code) AS code FROM c GROUP BY image_id, x, y HAVING sum(code) NOT IN (0, 15)) SELECT image_id, sum(CASE WHEN code IN (5, 10) THEN 2 ELSE 1 END)::BIGINT AS segments FROM n GROUP BY image_id""")
def contour_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.contour_length(ct.contour_cells(fx.tiles(spark, sf_dir)))


_SIDES = """cells AS (SELECT p.image_id, p.x AS cx, p.y AS cy, [p.a, r.a, e.a, d.a] AS c FROM px p JOIN px r ON r.image_id = p.image_id AND r.x = p.x + 1 AND r.y = p.y
  JOIN px d ON d.image_id = p.image_id AND d.x = p.x AND d.y = p.y + 1 JOIN px e ON e.image_id = p.image_id AND e.x = p.x + 1 AND e.y = p.y + 1),
sides AS (SELECT image_id, cx, cy, i, c[i + 1] >= 128 AS here, c[(i + 1) % 4 + 1] >= 128 AS there, list_sum(c) >= 510 AS full_cell, round((127.5e0 - c[i + 1]) / (c[(i + 1) % 4 + 1] - c[i + 1]), 12) AS t FROM cells, range(4) s(i)),
crossed AS (SELECT *, count(*) OVER (PARTITION BY image_id, cx, cy) AS n,
  round(CASE i WHEN 0 THEN cx + t WHEN 1 THEN cx + 1 WHEN 2 THEN cx + 1 - t ELSE cx END, 6) AS x, round(CASE i WHEN 0 THEN cy WHEN 1 THEN cy + t WHEN 2 THEN cy + 1 ELSE cy + 1 - t END, 6) AS y FROM sides WHERE here <> there)"""


@query("", f"""WITH {TILES}, {_SIDES} SELECT a.image_id, a.cy, a.cx, a.i::INT AS side, b.i::INT AS to_side, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by
FROM crossed a JOIN crossed b ON b.image_id = a.image_id AND b.cx = a.cx AND b.cy = a.cy AND a.here AND b.there AND (a.n = 2 OR b.i = (a.i + CASE WHEN a.full_cell THEN 1 ELSE 3 END) % 4)""")
def contour_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.segments(fx.tiles(spark, sf_dir)).drop("from_point", "to_point")


@query("S26")
def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cn.contours(cn.segments(fx.tiles(spark, sf_dir)))


@query("S28")
def contour_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic curves, none further than half a pixel from the contours."""
    return cv.curves(stored(cn.stitched(cn.segments(fx.tiles(spark, sf_dir))), "lines"), 0.5)


@query("S29", f"""WITH {TILES}, b AS (SELECT p.image_id, p.x, p.y, list_sort(list(q.a)) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL)
SELECT image_id, x, y, v[len(v) // 2 + 1] AS v FROM b""")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.median_filtered(fx.tiles(spark, sf_dir))


@query("S32 H20", f"""WITH {TILES}, l AS (SELECT *, {LUMA} AS l FROM px), {sums_sql(['l'], 'l', 'g', 1)}, f AS (SELECT *, CASE WHEN abs(l - t_l / n) < 8 THEN (1 - abs(l - t_l / n) / 8e0) * 0.35e0 ELSE 0e0 END AS f FROM g)
SELECT f.image_id, f.x, f.y, {', '.join(f"{sql_half_up(f'round(f.{c} * (1 - f) + o.{c} * f, 6)')} AS {c}" for c in 'rgb')} FROM f JOIN px o ON o.image_id = f.image_id AND o.x = 7 - f.x AND o.y = f.y""")
def texture_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.tiles(spark, sf_dir)
    return ct.texture_restored(px, px.withColumn("x", 7 - col("x")))


@query("T9 D16", f"""WITH {SHEET}, hidden AS (SELECT image_id, x, y FROM px WHERE r >= 180), locked AS (SELECT image_id, x, y FROM px WHERE g >= 180), tinted AS (SELECT image_id, x, y FROM px WHERE b < 60)
SELECT image_id, x, y FROM px WHERE a >= 128 EXCEPT (SELECT * FROM hidden UNION SELECT * FROM locked UNION SELECT * FROM tinted)""")
def protected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return st.minus(px.where("a >= 128"), *(px.where(c) for c in ("r >= 180", "g >= 180", "b < 60")))


#: Input side and sigmoid flag of the known model kinds.
MODELS = (("saliency", 1024, True), ("portrait", 512, False), ("promptable", 1024, False), ("upscale", 256, False))


@query("IO18 J16 M7 D23", f"""WITH m(kind, side, sigmoid) AS (VALUES {', '.join(f"('{k}', {s}, {str(g).lower()})" for k, s, g in MODELS)})
SELECT p_partkey, kind, side, sigmoid FROM part JOIN m ON kind = CASE p_partkey % 5 WHEN 0 THEN 'saliency' WHEN 1 THEN 'portrait' WHEN 2 THEN 'promptable' WHEN 3 THEN 'upscale' ELSE 'none' END""")
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(MODELS, "kind string, side int, sigmoid boolean")
    kinds = F.array(*(F.lit(k) for k, *_ in MODELS), F.lit("none"))
    wanted = F.element_at(kinds, (col("p_partkey") % 5).cast("int") + 1)
    return fx.table(spark, sf_dir, "part").select("p_partkey", wanted.alias("kind")).join(F.broadcast(registry), "kind")


@query("ST10", f"""WITH {LOG}, g AS (SELECT session, seq, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER (PARTITION BY session ORDER BY ts, seq) AS next, max(epoch_us(ts)) OVER () AS now FROM log)
SELECT session, seq, next IS NOT NULL AS answered FROM g WHERE coalesce(next, now) - t0 > 3600000000""")
def timed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.timed_out(fx.edit_log(spark, sf_dir), "session", 3600)
