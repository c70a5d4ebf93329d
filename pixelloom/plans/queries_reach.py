"""Queries on reachability, greedy selection, set algebra and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import editlog as ed
from ..operators import editlog_fold as ef
from ..operators import everything as ey
from ..operators import reach as rc
from ..operators import sets as st
from ..sources import fixtures as fx
from ..streaming import events as ev
from ..streaming import undo as un
from .catalogue import DECODED, FRAMED, LOG, MASKS, PATCHES, SHEET, TILES, bucket_sql, col, d2_sql, query, sql_byte, sql_half_up
from .queries_regions import IOU
from .shared import stored

AT = ["image_id", "x", "y"]

# --- reachability: in SQL, a recursive walk from every pixel (or seed) ---------------------------------------------------


def walk_sql(src: str, diagonal: bool = False, label: str = "1") -> str:
    """comps(image_id, x, y, cy, cx): the first pixel (in row order) of each pixel's component of src."""
    near = "abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1" if diagonal else "abs(q.x - r.x) + abs(q.y - r.y) = 1"
    return f"""walk AS (SELECT image_id, x, y, x AS sx, y AS sy, {label} AS l FROM {src} UNION
  SELECT q.image_id, q.x, q.y, r.sx, r.sy, r.l FROM walk r JOIN (SELECT *, {label} AS ql FROM {src}) q ON q.image_id = r.image_id AND q.ql = r.l AND {near} WHERE (q.y, q.x) > (r.sy, r.sx)),
comps AS (SELECT image_id, x, y, min((sy, sx)) AS c FROM walk GROUP BY ALL)"""


def step_walk_sql(src: str) -> str:
    """As walk_sql for four neighbours and one label, with a join on the neighbour's place."""
    return f"""walk AS (SELECT image_id, x, y, x AS sx, y AS sy FROM {src} UNION
  SELECT q.image_id, q.x, q.y, r.sx, r.sy FROM walk r CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dx, dy) JOIN {src} q ON q.image_id = r.image_id AND q.x = r.x + dx AND q.y = r.y + dy WHERE (q.y, q.x) > (r.sy, r.sx)),
comps AS (SELECT image_id, x, y, min((sy, sx)) AS c FROM walk GROUP BY ALL)"""


def flood_sql(src: str, seed: str) -> str:
    return f"""flood AS (SELECT image_id, x, y FROM {src} WHERE {seed} UNION SELECT q.image_id, q.x, q.y FROM flood r JOIN {src} q ON q.image_id = r.image_id AND abs(q.x - r.x) + abs(q.y - r.y) = 1)"""


_EDGED = "edged AS (SELECT *, x = 0 OR y = 0 OR x = max(x) OVER (PARTITION BY image_id) OR y = max(y) OVER (PARTITION BY image_id) AS edge, count(*) OVER (PARTITION BY image_id) AS n FROM px)"


@query("S9 D11", f"WITH RECURSIVE {SHEET}, src AS (SELECT * FROM px WHERE r >= 154), {walk_sql('src')} SELECT image_id, c[1] AS cy, c[2] AS cx, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM comps GROUP BY image_id, c")
def components4(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir).where("r >= 154").withColumn("label", F.lit(1))
    return rc.component_table(px).select("image_id", col("comp.y").alias("cy"), col("comp.x").alias("cx"), "area", "x0", "y0", "x1", "y1")


@query("S10 H15", f"""WITH RECURSIVE {SHEET}, src AS (SELECT * FROM px WHERE r >= 170), {walk_sql('src', True)}, k AS (SELECT image_id, c FROM comps GROUP BY ALL HAVING count(*) >= greatest(6, (SELECT count(*) FROM px) * 0.00001e0)),
core AS (SELECT comps.* FROM comps SEMI JOIN k USING (image_id, c)) SELECT DISTINCT s.image_id, s.x, s.y FROM src s JOIN core c ON c.image_id = s.image_id AND abs(c.x - s.x) <= 3 AND abs(c.y - s.y) <= 3""")
def components8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir).withColumn("a", F.when(col("r") >= 170, 255).otherwise(0))
    return rc.significant(px, 128, 6, 0.00001, 3)


_SEED = "s AS (SELECT r AS sr, g AS sg, b AS sb FROM px WHERE x = 20 AND y = 20), dist AS (SELECT p.*, (r - sr) * (r - sr) + (g - sg) * (g - sg) + (b - sb) * (b - sb) AS d2 FROM px p, s)"


@query("S11 H17", f"""WITH RECURSIVE {SHEET}, {_SEED}, src AS (SELECT * FROM dist WHERE d2 < 90 * 90), {flood_sql('src', 'x = 20 AND y = 20')},
m AS (SELECT d.*, f.x IS NOT NULL AS core FROM dist d LEFT JOIN flood f USING (image_id, x, y)),
n AS (SELECT *, coalesce(lag(core) OVER w, false) OR coalesce(lead(core) OVER w, false) OR coalesce(lag(core) OVER h, false) OR coalesce(lead(core) OVER h, false) AS touch FROM m WINDOW w AS (PARTITION BY image_id, y ORDER BY x), h AS (PARTITION BY image_id, x ORDER BY y))
SELECT image_id, x, y, NOT core AS ring FROM n WHERE core OR (touch AND d2 < 150 * 150)""")
def flood_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.flood_color(fx.sheet(spark, sf_dir), (20, 20), 90, 150)


@query("S12 PF8", f"""WITH RECURSIVE {SHEET}, {_EDGED}, dist AS (SELECT *, sqrt(((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128))::DOUBLE) AS d FROM edged), src AS (SELECT * FROM dist WHERE d < 90), {flood_sql('src', 'edge')},
k AS (SELECT *, CASE WHEN d <= 60 THEN 0e0 ELSE (d - 60e0) / 30e0 END AS k FROM dist), t AS (SELECT k.*, f.x IS NOT NULL AND {sql_half_up('k * 255')} < a AS clear, {sql_half_up('k * 255')} AS na FROM k LEFT JOIN flood f USING (image_id, x, y))
SELECT image_id, x, y, {', '.join(f"CASE WHEN clear AND k > 0.02e0 THEN {sql_byte(f'({c} - (1 - k) * 128) / k')} ELSE {c} END AS {c}" for c in 'rgb')}, CASE WHEN clear THEN na ELSE a END AS a FROM t""")
def flood_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.flood_border(fx.sheet(spark, sf_dir), (128, 128, 128), 60.0, 90.0)


@query("S13", f"""WITH RECURSIVE {SHEET}, src AS (SELECT * FROM px WHERE (r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128) < 16 * 16 AND a >= 8), {walk_sql('src')},
b AS (SELECT image_id, c, count(*) AS area FROM comps GROUP BY ALL HAVING count(*) <= (SELECT count(*) FROM px) * 0.0015e0),
ring AS (SELECT DISTINCT b.image_id, b.c, p.x, p.y FROM b JOIN comps k ON k.image_id = b.image_id AND k.c = b.c JOIN px p ON p.image_id = b.image_id AND abs(p.x - k.x) <= 6 AND abs(p.y - k.y) <= 6),
o AS (SELECT ring.image_id, ring.c, count(*) AS total, count(q.c) AS others FROM ring LEFT JOIN comps q ON q.image_id = ring.image_id AND q.x = ring.x AND q.y = ring.y WHERE q.c IS DISTINCT FROM ring.c GROUP BY ALL)
SELECT b.image_id, b.c[1] AS cy, b.c[2] AS cx, area FROM b LEFT JOIN o ON o.image_id = b.image_id AND o.c = b.c WHERE coalesce(others <= total * 0.02e0, true)""")
def enclosed_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rc.enclosed_background(fx.sheet(spark, sf_dir), (128, 128, 128), near=16)
    return found.select("image_id", col("comp.y").alias("cy"), col("comp.x").alias("cx"), "area")


@query("S14", f"""WITH RECURSIVE {TILES}, {_EDGED}, src AS (SELECT * FROM edged WHERE a >= 200), {walk_sql('src')}, t AS (SELECT c.image_id, c.c, count(*) AS area, bool_or(edge) AS touches, any_value(n) AS n FROM comps c JOIN src USING (image_id, x, y) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, c) AS k FROM t) SELECT image_id, c[1] AS cy, c[2] AS cx, area FROM k WHERE touches AND k > 1 AND area < n * 0.1e0""")
def border_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rc.border_islands(fx.tiles(spark, sf_dir), 0.1, 200)
    return found.select("image_id", col("comp.y").alias("cy"), col("comp.x").alias("cx"), "area")


@query("S16", f"WITH RECURSIVE {TILES}, {_EDGED}, src AS (SELECT * FROM edged WHERE NOT (r >= 120)), {flood_sql('src', 'edge')} SELECT image_id, x, y FROM src ANTI JOIN flood USING (image_id, x, y) WHERE a >= 128")
def region_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.holes(fx.tiles(spark, sf_dir), col("r") >= 120)


@query("", f"""WITH RECURSIVE {SHEET}, src AS (SELECT *, {bucket_sql(3)} AS l FROM px WHERE a >= 128), {walk_sql('src', label='l')}
SELECT image_id, c[1] AS cy, c[2] AS cx, count(*) AS area FROM comps GROUP BY image_id, c HAVING count(*) FILTER (x BETWEEN 8 AND 30 AND y BETWEEN 8 AND 60) >= count(*) * 0.6e0 AND count(*) FILTER (x BETWEEN 8 AND 30 AND y BETWEEN 8 AND 60) > 0""")
def figures_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.figures_in(fx.sheet(spark, sf_dir), (8, 8, 30, 60), bits=3).select("image_id", col("comp.y").alias("cy"), col("comp.x").alias("cx"), "area")


@query("S21", f"""WITH RECURSIVE {SHEET}, src AS (SELECT *, {bucket_sql(3)} AS l, x BETWEEN 8 AND 30 AND y BETWEEN 8 AND 60 AS inside FROM px WHERE a >= 128), {walk_sql('src', label='l')},
body AS MATERIALIZED (SELECT c.image_id, c.c, x, y, r, g, b, inside FROM comps c JOIN src USING (image_id, x, y)),
figures AS MATERIALIZED (SELECT image_id, c, min((y, x, r, g, b)) FILTER (inside) AS f FROM body GROUP BY 1, 2 HAVING count(*) FILTER (inside) >= count(*) * 0.6e0 AND count(*) FILTER (inside) > 0),
core AS MATERIALIZED (SELECT body.image_id, x, y, f[3] AS fr, f[4] AS fg, f[5] AS fb FROM body JOIN figures USING (image_id, c))
SELECT image_id, x, y, false AS ring FROM core UNION ALL
SELECT DISTINCT s.image_id, s.x, s.y, true FROM src s JOIN core c ON c.image_id = s.image_id AND abs(c.x - s.x) + abs(c.y - s.y) = 1 WHERE {d2_sql('s.', 'c.f')} < 95 * 95 AND NOT EXISTS (SELECT 1 FROM core k WHERE k.image_id = s.image_id AND k.x = s.x AND k.y = s.y)""")
def figure_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.figure_mask(fx.sheet(spark, sf_dir), (8, 8, 30, 60), bits=3)


@query("S22 J13", f"WITH {SHEET}, m AS (SELECT * FROM px WHERE r >= 180) SELECT DISTINCT p.image_id, p.x, p.y FROM px p JOIN m ON m.image_id = p.image_id AND abs(m.x - p.x) + abs(m.y - p.y) <= 2")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return rc.grown(px.where("r >= 180"), px, 2)


@query("S27", f"WITH RECURSIVE {SHEET}, {_SEED}, src AS (SELECT * FROM dist WHERE sqrt(d2::DOUBLE) <= 80 AND a <> 0), {flood_sql('src', 'x = 20 AND y = 20')} SELECT * FROM flood")
def wand_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.flood_same(fx.sheet(spark, sf_dir), (20, 20), 80.0)


_THIN = "(0, 1, 6, 7)"


@query("S18", f"""WITH RECURSIVE {SHEET}, l AS (SELECT image_id, x, y, a >= 128 AS opaque, CAST(r // 32 AS INT) AS old FROM px),
s AS (SELECT 0 AS pass, image_id, x, y, CASE WHEN opaque AND old NOT IN {_THIN} THEN old END AS label, opaque AND old IN {_THIN} AS open, old FROM l UNION ALL
 SELECT pass + 1, image_id, x, y, coalesce(label, CASE WHEN open THEN list_max(list_transform(range(1, len(n) + 1), lambda i: {{'n': len(list_filter(n[1:i], lambda v: v = n[i])), 'i': -i, 'v': n[i]}})).v END), open AND len(n) = 0, old FROM (
  SELECT *, list_filter([lag(label) OVER w, lead(label) OVER w, lag(label) OVER h, lead(label) OVER h], lambda v: v IS NOT NULL) AS n FROM s WHERE pass < 40 WINDOW w AS (PARTITION BY image_id, y ORDER BY x), h AS (PARTITION BY image_id, x ORDER BY y)))
SELECT image_id, x, y, coalesce(label, old) AS label FROM s WHERE pass = 40""")
def thin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.sheet(spark, sf_dir).select(*AT, "a", F.floor(col("r") / 32).cast("int").alias("label"))
    return rc.merged_thin(labels, [0, 1, 6, 7])


_NEXT_TO_CLEAR = "(coalesce(lag(a) OVER w = 0, false) OR coalesce(lead(a) OVER w = 0, false) OR coalesce(lag(a) OVER h = 0, false) OR coalesce(lead(a) OVER h = 0, false))"
_NB = "WINDOW w AS (PARTITION BY image_id, y ORDER BY x), h AS (PARTITION BY image_id, x ORDER BY y)"


@query("S15", f"""WITH RECURSIVE {FRAMED}, z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, count(*) FILTER (a < 128)::DOUBLE / count(*) AS clear FROM px GROUP BY 1),
border AS (SELECT p.image_id, r, g, b FROM px p JOIN z USING (image_id), range(4) t(side) WHERE (side = 0 AND x = 0) OR (side = 1 AND x = w - 1) OR (side = 2 AND y = 0) OR (side = 3 AND y = h - 1)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, {', '.join(f'row_number() OVER (PARTITION BY image_id ORDER BY {c}) - 1 AS i{c}' for c in 'rgb')} FROM border),
median AS (SELECT image_id, {', '.join(f'max(CASE WHEN i{c} = n // 2 THEN {c} END) AS m{c}' for c in 'rgb')} FROM ranked GROUP BY 1),
far AS (SELECT image_id, sqrt(((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb))::DOUBLE) AS d FROM border JOIN median USING (image_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM far),
fit AS (SELECT image_id, least(34, greatest(10, {sql_half_up('max(d) FILTER (i = least(n - 1, CAST(floor(n * 0.95e0) AS BIGINT))) * 1.3e0')} + 4)) AS tol FROM placed JOIN z USING (image_id) GROUP BY image_id HAVING count(*) FILTER (d < 45)::DOUBLE / count(*) > 0.85e0 AND max(clear) < 0.05e0),
dist AS (SELECT p.*, x = 0 OR y = 0 OR x = w - 1 OR y = h - 1 AS edge, tol, (r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb) AS d2 FROM px p JOIN z USING (image_id) JOIN median USING (image_id) JOIN fit USING (image_id)),
src AS (SELECT * FROM dist WHERE a <> 0 AND d2 < tol * tol), {flood_sql('src', 'edge')},
p0 AS (SELECT d.image_id, d.x, d.y, d.d2, CASE WHEN f.x IS NULL THEN d.a ELSE 0 END AS a FROM dist d LEFT JOIN flood f USING (image_id, x, y)),
p1 AS (SELECT image_id, x, y, d2, CASE WHEN a > 0 AND d2 < 52 * 52 AND {_NEXT_TO_CLEAR} THEN 0 ELSE a END AS a FROM p0 {_NB}),
p2 AS (SELECT image_id, x, y, CASE WHEN a > 0 AND d2 < 52 * 52 AND {_NEXT_TO_CLEAR} THEN 0 ELSE a END AS a FROM p1 {_NB})
SELECT image_id, x, y, coalesce(p2.a, px.a) AS a FROM px LEFT JOIN p2 USING (image_id, x, y)""")
def adaptive_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.uniform_background(fx.framed(spark, sf_dir))


_NEAR_KNOWN = lambda a, b, limit: " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "rgb") + f" < {limit} * {limit}"


@query("S17", f"""WITH RECURSIVE {PATCHES}, pal(r, g, b) AS (VALUES {', '.join(map(str, fx.PATCH_PALETTE))}), src AS MATERIALIZED (SELECT * FROM px WHERE a >= 128 AND NOT EXISTS (SELECT 1 FROM pal q WHERE {' + '.join(f'(px.{c} - q.{c}) * (px.{c} - q.{c})' for c in 'rgb')} <= 48 * 48)),
{step_walk_sql('src')}, big AS (SELECT c.image_id, c.c, count(*) AS area, {', '.join(sql_half_up(f'avg({c})') + f' AS {c}' for c in 'rgb')} FROM comps c JOIN src USING (image_id, x, y) GROUP BY 1, 2 HAVING count(*) >= greatest(200, (SELECT {sql_half_up('count(*) * 0.0012e0')} FROM px WHERE a >= 128))),
fresh AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY c) AS k FROM big WHERE NOT EXISTS (SELECT 1 FROM pal q WHERE {_NEAR_KNOWN('big.', 'q.', 32)})),
o AS MATERIALIZED (SELECT f.image_id, f.k, list(e.k) FILTER (e.k IS NOT NULL) AS better FROM fresh f LEFT JOIN fresh e ON e.image_id = f.image_id AND e.k < f.k AND {_NEAR_KNOWN('e.', 'f.', 32)} GROUP BY 1, 2),
g AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS chosen FROM fresh UNION ALL SELECT o.image_id, o.k, CASE WHEN coalesce(list_has_any(g.chosen, o.better), false) THEN g.chosen ELSE list_append(g.chosen, o.k) END FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1)
SELECT f.image_id, c[1] AS cy, c[2] AS cx, area, r, g, b FROM fresh f JOIN (SELECT image_id, arg_max(chosen, k) AS chosen FROM g GROUP BY 1) t USING (image_id) WHERE list_contains(chosen, f.k)""")
def accent_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, cy, cx, area, r, g, b): large components far from every palette colour, with their mean colour."""
    px = fx.patches(spark, sf_dir)
    palette = spark.createDataFrame([(0, i, *c) for i, c in enumerate(fx.PATCH_PALETTE)], "image_id long, idx int, r int, g int, b int")
    return rc.accents(px, palette).select("image_id", col("comp.y").alias("cy"), col("comp.x").alias("cx"), "area", "r", "g", "b")


# --- masks: suppression, and segment everything ----------------------------------------------------------------------------


def _nms_sql(ranked: str, above: float) -> str:
    """kept(image_id, cand_no, kept) from `ranked` (a SELECT of image_id, cand_no, score) and iou(image_id, a, b, common, joint)."""
    return f"""ranked AS MATERIALIZED (SELECT image_id, cand_no, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, cand_no) AS k FROM ({ranked})),
clash AS MATERIALIZED (SELECT i.image_id, greatest(p.k, q.k) AS worse, list(least(p.k, q.k)) AS better FROM iou i JOIN ranked p ON p.image_id = i.image_id AND p.cand_no = a JOIN ranked q ON q.image_id = i.image_id AND q.cand_no = b WHERE common > joint * {above}e0 GROUP BY 1, 2),
o AS MATERIALIZED (SELECT r.image_id, r.k, coalesce(c.better, []::BIGINT[]) AS better FROM ranked r LEFT JOIN clash c ON c.image_id = r.image_id AND c.worse = r.k),
g AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS chosen FROM ranked UNION ALL
  SELECT o.image_id, o.k, CASE WHEN list_has_any(g.chosen, o.better) THEN g.chosen ELSE list_append(g.chosen, o.k) END FROM g JOIN o ON o.image_id = g.image_id AND o.k = g.k + 1),
kept AS (SELECT r.image_id, r.cand_no, list_contains(c.chosen, r.k) AS kept FROM ranked r JOIN (SELECT image_id, arg_max(chosen, k) AS chosen FROM g GROUP BY 1) c USING (image_id))"""


@query("T4 H12", f"WITH RECURSIVE {MASKS}, {IOU}, {_nms_sql('SELECT DISTINCT image_id, cand_no, score FROM masks', 0.45)} SELECT * FROM kept")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = fx.masks(spark, sf_dir)
    return ey.suppressed(masks, masks.select("image_id", "cand_no", "score").distinct(), 0.45)


#: Limits of the query: predicted overlap, offset and share of stability, area, overlap of masks.
_LIMITS = (0.75, 0.02, 0.65, 20.0, 0.45)
_EVERYTHING = f"""{DECODED}, stats AS (SELECT image_id, point, k, max(iou) AS iou, count(*) FILTER (logit > {_LIMITS[1]}e0) AS hi, count(*) FILTER (logit > -{_LIMITS[1]}e0) AS lo, count(*) FILTER (logit > 0) AS area,
  min(x) FILTER (logit > 0) AS x0, min(y) FILTER (logit > 0) AS y0, max(x) FILTER (logit > 0) AS x1, max(y) FILTER (logit > 0) AS y1 FROM decoded GROUP BY 1, 2, 3),
fit AS (SELECT *, iou * (hi::DOUBLE / lo) AS score FROM stats WHERE k > 0 AND iou >= {_LIMITS[0]}e0 AND lo > 0 AND hi::DOUBLE / lo >= {_LIMITS[2]}e0 AND area >= {_LIMITS[3]}e0),
best AS MATERIALIZED (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY image_id, point ORDER BY score DESC, k) = 1),
masks AS MATERIALIZED (SELECT d.image_id, d.point AS cand_no, x, y FROM decoded d SEMI JOIN best b ON b.image_id = d.image_id AND b.point = d.point AND b.k = d.k WHERE logit > 0), {IOU},
{_nms_sql('SELECT image_id, point AS cand_no, score FROM best', _LIMITS[4])},
every AS (SELECT b.image_id, (row_number() OVER (PARTITION BY b.image_id ORDER BY b.score DESC, b.point) - 1)::INT AS idx, b.point, b.k, b.score, b.area, b.x0, b.y0, b.x1, b.y1 FROM best b SEMI JOIN (SELECT * FROM kept WHERE kept) c ON c.image_id = b.image_id AND c.cand_no = b.point)"""


def _everything(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    decoded = stored(fx.decoded(spark, sf_dir), "decoded")
    return decoded, ey.everything(decoded, *_LIMITS)


@query("M5 M4 A18 stage", f"WITH RECURSIVE {_EVERYTHING} SELECT * REPLACE (round(score, 9) AS score) FROM every")
def segment_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _everything(spark, sf_dir)[1].withColumn("score", F.round("score", 9))


@query("IO15 D5", f"""WITH RECURSIVE {_EVERYTHING}, tops AS (SELECT d.image_id, d.x, d.y, min({{'area': e.area, 'idx': e.idx}}) AS m FROM decoded d JOIN every e ON e.image_id = d.image_id AND e.point = d.point AND e.k = d.k WHERE d.logit > 0 GROUP BY ALL)
SELECT p.image_id, p.x, p.y, coalesce(m.idx + 1, 0)::INT AS label, least(255, coalesce(m.idx + 1, 0))::INT AS grey FROM (SELECT DISTINCT image_id, x, y FROM decoded) p LEFT JOIN tops USING (image_id, x, y)""")
def label_map_grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ey.label_map(*_everything(spark, sf_dir))


@query("IO16", f"""WITH RECURSIVE {_EVERYTHING} SELECT image_id, '{{"count":' || count(*) || ',"masks":[' || string_agg('{{"idx":' || idx || ',"point":' || point || ',"k":' || k || ',"area":' || area || ',"bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']}}', ',' ORDER BY idx) || ']}}' AS summary FROM every GROUP BY image_id""")
def everything_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ey.summary(_everything(spark, sf_dir)[1])


# --- sets ----------------------------------------------------------------------------------------------------------------

_SETS = "ma AS (SELECT image_id, x, y FROM px WHERE r >= 140), mb AS (SELECT image_id, x, y FROM px WHERE g >= 140)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = fx.sheet(spark, sf_dir)
    return px.where("r >= 140").select(*AT), px.where("g >= 140").select(*AT)


@query("T6 T7", f"WITH {SHEET}, {_SETS} SELECT * FROM ma UNION SELECT * FROM mb")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.union(*_two(spark, sf_dir))


@query("T6 T9", f"WITH {SHEET}, {_SETS} SELECT * FROM ma EXCEPT SELECT * FROM mb")
def mask_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    return st.effective([a], [b])


@query("T8", f"WITH {SHEET}, {_SETS} SELECT * FROM ma INTERSECT SELECT * FROM mb")
def mask_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.intersection(*_two(spark, sf_dir))


@query("T12", "SELECT user_id FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) % 2 = 1")
def pin_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.toggled(fx.table(spark, sf_dir, "events").where("event_type = 'click'"), "user_id")


@query("D4", f"WITH {SHEET} SELECT image_id, (y * 64 + x) // 32768 + 1 AS bucket, count(*) AS pixels FROM px WHERE a >= 128 GROUP BY 1, 2")
def mask_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = fx.sheet(spark, sf_dir).where("a >= 128").select("image_id", "y", (col("x") + 1).alias("x"))  # bitmap positions start at 1
    return st.bitmap(shifted, 64).select("image_id", "bucket", F.bitmap_count("bits").alias("pixels"))


# --- edit logs and events ------------------------------------------------------------------------------------------------


_REPLAY = f"""WITH RECURSIVE {LOG}, n AS MATERIALIZED (SELECT session, seq, op, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM log),
f AS (SELECT DISTINCT session, 0::BIGINT AS k, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM log UNION ALL
 SELECT n.session, n.k, CASE WHEN op = 'edit' THEN list_append(done, seq) WHEN op = 'undo' AND len(done) > 0 THEN list_slice(done, 1, len(done) - 1) WHEN op = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
  CASE WHEN op = 'edit' THEN []::BIGINT[] WHEN op = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN op = 'redo' AND len(undone) > 0 THEN list_slice(undone, 1, len(undone) - 1) ELSE undone END
 FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1),
e AS (SELECT session, arg_max(done, k) AS done, arg_max(undone, k) AS undone FROM f GROUP BY 1)"""


@query("ST6 D15", f"""{_REPLAY}
SELECT session, {', '.join(f"(SELECT count(*)::INT FROM log l WHERE l.session = e.session AND op = '{op}') AS {op}s" for op in ('edit', 'undo', 'redo'))}, len(done)::INT AS standing, len(undone)::INT AS redoable, done[-1] AS last_edit FROM e""")
def edit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef.replayed(fx.edit_log(spark, sf_dir))


#: By turns, edits of one session go to one of two logs.
_TAGGED = "CASE WHEN seq % 3 = 0 THEN 'palette' ELSE 'fill' END"
_ROUTED = f"""WITH RECURSIVE {LOG}, n AS MATERIALIZED (SELECT session, seq, op, {_TAGGED} AS log, row_number() OVER (PARTITION BY session ORDER BY seq) AS k FROM log),
f AS (SELECT DISTINCT session, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS op, []::BIGINT[] AS done, []::BIGINT[] AS undone, NULL::BIGINT AS hit FROM log UNION ALL
 SELECT n.session, n.k, n.seq, n.op, CASE WHEN n.op = 'edit' THEN list_append(done, n.seq) WHEN n.op = 'undo' AND len(done) > 0 THEN list_slice(done, 1, len(done) - 1) WHEN n.op = 'redo' AND len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END,
  CASE WHEN n.op = 'edit' THEN []::BIGINT[] WHEN n.op = 'undo' AND len(done) > 0 THEN list_append(undone, done[-1]) WHEN n.op = 'redo' AND len(undone) > 0 THEN list_slice(undone, 1, len(undone) - 1) ELSE undone END,
  CASE n.op WHEN 'edit' THEN n.seq WHEN 'undo' THEN done[-1] ELSE undone[-1] END
 FROM f JOIN n ON n.session = f.session AND n.k = f.k + 1)
SELECT session, seq, op, CASE WHEN hit IS NOT NULL THEN {_TAGGED.replace('seq', 'hit')} END AS log, hit AS edit_seq FROM f WHERE k > 0"""


@query("ST8", _ROUTED)
def edit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stack over two logs: where each undo and redo goes."""
    log = F.when(col("seq") % 3 == 0, "palette").otherwise("fill")
    return ef.routed(fx.edit_log(spark, sf_dir).withColumn("log", log))


@query("ST3 ST5", "SELECT user_id AS session, max(event_id) AS seq, arg_max(event_type, event_id) AS stage FROM events GROUP BY user_id")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.latest(fx.progress_events(spark, sf_dir).withColumnRenamed("job", "session"), "session", "seq", "stage")


@query("ST1", "SELECT user_id AS job, max(event_id) AS seq, arg_max(event_type, event_id) AS stage, arg_max(least(1e0, value / 500), event_id) AS progress FROM events GROUP BY user_id")
def progress_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.latest(fx.progress_events(spark, sf_dir), "job", "seq", "stage", "progress")


@query("ST2", "SELECT user_id AS job, event_id AS seq, least(200, 32 * row_number() OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS done FROM events")
def capped_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.ticks(fx.progress_events(spark, sf_dir), "job", "seq", 32, 200)


_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ed.STATUS.items()) + " ELSE 'processing' END"


@query("ST12", f"""WITH s AS (SELECT user_id AS job, event_id AS seq, {_STATUS_SQL} AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY seq) AS before FROM s)
SELECT job, arg_max(status, seq) AS status, count(*) FILTER (status = 'processing' AND before IS DISTINCT FROM 'processing') AS attempts, count(*) FILTER (status = 'error') AS errors FROM p GROUP BY job""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.statuses(fx.progress_events(spark, sf_dir), "job", "seq", "stage")


@query("F21", "SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def epoch_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", tx.epoch_millis(col("ts")).alias("millis"))


@query("ST4", f"""WITH {LOG}, g AS (SELECT session, seq, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS f FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
b AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT session, max(ts) AS ts, arg_max(seq, ts) AS seq, count(*) AS n FROM b GROUP BY session, burst""")
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.debounced(fx.edit_log(spark, sf_dir), "session", 600_000, "seq")


@query("ST7", f"""WITH {LOG}, g AS (SELECT *, CASE WHEN lag(op) OVER w IS NOT DISTINCT FROM op AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM log WINDOW w AS (PARTITION BY session ORDER BY seq)),
b AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g) SELECT session, run, op, max(seq) AS seq, count(*) AS n FROM b GROUP BY session, run, op""")
def coalesced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.coalesced(fx.edit_log(spark, sf_dir), "session", "seq", "op")


@query("W13 D15", f"WITH {LOG} SELECT session, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM log) WHERE k <= 20")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.last_kept(fx.edit_log(spark, sf_dir), "session", "seq").select("session", "seq", "op")


@query("ST9 ST11 ST13b", "SELECT props, min(event_id) AS seq FROM events GROUP BY props")
def once_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.once(fx.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq"), "props", "seq")


# --- the same on streams -------------------------------------------------------------------------------------------------


@query("ST3 ST5 stream", "SELECT user_id AS session, max(event_id) AS seq, arg_max(event_type, event_id) AS stage FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.run_to_table(ev.latest(ev.event_stream(spark, sf_dir), "session", "seq", "stage"), "complete", "session")


@query("ST4 stream", f"""WITH {LOG}, g AS (SELECT session, seq, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS f FROM log WINDOW w AS (PARTITION BY session ORDER BY ts, seq)),
b AS (SELECT *, sum(f) OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT session, max(ts) AS ts, arg_max(seq, ts) AS seq, count(*) AS n FROM b GROUP BY session, burst""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    bursts = ev.run_to_table(ev.debounced(ev.event_stream(spark, sf_dir), "session", 600_000, "seq"), "complete", "session")
    return bursts.withColumn("ts", col("ts").cast("timestamp_ntz"))


@query("ST6 stream", f"{_REPLAY} SELECT session, len(done)::INT AS standing, len(undone)::INT AS redoable, done[-1] AS last_edit FROM e")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.when(col("seq") % 3 == 0, "palette").otherwise("fill")
    return ev.run_to_table(un.replayed(ev.event_stream(spark, sf_dir).withColumn("log", log)), "update", "session")


@query("ST8 stream", _ROUTED)
def stream_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.when(col("seq") % 3 == 0, "palette").otherwise("fill")
    return ev.run_to_table(un.routed(ev.event_stream(spark, sf_dir).withColumn("log", log)), "append", "session")
