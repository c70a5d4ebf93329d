"""Queries on rasters of another size, drawings, packed masks, brushes and colour filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drawings as dr
from ..operators import painting as pt
from ..operators import resample as rs
from ..operators import sets as st
from ..sources import fixtures as fx
from ..sources import formats as fm
from .catalogue import DRAWINGS, LUMA, MEDIAN, SHEET, TILES, bucket_sql, col, query, sql_even, sql_half_up
from .image_plan import features
from .queries_regions import SOBEL_SQL, UNIFORM_SQL

AT = ["image_id", "x", "y"]

# --- another size --------------------------------------------------------------------------------------------------------


def _cover(axis: str, n: str, m: str) -> str:
    return f"greatest(0, least(({axis} + 1) * {m}, (t + 1) * {n}) - greatest({axis} * {m}, t * {n}))"


_SHRUNKEN = f"""{SHEET.replace('px AS', 'whole AS')}, z AS (SELECT w, h, CASE WHEN greatest(w, h) <= 256 THEN w ELSE greatest(1, {sql_half_up('w * 256e0 / greatest(w, h)')}) END::BIGINT AS tw, CASE WHEN greatest(w, h) <= 256 THEN h ELSE greatest(1, {sql_half_up('h * 256e0 / greatest(w, h)')}) END::BIGINT AS th
  FROM (SELECT (max(x) + 1)::BIGINT AS w, (max(y) + 1)::BIGINT AS h FROM whole)),
ax AS (SELECT image_id, y, t AS x, w, h, tw, th, {', '.join(f"sum({c} * a * {_cover('x', 'w', 'tw')}) AS {c}" for c in 'rgb')}, sum(a * {_cover('x', 'w', 'tw')}) AS a FROM whole, z, range(256) s(t) WHERE t < tw AND {_cover('x', 'w', 'tw')} > 0 GROUP BY ALL),
ay AS (SELECT image_id, x, t AS y, w, h, {', '.join(f"sum({c} * {_cover('y', 'h', 'th')}) AS {c}" for c in 'rgba')} FROM ax, range(256) s(t) WHERE t < th AND {_cover('y', 'h', 'th')} > 0 GROUP BY ALL),
px AS (SELECT image_id, x::INT AS x, y::INT AS y, {', '.join(f"CASE WHEN a > 0 THEN {sql_even(f'{c}::DOUBLE / a')} ELSE 0 END AS {c}" for c in 'rgb')}, {sql_even('a::DOUBLE / (w * h)')} AS a FROM ay)"""


@query("S29", f"WITH {_SHRUNKEN} SELECT * FROM px")
def analysis_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.shrunken(fx.sheet(spark, sf_dir))


@query("A3 A4 A5 PF25 PF26", f"""WITH {_SHRUNKEN}, {MEDIAN}, {UNIFORM_SQL}, {SOBEL_SQL},
e AS (SELECT image_id, count(*) FILTER (magnitude > 48)::DOUBLE / count(*) AS edge_density FROM sobel WHERE magnitude IS NOT NULL GROUP BY image_id),
c AS (SELECT image_id, count(DISTINCT {bucket_sql(4)}) FILTER (a > 16) AS unique_colors FROM px GROUP BY image_id)
SELECT image_id, unique_colors, edge_density, uniformity, CASE WHEN uniformity >= 0.7e0 AND unique_colors <= 90 THEN 'logo' WHEN uniformity >= 0.7e0 THEN 'ilustracion'
 WHEN uniformity >= 0.45e0 AND unique_colors >= 1500 AND edge_density < 0.16e0 THEN 'producto' ELSE 'foto' END AS profile FROM c JOIN e USING (image_id) JOIN uniform USING (image_id)""")
def sheet_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of an image that is larger than the analysis takes."""
    return features(fx.sheet(spark, sf_dir))


def _lobe_sql(t: str) -> str:
    sinc = lambda v: f"CASE WHEN {v} = 0 THEN 1e0 ELSE sin(pi() * {v}) / (pi() * {v}) END"
    return f"CASE WHEN abs({t}) < 3 THEN ({sinc(t)}) * ({sinc(f'({t} / 3)')}) ELSE 0e0 END"


def _scaled_axis(axis: str, source: str, target: str, n: int, m: int) -> str:
    other, step = ("y" if axis == "x" else "x"), n / m
    wide = max(1.0, step)
    reach = int(3 * wide + 1)
    t = f"((p - ((t + 0.5e0) * {step!r}e0 - 0.5e0)) / {wide!r}e0)"
    return f"""{target} AS (SELECT image_id, {other}, t::INT AS {axis}, sum(v * ({_lobe_sql(t)})) / sum({_lobe_sql(t)}) AS v FROM {source} JOIN range(-{reach}, {n + reach}) a(p) ON {axis} = least({n - 1}, greatest(0, p)), range({m}) b(t)
  WHERE abs({t}) < 3 GROUP BY ALL)"""


def _scaled_sql(m: int) -> str:
    return f"WITH {TILES}, v AS (SELECT image_id, x, y, a::DOUBLE AS v FROM px), {_scaled_axis('x', 'v', 'h', 8, m)}, {_scaled_axis('y', 'h', 't', 8, m)} SELECT image_id, x, y, {sql_even('round(v, 6)')} AS v FROM t"


@query("S29", _scaled_sql(11))
def lanczos_enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.lanczos_scaled(fx.tiles(spark, sf_dir), "a", 1.4)


@query("S29", _scaled_sql(5))
def lanczos_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.lanczos_scaled(fx.tiles(spark, sf_dir), "a", 0.6)


# --- drawings ------------------------------------------------------------------------------------------------------------

_ORDERED = """n AS (SELECT *, CASE WHEN i > 0 AND lag(color) OVER w IS NOT DISTINCT FROM color THEN 0 ELSE 1 END AS f FROM shapes WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT doc_id, run, any_value(color) AS color, string_agg(CASE WHEN color IS NULL THEN element ELSE bare END, '' ORDER BY i) AS body FROM r GROUP BY doc_id, run)"""
_GROUPS = lambda color: f"""'<g id="capa-' || run || '"' || CASE WHEN {color} IS NULL THEN '>' ELSE ' data-color="' || {color} || '" fill="' || {color} || '">' END || body || '</g>'"""
_HEAD = fx.DRAWING_HEAD


@query("F4 F5 D17 IO12", f"""WITH {DRAWINGS}, {_ORDERED} SELECT doc_id, '{_HEAD}' || string_agg({_GROUPS('color')}, '' ORDER BY run) || '</svg>' AS grouped, count(*)::INT AS runs FROM g GROUP BY doc_id""")
def svg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.grouped(fx.drawings(spark, sf_dir)).select("doc_id", "grouped", "runs")


@query("A22 F5", f"""WITH {DRAWINGS}, c AS (SELECT doc_id, color, count(*) AS n, min(i) AS first FROM shapes WHERE color IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1)::INT AS pos, color, n FROM c""")
def svg_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.color_counts(fx.drawings(spark, sf_dir))


#: Edits of each drawing, by its number: the first colour changes, then (of odd drawings) the changed one again, and the last one goes.
_EDITS = ((0, "#1e90ff", "#102030", False), (1, "#102030", "#ffffff", False), (2, "#ff0000", None, True))


@query("D17 J11 F4", f"""WITH {DRAWINGS}, {_ORDERED}, e AS (SELECT doc_id, run, body, CASE color WHEN '#1e90ff' THEN CASE WHEN doc_id % 2 = 1 THEN '#ffffff' ELSE '#102030' END ELSE color END AS now FROM g WHERE color IS DISTINCT FROM '#ff0000')
SELECT d.doc_id, '{_HEAD}' || coalesce(string_agg({_GROUPS('now')}, '' ORDER BY run), '') || '</svg>' AS edited FROM (SELECT DISTINCT doc_id FROM shapes) d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id""")
def svg_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dr.grouped(fx.drawings(spark, sf_dir)).select("doc_id", "grouped")
    steps = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(c).alias("color"), F.lit(t).cast("string").alias("to"), F.lit(gone).alias("remove")) for s, c, t, gone in _EDITS))
    edits = docs.select("doc_id", F.inline(steps)).where((col("step") != 1) | (col("doc_id") % 2 == 1))
    return dr.edited(docs, edits).select("doc_id", "edited")


# --- packed masks --------------------------------------------------------------------------------------------------------

_TWO = "ma AS (SELECT x, y FROM px WHERE r >= 140), mb AS (SELECT x, y FROM px WHERE g >= 140)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = fx.sheet(spark, sf_dir)
    return st.packed(px.where("r >= 140")), st.packed(px.where("g >= 140"))


@query("IO14 D4", f"""WITH {SHEET}, {_TWO}, d AS (SELECT x // 8 AS tx, y // 8 AS ty, y % 8 * 8 + x % 8 AS i FROM (SELECT * FROM ma EXCEPT SELECT * FROM mb))
SELECT 0::BIGINT AS image_id, tx::INT AS tx, ty::INT AS ty, coalesce(sum(1::BIGINT << (i % 32)::INT) FILTER (i < 32), 0)::BIGINT AS low, coalesce(sum(1::BIGINT << (i % 32)::INT) FILTER (i >= 32), 0)::BIGINT AS high FROM d GROUP BY tx, ty""")
def mask_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of one mask without another, in halves."""
    low = F.lit((1 << 32) - 1)
    return st.packed_minus(*_two(spark, sf_dir)).select("image_id", "tx", "ty", col("w").bitwiseAND(low).alias("low"), F.shiftrightunsigned("w", 32).alias("high"))


@query("IO14 T6", f"WITH {SHEET}, {_TWO}, e AS (SELECT * FROM ma UNION SELECT * FROM mb), f AS (SELECT * FROM ma INTERSECT SELECT * FROM mb) SELECT 0::BIGINT AS image_id, x, y FROM (SELECT * FROM e EXCEPT SELECT * FROM f)")
def mask_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are in one of two masks, by words and back."""
    a, b = _two(spark, sf_dir)
    return st.unpacked(st.packed_minus(st.packed_union(a, b), st.packed_intersection(a, b)))


@query("IO14", f"""WITH {TILES}, t AS (SELECT p.image_id, a.x::INT AS x, b.y::INT AS y FROM range(13) a(x), range(5) b(y), px p WHERE p.x = CAST(floor((a.x + 0.5e0) * 8 / 13) AS INT) AND p.y = CAST(floor((b.y + 0.5e0) * 8 / 5) AS INT) AND p.r >= 128)
SELECT image_id, min((y, x))[2] AS seed_x, min((y, x))[1] AS seed_y, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM t GROUP BY image_id""")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks written as PNG files, read again, scaled and taken as selections."""
    tiles = fx.tiles(spark, sf_dir)
    corner = tiles.where("x = 7 AND y = 7").select(*AT, *(F.lit(0).alias(c) for c in "rgba"))  # files are as large as their images
    whole = st.mask_pixels(tiles.where("r >= 128")).unionByName(corner.join(tiles.where("r >= 128"), AT, "left_anti"))
    back = fm.decoded(fm.encoded(whole, None).select(col("image_id").cast("string").alias("path"), "content")).withColumn("image_id", col("path").cast("long"))
    sizes = back.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return st.mask_component(st.mask_scaled(back, sizes, 13, 5))


# --- brushes and filters -------------------------------------------------------------------------------------------------

_STROKES = f"""{SHEET}, points AS (SELECT s_suppkey AS seq, s_suppkey % 4 AS stroke, (s_suppkey * 37 % 64)::DOUBLE AS x0, (s_suppkey * 53 % 120)::DOUBLE AS y0 FROM supplier),
seg AS (SELECT *, coalesce(lead(x0) OVER w, x0) AS x1, coalesce(lead(y0) OVER w, y0) AS y1, lead(seq) OVER w IS NULL AND row_number() OVER w > 1 AS gone, (stroke * 3 + 4)::DOUBLE AS r FROM points WINDOW w AS (PARTITION BY stroke ORDER BY seq)),
d AS (SELECT p.x, p.y, s.stroke, s.r, s.x0, s.y0, s.x1 - s.x0 AS dx, s.y1 - s.y0 AS dy, least(1e0, greatest(0e0, CASE WHEN s.x1 = s.x0 AND s.y1 = s.y0 THEN 0e0 ELSE ((p.x + 0.5e0 - s.x0) * (s.x1 - s.x0) + (p.y + 0.5e0 - s.y0) * (s.y1 - s.y0)) / ((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0)) END)) AS t FROM px p, seg s WHERE NOT gone),
n AS (SELECT x, y, stroke, min(sqrt((x0 + t * dx - x - 0.5e0) * (x0 + t * dx - x - 0.5e0) + (y0 + t * dy - y - 0.5e0) * (y0 + t * dy - y - 0.5e0)) / r) AS t FROM d GROUP BY ALL),
strength AS (SELECT x, y, stroke, CASE WHEN t <= stroke * 0.3e0 THEN 0.7e0 ELSE 0.7e0 * (1 - (t - stroke * 0.3e0) / (1 - stroke * 0.3e0)) END AS s FROM n WHERE t < 1)"""
_LAY = lambda k, before: f"""p{k} AS (SELECT p.x, p.y, {', '.join(f'k{c}' for c in 'rgba')}, coalesce(s.s, 0e0) AS s, ka / 255e0 * coalesce(s.s, 0e0) AS l, {', '.join(f'p.{c} AS {c}' for c in 'rgba')} FROM {before} p LEFT JOIN strength s ON s.x = p.x AND s.y = p.y AND s.stroke = {k}),
q{k} AS (SELECT x, y, {', '.join(f'k{c}' for c in 'rgba')}, """ + (f"{', '.join(f'CASE WHEN l + a * (1 - l) > 0 THEN (k{c} * l + {c} * a * (1 - l)) / (l + a * (1 - l)) ELSE {c} END AS {c}' for c in 'rgb')}, l + a * (1 - l) AS a" if k % 2 else "r, g, b, a * (1 - s) AS a") + f" FROM p{k})"  # noqa: E731


@query("PF29", f"""WITH {_STROKES}, q9 AS (SELECT x, y, {', '.join(f'{c} AS k{c}' for c in 'rgba')}, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b, a / 255e0 AS a FROM px), {_LAY(0, 'q9')}, {_LAY(1, 'q0')}, {_LAY(2, 'q1')}, {_LAY(3, 'q2')}
SELECT 0::BIGINT AS image_id, x, y, {', '.join(f"{sql_half_up(f'round({c}, 6)')} AS {c}" for c in 'rgb')}, {sql_half_up('round(a * 255, 6)')} AS a FROM q3""")
def brush_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    return pt.brushed(px, fx.strokes(spark, sf_dir), px)


_CHAIN = (("brightness", 110.0), ("contrast", 85.0), ("saturate", 140.0), ("hue-rotate", 40.0), ("grayscale", 25.0), ("sepia", 30.0), ("invert", 15.0))


def _chain_sql() -> str:
    """Each filter as a step of its own, cut to 0..1."""
    steps = [f"f0 AS (SELECT image_id, x, y, a, {', '.join(f'{c} / 255e0 AS {c}' for c in 'rgb')} FROM px)"]
    for k, (name, amount) in enumerate(_CHAIN):
        rows = pt.filter_matrix(name, amount)
        cut = ", ".join(f"least(1e0, greatest(0e0, {' + '.join(f'({v!r}e0) * {o}' if 'e' not in repr(v) else f'({v!r}) * {o}' for v, o in zip(row, 'rgb'))} + ({row[3]!r}))) AS {c}" for c, row in zip("rgb", rows, strict=True))
        steps.append(f"f{k + 1} AS (SELECT image_id, x, y, a, {cut} FROM f{k})")
    return f"WITH {TILES}, {', '.join(steps)} SELECT image_id, x, y, {', '.join(f'{sql_half_up(f"round({c} * 255, 6)")} AS {c}' for c in 'rgb')}, a FROM f{len(_CHAIN)}"


@query("PF11", _chain_sql())
def color_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.filtered(fx.tiles(spark, sf_dir), _CHAIN)


@query("PF11", f"""WITH {TILES}, v AS (SELECT *, least(1e0, greatest(0e0, (sqrt((x + 0.5e0 - 4) * (x + 0.5e0 - 4) + (y + 0.5e0 - 4) * (y + 0.5e0 - 4)) - 8 * 0.32e0) / (8 * 0.72e0 - 8 * 0.32e0))) * 0.45e0 AS v FROM px), o AS (SELECT *, v + a / 255e0 * (1 - v) AS o FROM v)
SELECT image_id, x, y, {', '.join(f"CASE WHEN o > 0 THEN {sql_half_up(f'round({c} * (a / 255e0) * (1 - v) / o, 6)')} ELSE 0 END AS {c}" for c in 'rgb')}, {sql_half_up('round(o * 255, 6)')} AS a FROM o""")
def vignette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pt.vignetted(fx.tiles(spark, sf_dir), 60)
