"""Queries on single pixels and their functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as cl
from ..functions import text as tx
from ..functions.numeric import half_up, snap_32
from ..operators import aggregates as ag
from ..sources import fixtures as fx
from .catalogue import BIN, LUMA, SHEET, STATUS, TILES, bucket_sql, col, d2_sql, query, sql_byte, sql_even, sql_half_up

AT = ["image_id", "x", "y"]


@query("D2 IO3", f"WITH {TILES} SELECT * FROM px")
def raster_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir)


@query("D2", f"WITH {SHEET} SELECT * FROM px")
def raster_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sheet(spark, sf_dir)


@query("D2", f"WITH {STATUS} SELECT * FROM px")
def raster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.status_raster(spark, sf_dir)


@query("PF1", f"WITH {TILES} SELECT image_id, x, y, {LUMA} AS l FROM px")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, cl.luma(col("r"), col("g"), col("b")).alias("l"))


@query("PF2", f"WITH {TILES} SELECT image_id, x, y, (r - 128) * (r - 128) + (g - 64) * (g - 64) + (b - 32) * (b - 32) AS d2, sqrt(((r - 128) * (r - 128) + (g - 64) * (g - 64) + (b - 32) * (b - 32))::DOUBLE) AS d FROM px")
def color_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d2 = cl.distance2([col(c) for c in "rgb"], [F.lit(v) for v in (128, 64, 32)])
    return fx.tiles(spark, sf_dir).select(*AT, d2.alias("d2"), F.sqrt(d2.cast("double")).alias("d"))


def _matte_sql(name: str) -> str:
    low, high, smooth = cl.MATTES[name]
    t = f"((a - {low}) / {high - low}e0)"
    between = sql_half_up(f"{t} * {t} * (3e0 - 2 * {t}) * 255") if smooth else "a"
    return f"WITH {TILES} SELECT image_id, x, y, CASE WHEN a <= {low} THEN 0 WHEN a >= {high} THEN 255 ELSE {between} END AS a FROM px"


def _matte(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.tiles(spark, sf_dir).select(*AT, cl.matte(col("a"), *cl.MATTES[name]).alias("a"))

    run.__name__ = f"matte_{name}"
    return run


for _name in cl.MATTES:
    query("PF3", _matte_sql(_name))(_matte(_name))


@query("PF4", f"WITH {TILES} SELECT image_id, x, y, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM px")
def harden_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, F.when(col("a") >= 128, 255).otherwise(0).alias("a"))


def _halo(mode: str):
    low, high = cl.halo_bounds(10, 30, mode)
    new = f"CASE WHEN a <= {low} THEN 0 WHEN a < {high} THEN {sql_half_up(f'a * ((a - {low}) / {high - low}e0)')} ELSE a END"
    sql = f"WITH {TILES}, n AS (SELECT *, {new} AS na FROM px) SELECT image_id, sum(na)::BIGINT AS alpha, count(*) FILTER (na <> a) AS changed FROM n GROUP BY image_id"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px = fx.tiles(spark, sf_dir).withColumn("na", cl.halo_alpha(col("a"), low, high))
        return px.groupBy("image_id").agg(F.sum("na").alias("alpha"), F.count_if(col("na") != col("a")).alias("changed"))

    run.__name__ = f"halo_{mode}"
    query("PF5", sql)(run)


_halo("normal")
_halo("gentle")


@query("PF6", f"""WITH {TILES}, v AS (SELECT image_id, x, y, {LUMA} AS l FROM px), m AS (SELECT *, min(l) OVER w AS lo, max(l) OVER w AS hi FROM v WINDOW w AS (PARTITION BY image_id))
SELECT image_id, x, y, {sql_byte('(l - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END * 255')} AS v FROM m""")
def normalized_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.tiles(spark, sf_dir).withColumn("l", cl.luma(col("r"), col("g"), col("b")))
    v = v.join(v.groupBy("image_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi")), "image_id")
    span = F.when(col("hi") == col("lo"), 1.0).otherwise(col("hi") - col("lo"))
    return v.select(*AT, F.least(F.lit(255), F.greatest(F.lit(0), half_up((col("l") - col("lo")) / span * 255))).alias("v"))


MEANS, STDS = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@query("PF7", f"WITH {TILES} " + " UNION ALL ".join(f"SELECT image_id, {k} AS channel, y * 8 + x AS p, ({c} / 255e0 - {MEANS[k]}e0) / {STDS[k]}e0 AS v FROM px" for k, c in enumerate("rgb")))
def planar_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = F.array(*(F.struct(F.lit(k).alias("channel"), ((col(c) / F.lit(255.0) - F.lit(MEANS[k])) / F.lit(STDS[k])).alias("v")) for k, c in enumerate("rgb")))
    return fx.tiles(spark, sf_dir).select("image_id", (col("y") * 8 + col("x")).alias("p"), F.inline(planes))


_K = "CASE WHEN d <= 60 THEN 0e0 ELSE (d - 60e0) / 45e0 END"


@query("PF8", f"""WITH {TILES}, dist AS (SELECT *, sqrt(((r - 128) * (r - 128) + (g - 128) * (g - 128) + (b - 128) * (b - 128))::DOUBLE) AS d FROM px),
k AS (SELECT *, {_K} AS k FROM dist WHERE d < 105)
SELECT image_id, x, y, {', '.join(f"CASE WHEN k > 0.02e0 THEN {sql_byte(f'({c} - (1 - k) * 128) / k')} ELSE {c} END AS {c}" for c in 'rgb')}, {sql_half_up('k * 255')} AS a FROM k""")
def color_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sqrt(cl.distance2([col(c) for c in "rgb"], [F.lit(128)] * 3).cast("double"))
    px = fx.tiles(spark, sf_dir).withColumn("d", d).where("d < 105").withColumn("k", cl.key_alpha(col("d"), 60.0, 105.0))
    return px.select(*AT, *(cl.despilled(col(c), col("k"), F.lit(128)).alias(c) for c in "rgb"), half_up(col("k") * 255).alias("a"))


@query("PF9", f"WITH {TILES} SELECT image_id, x, y, {sql_even('pow(least(1e0, greatest(0e0, (a - 20) / 200e0)), 0.5e0) * 255')} AS a FROM px")
def levels_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, cl.levels(col("a"), 20, 220, 2.0).alias("a"))


@query("PF10", f"WITH {TILES} SELECT image_id, x, y, CASE WHEN a = 0 THEN r ELSE least(255, r + 27) END AS r, g, CASE WHEN a = 0 THEN b ELSE greatest(0, b - 27) END AS b FROM px")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, cl.shifted(col("r"), 27, col("a")).alias("r"), "g", cl.shifted(col("b"), -27, col("a")).alias("b"))


@query("PF12", f"WITH {TILES} SELECT image_id, 7 - y AS x, x AS y, r, g, b, a FROM px WHERE y BETWEEN 1 AND 6")
def rotate_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).where(col("y").between(1, 6)).select("image_id", (7 - col("y")).alias("x"), col("x").alias("y"), "r", "g", "b", "a")


@query("PF13 J16", f"""WITH {TILES}, f AS (SELECT *, coalesce(CASE image_id % 3 WHEN 0 THEN true WHEN 1 THEN false END, image_id % 2 = 0) AS flip FROM px)
SELECT image_id, CASE WHEN flip THEN 7 - x ELSE x END AS x, y, r, g, b, a FROM f""")
def mirror_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = F.when(col("image_id") % 3 == 0, True).when(col("image_id") % 3 == 1, False)
    return fx.tiles(spark, sf_dir).withColumn("x", F.when(F.coalesce(forced, col("image_id") % 2 == 0), 7 - col("x")).otherwise(col("x")))


@query("PF14", f"WITH {TILES} SELECT image_id, x - 2 AS x, y - 1 AS y, r, g, b, a FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).where(col("x").between(2, 6) & col("y").between(1, 4)).withColumns({"x": col("x") - 2, "y": col("y") - 1})


@query("PF15", f"WITH {TILES} SELECT image_id, x, y, {', '.join(f'{sql_half_up(f"{c} * (a / 255e0) + {v}e0 * (1 - (a / 255e0))")} AS {c}' for c, v in zip('rgb', (255, 250, 240)))} FROM px")
def flatten_on_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, *(cl.over(col(c), col("a"), v).alias(c) for c, v in zip("rgb", (255, 250, 240), strict=True)))


@query("PF16 PF17 PF18", """SELECT p_partkey, needed, width < needed AS upscaled, greatest(width, needed) AS width, CASE WHEN width < needed THEN CAST(floor(height * (needed::DOUBLE / width) + 0.5e0) AS INT) ELSE height END AS height
FROM (SELECT p_partkey, p_size * 40 AS width, p_size * 30 AS height, CAST(floor((p_size % 7) * 1.5e0 * 300 + 0.5e0) AS INT) AS needed FROM part)""")
def print_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = col("p_size")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", (size * 40).alias("w"), (size * 30).alias("h"), half_up((size % 7) * F.lit(1.5) * 300).alias("needed"))
    small = col("w") < col("needed")
    return parts.select("p_partkey", "needed", small.alias("upscaled"), F.greatest("w", "needed").alias("width"), F.when(small, half_up(col("h") * (col("needed") / col("w")))).otherwise(col("h")).alias("height"))


#: The codes of the warnings, in the query and its SQL.
@query("PF19", """WITH info AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 10 END AS dpi, CASE WHEN p_partkey % 4 = 0 THEN 'cmyk' ELSE 'srgb' END AS space, p_partkey % 2 = 0 AS has_alpha, p_size * 40 AS width FROM part)
SELECT p_partkey, 'W_DPI_UNKNOWN' AS code FROM info WHERE dpi IS NULL UNION ALL SELECT p_partkey, 'W_DPI_LOW' FROM info WHERE dpi < 300
UNION ALL SELECT p_partkey, 'W_CMYK' FROM info WHERE space = 'cmyk' UNION ALL SELECT p_partkey, 'W_NO_ALPHA' FROM info WHERE NOT has_alpha UNION ALL SELECT p_partkey, 'W_SMALL' FROM info WHERE width < 1000""")
def print_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpi = F.when(col("p_size") % 5 != 0, col("p_size") * 10)
    codes = F.array_compact(
        F.array(
            F.when(dpi.isNull(), "W_DPI_UNKNOWN").when(dpi < 300, "W_DPI_LOW"),
            F.when(col("p_partkey") % 4 == 0, "W_CMYK"),
            F.when(col("p_partkey") % 2 != 0, "W_NO_ALPHA"),
            F.when(col("p_size") * 40 < 1000, "W_SMALL"),
        )
    )
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.explode(codes).alias("code"))


_HSL = """hs AS (SELECT image_id, x, y, r, g, b, hi - lo AS span, (hi + lo) / 2 AS l, hi, lo, fr, fg, fb FROM (
  SELECT *, greatest(fr, fg, fb) AS hi, least(fr, fg, fb) AS lo FROM (SELECT *, r / 255e0 AS fr, g / 255e0 AS fg, b / 255e0 AS fb FROM px))),
hsl AS (SELECT *, CASE WHEN span = 0 THEN 0e0 WHEN l > 0.5e0 THEN span / (2 - hi - lo) ELSE span / (hi + lo) END AS s,
  CASE WHEN span = 0 THEN 0e0 ELSE (CASE WHEN hi = fr THEN (fg - fb) / span + CASE WHEN fg < fb THEN 6e0 ELSE 0e0 END WHEN hi = fg THEN (fb - fr) / span + 2 ELSE (fr - fg) / span + 4 END) / 6 END AS h FROM hs)"""


@query("PF20", f"WITH {TILES}, {_HSL} SELECT image_id, x, y, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l, r, g, b FROM hsl")
def hsl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.tiles(spark, sf_dir)
    h = dict(zip(("h", "s", "l"), cl.hsl(col("r"), col("g"), col("b")), strict=True))
    back = cl.rgb(col("_h"), col("_s"), col("_l"))
    px = px.withColumns({f"_{k}": v for k, v in h.items()})
    return px.select(*AT, *(F.round(f"_{k}", 6).alias(k) for k in h), *(v.alias(c) for v, c in zip(back, "rgb", strict=True)))


_TH, _TS, _TL = (80 - 40) / (200 - 40) / 6, (200 / 255 - 40 / 255) / (200 / 255 + 40 / 255), (200 / 255 + 40 / 255) / 2
_LIGHT = "(greatest(r / 255e0, g / 255e0, b / 255e0) + least(r / 255e0, g / 255e0, b / 255e0)) / 2"


@query("PF21 A13", f"""WITH {TILES}, d AS (SELECT image_id, {bucket_sql(5)} AS key, count(*) AS cnt, min({{'y': y, 'x': x, 'r': r, 'g': g, 'b': b}}) AS first FROM px WHERE a >= 128 GROUP BY 1, 2),
m AS (SELECT image_id, first.r AS r, first.g AS g, first.b AS b FROM d QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first) = 1), k AS (SELECT image_id, greatest(0.001e0, least(0.999e0, {_LIGHT})) AS bl FROM m),
l AS (SELECT px.*, bl, {_LIGHT} AS l FROM px JOIN k USING (image_id)), n AS (SELECT *, least(1e0, greatest(0e0, CASE WHEN l <= bl THEN {_TL!r}e0 * l / bl ELSE {_TL!r}e0 + (1 - {_TL!r}e0) * (l - bl) / (1 - bl) END)) AS n FROM l),
q AS (SELECT *, CASE WHEN n < 0.5e0 THEN n * (1 + {_TS!r}e0) ELSE n + {_TS!r}e0 - n * {_TS!r}e0 END AS q FROM n), p AS (SELECT *, 2 * n - q AS p FROM q)
SELECT image_id, x, y, {sql_half_up('q * 255')} AS r, {sql_half_up(f'(p + (q - p) * 6 * {_TH!r}e0) * 255')} AS g, {sql_half_up('p * 255')} AS b, a FROM p""")
def colorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile recoloured: hue and saturation of a target, lightness compressed around the tile's dominant colour."""
    px = fx.tiles(spark, sf_dir)
    base = ag.dominant_color(px)
    light = cl.hsl(*(col(c) for c in "rgb"))[2]
    base = base.select("image_id", F.greatest(F.lit(0.001), F.least(F.lit(0.999), light)).alias("bl"))
    th, ts, tl = cl.hsl(*(F.lit(v) for v in (200, 80, 40)))
    px = px.join(base, "image_id").withColumn("_l", light)
    l2 = F.when(col("_l") <= col("bl"), tl * col("_l") / col("bl")).otherwise(tl + (1 - tl) * (col("_l") - col("bl")) / (1 - col("bl")))
    px = px.withColumn("_l2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), l2)))
    return px.select(*AT, *(v.alias(c) for v, c in zip(cl.rgb(th, ts, col("_l2")), "rgb", strict=True)), "a")


@query("PF22 PF23", f"""WITH {SHEET}, s AS (SELECT r AS sr, g AS sg, b AS sb FROM px WHERE x = 5 AND y = 5)
SELECT image_id, x, y, CASE WHEN sqrt(({d2_sql('', 's')})::DOUBLE) <= 60 THEN 0 ELSE a END AS a, x BETWEEN 10 AND 40 AND y BETWEEN 20 AND 90 AND a >= 128 AS in_box FROM px, s""")
def wand_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.sheet(spark, sf_dir)
    seed = px.where("x = 5 AND y = 5").select("image_id", *(col(c).alias(f"s{c}") for c in "rgb"))
    d = F.sqrt(cl.distance2([col(c) for c in "rgb"], [col(f"s{c}") for c in "rgb"]).cast("double"))
    inside = col("x").between(10, 40) & col("y").between(20, 90) & (col("a") >= 128)
    return px.join(seed, "image_id").select(*AT, inside.alias("in_box"), F.when(d <= 60, 0).otherwise(col("a")).alias("a"))


@query("PF24", f"""WITH {STATUS}, near AS (SELECT * FROM px WHERE (r - 30) * (r - 30) + (g - 144) * (g - 144) + (b - 255) * (b - 255) < 144)
SELECT image_id, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, min(y * 128 + x) AS seed FROM near GROUP BY image_id""")
def color_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fx.status_raster(spark, sf_dir).where(cl.distance2([col(c) for c in "rgb"], [F.lit(v) for v in (30, 144, 255)]) < 144)
    return near.groupBy("image_id").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.min(col("y") * 128 + col("x")).alias("seed"))


@query("PF28", f"""WITH {TILES} SELECT p.image_id, p.x, p.y, {sql_half_up('p.a * (1 - m.a / 255e0)')} AS minus, greatest(p.a, m.a) AS plus FROM px p JOIN px m ON m.image_id = p.image_id + 1 AND m.x = p.x AND m.y = p.y""")
def soft_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.tiles(spark, sf_dir)
    mask = px.select((col("image_id") - 1).alias("image_id"), "x", "y", col("a").alias("m"))
    return px.join(mask, AT).select(*AT, half_up(col("a") * (1 - col("m") / F.lit(255.0))).alias("minus"), F.greatest("a", "m").alias("plus"))


@query("PF30 PF33", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'st')")
def tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").where(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("st"))).select("p_partkey", "p_name")


@query("PF31", "SELECT p_partkey, p_size * 10 AS units, p_size * 10 / 1000e0 AS usd, round(p_size * 10 / 1000e0 * 18.5e0, 4) AS mxn, p_size * 10 < 200 AS low FROM part")
def cost_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = col("p_size") * 10
    usd = units / F.lit(1000.0)
    return fx.table(spark, sf_dir, "part").select("p_partkey", units.alias("units"), usd.alias("usd"), F.round(usd * F.lit(18.5), 4).alias("mxn"), (units < 200).alias("low"))


@query("PF32", f"WITH {TILES} SELECT image_id, x, y, a AS r, a AS g, a AS b, 255 AS a FROM px")
def mask_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*AT, *(col("a").alias(c) for c in "rgb"), F.lit(255).alias("a"))


@query("H4", f"WITH {TILES} SELECT image_id, x, y, {bucket_sql(4)} AS k4, {bucket_sql(5)} AS k5, {BIN} AS k24, r * 65536 + g * 256 + b AS k8 FROM px")
def packed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [col(n) for n in "rgb"]
    return fx.tiles(spark, sf_dir).select(*AT, cl.bucket_key(4, *c).alias("k4"), cl.bucket_key(5, *c).alias("k5"), cl.bin_24(*c).alias("k24"), cl.exact_key(*c).alias("k8"))


# --- text and geometry ---------------------------------------------------------------------------------------------------

_COLORS = """CASE p_partkey % 6 WHEN 0 THEN '#' || lower(lpad(to_hex((p_partkey * 7919) % 16777216), 6, '0')) WHEN 1 THEN '#' || lower(lpad(to_hex((p_partkey * 31) % 4096), 3, '0'))
 WHEN 2 THEN ' RGB(' || (p_partkey % 300) || ', ' || (p_partkey % 256) || ',7.5)' WHEN 3 THEN 'grey' WHEN 4 THEN 'none' ELSE 'Red' END"""


def _raw_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("p_partkey")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("#"), F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0"))))
        .when(k % 6 == 1, F.concat(F.lit("#"), F.lower(F.lpad(F.hex(k * 31 % 4096), 3, "0"))))
        .when(k % 6 == 2, F.concat(F.lit(" RGB("), (k % 300).cast("string"), F.lit(", "), (k % 256).cast("string"), F.lit(",7.5)")))
        .when(k % 6 == 3, "grey")
        .when(k % 6 == 4, "none")
        .otherwise("Red")
    )
    return fx.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


def _hex2(x: str) -> str:
    return f"lower(lpad(to_hex({x}), 2, '0'))"


@query("F1 F2", f"""WITH c AS (SELECT p_partkey, lower(trim({_COLORS})) AS s FROM part),
n AS (SELECT *, list_transform(regexp_extract_all(s, '[0-9.]+'), lambda v: {sql_byte('try_cast(v AS DOUBLE)')}) AS v FROM c)
SELECT p_partkey, CASE WHEN regexp_full_match(s, '#[0-9a-f]{{6}}') THEN s WHEN regexp_full_match(s, '#[0-9a-f]{{3}}') THEN '#' || s[2] || s[2] || s[3] || s[3] || s[4] || s[4]
 WHEN starts_with(s, 'rgb') THEN '#' || {_hex2('v[1]')} || {_hex2('v[2]')} || {_hex2('v[3]')} WHEN s = 'grey' THEN '#808080' WHEN s = 'red' THEN '#ff0000' END AS hex FROM n""")
def css_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_colors(spark, sf_dir).select("p_partkey", cl.css_color(col("raw")).alias("hex"))


@query("F3", """WITH c AS (SELECT p_partkey, rpad(substr(md5(p_name), 1, (p_partkey % 7)::INT), 6, '0') AS d FROM part)
SELECT p_partkey, ('0x' || d[1:2])::INT AS r, ('0x' || d[3:4])::INT AS g, ('0x' || d[5:6])::INT AS b FROM c""")
def hex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("#"), F.expr("substring(md5(p_name), 1, int(p_partkey % 7))"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(cl.channels_of_hex(text), "rgb", strict=True)))


@query("", r"""WITH el AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:p|li|h1|article|nav)\b[^>]*>')) AS e FROM pages)
SELECT page_id, regexp_extract(e, '<([a-z0-9]+)', 1) AS tag, count(*) AS n FROM el GROUP BY 1, 2""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<(?:p|li|h1|article|nav)\b[^>]*>"), F.lit(0))).alias("e"))
    return found.groupBy("page_id", F.regexp_extract("e", "<([a-z0-9]+)", 1).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("F4", r"""WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '<path fill="' || p_brand || '" d="M0"/>' WHEN p_partkey % 3 = 1 THEN '<path style="stroke:red;fill: ' || p_brand || ';x:1"/>' ELSE '<path d="M1"/>' END AS e FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN regexp_extract(e, 'fill="([^"]*)"', 1) WHEN 1 THEN regexp_extract(e, 'fill:\s*([^;]+)', 1) END AS fill,
 CASE p_partkey % 3 WHEN 0 THEN '<path d="M0"/>' WHEN 1 THEN '<path style="stroke:red;x:1"/>' ELSE e END AS bare FROM e""")
def fill_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand = col("p_partkey"), col("p_brand")
    e = F.when(k % 3 == 0, F.concat(F.lit('<path fill="'), brand, F.lit('" d="M0"/>'))).when(k % 3 == 1, F.concat(F.lit('<path style="stroke:red;fill: '), brand, F.lit(';x:1"/>'))).otherwise('<path d="M1"/>')
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.fill_of(e).alias("fill"), tx.without_fill(e).alias("bare"))


@query("F6", r"""SELECT p_partkey, replace(replace(replace(replace('<' || p_name || '> & "' || p_type || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
 regexp_replace(regexp_replace(lower(p_name || ' ñandú: ' || p_type), '[^a-z0-9_ñú]+', '-', 'g'), 'ñandú', 'nandu') AS slug FROM part""")
def escape_and_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_type", F.lit('"'))
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.xml_escaped(quoted).alias("escaped"), tx.slug(F.concat("p_name", F.lit(" ñandú: "), "p_type")).alias("slug"))


@query("F7", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 2e0 ELSE 1024e0 END AS width, CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5e0 WHEN 1 THEN p_size * 3e0 ELSE 1024e0 END AS height FROM part""")
def svg_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = col("p_partkey"), col("p_size")
    svg = (
        F.when(k % 3 == 0, F.format_string('<svg id="a" width="%d" height="%d.5">', s, s))
        .when(k % 3 == 1, F.format_string('<svg xmlns="x" viewBox="0 0 %d, %d">', s * 2, s * 3))
        .otherwise("<svg>")
    )
    width, height = tx.svg_size(svg)
    return fx.table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


@query("IO6 F8", "SELECT p_partkey, 'in/' || p_brand || '.v' || p_size || '.cut.png' AS out, 'in/' || p_brand || '.v' || p_size || '.svg' AS swapped, p_brand || '.v' || p_size AS base FROM part")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.format_string("in/%s.v%d.jpg", "p_brand", "p_size")
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.output_name(path, "cut", "png").alias("out"), tx.swapped_extension(path, "svg").alias("swapped"), tx.base_name(path).alias("base"))


@query("F9", "SELECT p_partkey, p_size::DOUBLE AS px, p_size / 4e0 AS py, CASE WHEN p_size % 2 = 0 THEN 1e0 END AS label FROM part")
def point_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", col("p_size").cast("string"), (col("p_size") / F.lit(4.0)).cast("string"), F.when(col("p_size") % 2 == 0, "1").otherwise("x"))
    v = tx.numbers(text)
    return fx.table(spark, sf_dir, "part").select("p_partkey", *(F.element_at(v, i + 1).alias(n) for i, n in enumerate(("px", "py", "label"))))


@query("F10 F22 IO16", """SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS packed FROM events""")
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return fx.table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"), F.to_json(F.struct(col("event_id").alias("id"), col("event_type").alias("kind"))).alias("packed"))


@query("F11 F12", "SELECT p_partkey, substr(md5(p_name), 1, 16) AS key, sha1(p_name) AS sha, to_base64(p_name::BLOB) AS packed FROM part")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.content_key(col("p_name")).alias("key"), F.sha1("p_name").alias("sha"), F.base64(col("p_name").cast("binary")).alias("packed"))


@query("F13 F14", "SELECT p_partkey, greatest(32, CAST(floor(p_size * 7 / 32e0 + 0.5e0) AS INT) * 32) AS snapped FROM part")
def snap_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", snap_32(col("p_size") * 7).alias("snapped"))


@query("F15", "SELECT p_size, (x + 0.5e0) / 8 AS px, (y + 0.5e0) / 8 AS py FROM (SELECT DISTINCT p_size FROM part), range(8) a(x), range(8) b(y)")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.inline(tx.grid_points(8)))


@query("F16", """WITH s AS (SELECT DISTINCT p_size, p_size * 20 AS w, p_size * 13 AS h FROM part), o AS (SELECT *, CAST(floor(512 / 1500e0 * least(w, h)) AS INT) AS o FROM s),
c AS (SELECT *, l, 2 ** l AS n, CAST(ceil((o * (2 ** l - 1) + w) / (2 ** l)) AS INT) AS cw, CAST(ceil((o * (2 ** l - 1) + h) / (2 ** l)) AS INT) AS ch FROM o, (VALUES (1), (2)) v(l))
SELECT p_size, 0 AS layer, 0 AS x0, 0 AS y0, w AS x1, h AS y1 FROM s
UNION ALL SELECT p_size, l AS layer, ((cw - o) * xi)::INT, ((ch - o) * yi)::INT, least(w, (cw - o) * xi + cw)::INT, least(h, (ch - o) * yi + ch)::INT FROM c, range(4) a(xi), range(4) b(yi) WHERE xi < n AND yi < n""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = fx.table(spark, sf_dir, "part").select("p_size").distinct()
    return sizes.select("p_size", F.inline(tx.crop_boxes(col("p_size") * 20, col("p_size") * 13, 2)))


@query("F17", "SELECT p_partkey, i::INT AS part, CAST(floor(i * p_size / 4e0) AS BIGINT) AS start, CAST(floor((i + 1) * p_size / 4e0) AS BIGINT) AS end FROM part, range(4) t(i)")
def range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.inline(tx.range_split(col("p_size"), 4)))


@query("F18", """SELECT p_partkey, x * (1024e0 / greatest(w, h)) AS px, y * (1024e0 / greatest(w, h)) AS py, label FROM (
 SELECT p_partkey, p_size * 40 AS w, p_size * 30 AS h, p_size * 3 AS x, p_size * 5 AS y, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS label FROM part)
UNION ALL SELECT p_partkey, 0e0, 0e0, -1 FROM part""")
def prompt_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.lit(1024.0) / F.greatest(col("p_size") * 40, col("p_size") * 30)
    point = F.struct((col("p_size") * 3 * scale).alias("px"), (col("p_size") * 5 * scale).alias("py"), F.when(col("p_partkey") % 2 == 0, 1).otherwise(0).alias("label"))
    pad = F.struct(F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(-1).alias("label"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(point, pad)))


@query("T5", """WITH v AS (SELECT p_partkey, [p_size % 3, p_size % 7, p_partkey % 11]::INT[] AS v, [p_size % 2, p_size % 5, 4]::INT[] AS w FROM part)
SELECT p_partkey, CASE WHEN v > w THEN 1 WHEN v < w THEN -1 ELSE 0 END AS newer FROM v""")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = col("p_size"), col("p_partkey")
    a = tx.version_numbers(F.concat(F.lit("v"), F.concat_ws(".", (s % 3).cast("string"), (s % 7).cast("string"), (k % 11).cast("string"))))
    b = tx.version_numbers(F.concat_ws(".", (s % 2).cast("string"), (s % 5).cast("string"), F.lit("4")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", F.when(a > b, 1).when(a < b, -1).otherwise(0).alias("newer"))


@query("F19", """SELECT vec_id, list_slice(list_sort(embedding), 1, 3)[2]::DOUBLE AS second, len(list_filter(embedding, lambda v: v > 0)) AS positive, len(list_distinct(list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 20) AS INT)))) AS steps,
 len(list_filter(embedding, lambda v: v > 0.3e0)) > 0 AS some_high, len(list_filter(embedding, lambda v: v < -0.4e0)) = 0 AS none_low, list_sum(list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 1000) AS BIGINT)))::BIGINT AS total FROM embeddings""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = col("embedding")
    thousandths = F.transform(e, lambda v: F.floor(v.cast("double") * 1000).cast("long"))
    return fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(F.array_sort(e), 1, 3)[1].cast("double").alias("second"), F.size(F.filter(e, lambda v: v > 0)).alias("positive"),
        F.size(F.array_distinct(F.transform(e, lambda v: F.floor(v.cast("double") * 20).cast("int")))).alias("steps"), F.exists(e, lambda v: v.cast("double") > 0.3).alias("some_high"), F.forall(e, lambda v: v.cast("double") >= -0.4).alias("none_low"),
        F.aggregate(thousandths, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"),
    )


@query("F20", """SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY first) AS counts FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY user_id""")
def count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind came, in the order of first sight."""
    counts = fx.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    entries = F.array_sort(F.collect_list(F.struct("first", F.concat_ws(":", "event_type", "n").alias("e"))))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda x: x["e"]), ",").alias("counts"))


#: Colour spaces by turns, and the file types that are taken.
_SPACES = ("srgb", "b-w", "cmyk", "lab")
_TYPES, _ACCEPTED = ("image/png", "image/jpeg", "image/webp", "image/gif", "text/plain"), ("image/png", "image/jpeg", "image/webp")


@query("PF16", f"""WITH s AS (SELECT p_partkey, {list(_SPACES)}[CAST(p_size % 4 AS INT) + 1] AS source FROM part) SELECT p_partkey, source, CASE WHEN source = 'cmyk' THEN 'srgb' ELSE source END AS target, source = 'cmyk' AS converted FROM s""")
def color_space_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only images in CMYK are converted; the conversion itself is a codec's."""
    source = F.element_at(F.array(*map(F.lit, _SPACES)), (col("p_size") % 4).cast("int") + 1)
    cmyk = col("source") == "cmyk"
    return fx.table(spark, sf_dir, "part").select("p_partkey", source.alias("source")).select("*", F.when(cmyk, "srgb").otherwise(col("source")).alias("target"), cmyk.alias("converted"))


#: Steps in their order, and the option that shows them (none: always).
_STEPS = (("analyze", None), ("upscale-input", "upscale"), ("remove-bg", None), ("clean-halo", "halo"), ("auto-crop", "crop"), ("bg-fill", "fill"), ("export", None))
_OPTIONS = (("upscale", 2), ("halo", 3), ("crop", 5), ("fill", 7))


@query("PF33", f"""WITH p AS (SELECT p_partkey, list_filter([{', '.join(f"CASE WHEN p_partkey % {n} = 0 THEN '{o}' END" for o, n in _OPTIONS)}], lambda v: v IS NOT NULL) AS options FROM part WHERE list_contains({list(_ACCEPTED)}, {list(_TYPES)}[CAST(p_partkey % 5 AS INT) + 1])),
s(pos, step, needs) AS (VALUES {', '.join(f"({i}, '{s}', {repr(o) if o else 'NULL'})" for i, (s, o) in enumerate(_STEPS))}) SELECT p_partkey, pos, step FROM p JOIN s ON needs IS NULL OR list_contains(options, needs)""")
def visible_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that the options of each accepted file show."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (col("p_partkey") % 5).cast("int") + 1)
    options = F.array_compact(F.array(*(F.when(col("p_partkey") % n == 0, o) for o, n in _OPTIONS)))
    steps = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(s).alias("step"), F.lit(o).cast("string").alias("needs")) for i, (s, o) in enumerate(_STEPS)))
    files = fx.table(spark, sf_dir, "part").where(kind.isin(*_ACCEPTED)).select("p_partkey", options.alias("options"))
    shown = F.filter(steps, lambda s: s["needs"].isNull() | F.array_contains("options", s["needs"]))
    return files.select("p_partkey", F.inline(shown)).drop("needs")
