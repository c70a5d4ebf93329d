"""The query catalogue: each entry applies one operator (its inventory number is given) to whole adapted tables, next to the same
result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}

col = F.col


def query(items: str, sql: str | None = None):
    """Registers a function under its name; items: inventory numbers that it covers as a whole."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        INVENTORY[f.__name__] = items
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL of the adapters -------------------------------------------------------------------------------------------------


def sql_half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5e0) AS INT)"


def sql_byte(x: str) -> str:
    return f"CAST(least(255, greatest(0, floor(({x}) + 0.5e0))) AS INT)"


def sql_even(x: str) -> str:
    return f"CAST(least(255e0, greatest(0e0, round_even({x}, 0))) AS INT)"


def _sql_value(k: int, factor: int = 1) -> str:
    return sql_byte(f"(CAST(embedding[CAST((i + {k}) % 64 AS INT) + 1] AS DOUBLE) * {factor} + 0.5e0) * 255")


_RGBA = f"{_sql_value(0)} AS r, {_sql_value(1)} AS g, {_sql_value(2)} AS b, {_sql_value(3, 4)} AS a"
TILES = f"px AS (SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, {_RGBA} FROM embeddings, range(64) t(i))"
SHEET = f"px AS (SELECT 0::BIGINT AS image_id, CAST(i AS INT) AS x, CAST(vec_id AS INT) AS y, {_RGBA} FROM embeddings, range(64) t(i))"
_STATUS = ", ".join(f"CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN {c[k]}" for s, c in fx.STATUS_COLORS.items()) + f" END AS {n}" for k, n in enumerate("rgb"))
STATUS = f"px AS (SELECT 0::BIGINT AS image_id, CAST(o_orderkey % 128 AS INT) AS x, CAST(o_orderkey // 128 AS INT) AS y, {_STATUS}, 255 AS a FROM orders)"
_LIFT = ", ".join(f"CASE WHEN k BETWEEN 4 AND 7 THEN least(255, {c} + 110) ELSE {c} END AS {c}" for c in "rgb")
RESIDUE = f"""px AS (SELECT image_id, x, y, {_LIFT}, CASE WHEN k < 4 THEN 0 WHEN t < 90 THEN 40 ELSE 255 END AS a, region_id
  FROM (SELECT *, (region_id * 7) % 10 AS k FROM (SELECT 0::BIGINT AS image_id, CAST(i AS INT) AS x, CAST(vec_id AS INT) AS y, {_RGBA}, {_sql_value(3)} AS t,
        1 + CAST(i // 16 AS INT) + 4 * CAST(vec_id // 16 AS INT) AS region_id FROM embeddings, range(64) t(i))))"""
RECTANGLES = """boxes AS (SELECT cand_no, x0, y0, x0 + 4 + s % 16 AS x1, y0 + 4 + (7 * s) % 16 AS y1, score
  FROM (SELECT p_partkey AS cand_no, (p_partkey * 37) % 240 AS x0, (p_partkey * 91) % 240 AS y0, p_size::BIGINT AS s, p_retailprice AS score FROM part))"""
MASKS = "masks AS (SELECT label::BIGINT AS image_id, image_id AS cand_no, x, y, embedding[1]::DOUBLE AS score FROM tile JOIN embeddings ON vec_id = image_id WHERE a >= 128)"
MASKS = f"{TILES.replace('px AS', 'tile AS')}, {MASKS}"
DECODED = """decoded AS (SELECT label::BIGINT AS image_id, vec_id AS point, k::INT AS k, 0.8e0 + embedding[CAST(k AS INT) + 1]::DOUBLE AS iou, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, embedding[CAST((i + k * 16) % 64 AS INT) + 1]::DOUBLE AS logit
  FROM embeddings, range(4) a(k), range(64) b(i))"""
DISCS = """discs AS (SELECT s_suppkey::BIGINT AS image_id, 1 AS region_id, x::INT AS x, y::INT AS y FROM supplier, range(61) a(x), range(61) b(y)
  WHERE (x - 30) * (x - 30) * (CASE WHEN s_suppkey % 4 = 0 THEN 9 ELSE 16 END) + (y - 30) * (y - 30) * 16 <= (6 + s_suppkey % 20) * (6 + s_suppkey % 20) * 16)"""
FRAMED = f"""{TILES.replace('px AS', 'tile AS')}, px AS (SELECT image_id, x, y, {', '.join(f'CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN {c} ELSE 120 + {c} // 16 END::INT AS {c}' for c in 'rgb')},
  CASE WHEN image_id % 10 = 0 AND x < 3 THEN 0 ELSE 255 END AS a FROM tile)"""
_PATCH = lambda k: "CASE (y // 40) % 5 " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(fx.PATCH_COLORS)) + " END"
PATCHES = f"""{SHEET.replace('px AS', 'sheet AS')}, px AS (SELECT image_id, x, y, {', '.join(f'CASE WHEN x BETWEEN 8 AND 31 AND y % 40 BETWEEN 4 AND 19 THEN {_PATCH(k)} + {c} // 32 ELSE 240 + {c} // 32 END::INT AS {c}' for k, c in enumerate('rgb'))}, 255 AS a FROM sheet)"""
_FILL = lambda i: "CASE (p_partkey // 3) % 5 " + " ".join(f"WHEN {k} THEN " + ("NULL" if f[i] is None else f"'{f[i]}'") for k, f in enumerate(fx.FILLS)) + " END"
_SHAPE = lambda fill: f"""CASE p_partkey % 3 WHEN 0 THEN '<path' || {fill} || ' d="M' || p_size || '"/>' WHEN 1 THEN '<circle' || {fill} || '><title>' || p_brand || '</title></circle>' ELSE '<rect' || {fill} || '/>' END"""
DRAWINGS = f"shapes AS (SELECT p_partkey // 20 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS i, {_FILL(2)} AS color, {_SHAPE(_FILL(0))} AS element, {_SHAPE(_FILL(1))} AS bare FROM part)"
LOG = "log AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS op, ts, value FROM events)"
LUMA = "0.299e0 * r + 0.587e0 * g + 0.114e0 * b"


def d2_sql(a: str, b: str) -> str:
    """Squared distance of colours whose columns have the prefixes a and b."""
    return " + ".join(f"({a}{c} - {b}{c}) * ({a}{c} - {b}{c})" for c in "rgb")


def bucket_sql(bits: int) -> str:
    s = 8 - bits
    return f"(r >> {s}) * {1 << 2 * bits} + (g >> {s}) * {1 << bits} + (b >> {s})"


BIN = "((r * 24) >> 8) * 576 + ((g * 24) >> 8) * 24 + ((b * 24) >> 8)"
SIZED = "sized AS (SELECT *, max(x) OVER (PARTITION BY image_id) + 1 AS w, max(y) OVER (PARTITION BY image_id) + 1 AS h FROM px)"
BORDER = f"""{SIZED}, stepped AS (SELECT *, greatest(1, CAST(floor(2 * (w + h) / 240e0) AS INT)) AS s FROM sized),
border AS (SELECT image_id, r, g, b FROM stepped WHERE y = 0 AND x % s = 0 UNION ALL SELECT image_id, r, g, b FROM stepped WHERE y = h - 1 AND x % s = 0
  UNION ALL SELECT image_id, r, g, b FROM stepped WHERE x = 0 AND y % s = 0 UNION ALL SELECT image_id, r, g, b FROM stepped WHERE x = w - 1 AND y % s = 0)"""
_MID = ", ".join(f"max(CASE WHEN i{c} = n // 2 THEN {c} END) AS {c}" for c in "rgb")
MEDIAN = f"""{BORDER}, ranked AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n, {', '.join(f'row_number() OVER (PARTITION BY image_id ORDER BY {c}) - 1 AS i{c}' for c in 'rgb')} FROM border),
median AS (SELECT image_id, {_MID} FROM ranked GROUP BY image_id)"""
PALETTE = f"""buckets AS (SELECT image_id, {bucket_sql(5)} AS key, sum(r)::BIGINT AS sr, sum(g)::BIGINT AS sg, sum(b)::BIGINT AS sb, count(*) AS cnt, min((y, x)) AS first FROM px WHERE a >= 128 GROUP BY 1, 2),
shares AS (SELECT *, sum(cnt) OVER (PARTITION BY image_id)::BIGINT AS total FROM buckets),
palette AS (SELECT image_id, CAST(idx AS INT) AS idx, {', '.join(f'{sql_half_up(f"s{c}::DOUBLE / cnt")} AS {c}' for c in 'rgb')}, cnt FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, first) - 1 AS idx FROM shares WHERE cnt > total * 0.0006e0) WHERE idx < 80)"""
