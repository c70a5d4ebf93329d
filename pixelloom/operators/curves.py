"""Cubic curves through contour lines. Lines are cut at their corners and after PART points, so that no more than a part meets in a task;
each part is fitted by least squares on its own, those of a batch together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import ship
from .batches import whole_groups
from .windows import IMAGE

LINE = [IMAGE, "ring"]
#: Points on either side by which a corner is told, and the cosine of the angle between them from which it is one.
SPAN, SHARP = 3, -0.5
PART = 256
#: Times that parameters are moved to the nearest places of the curve before it is split.
ROUNDS = 6


def col(name: str) -> Column:
    return F.col(name)


def corners(lines: DataFrame) -> DataFrame:
    """(image_id, ring, idx) of the points at which a line turns sharply, of neighbours the sharpest (the first on a tie). Closed lines go
    round; on open ones the ends are no corners."""
    sized = lines.join(lines.groupBy(*LINE).agg(F.count(F.lit(1)).alias("_n")), LINE)
    point = lines.select(*LINE, col("idx").alias("_at"), col("x").alias("_x"), col("y").alias("_y"))
    for k, sign in (("b", -1), ("f", 1)):
        at = col("idx") + sign * SPAN
        at = F.when(col("closed"), F.pmod(at, col("_n").cast("int"))).otherwise(at)
        near = point.toDF(*LINE, f"_at{k}", f"_x{k}", f"_y{k}")
        sized = sized.withColumn(f"_at{k}", at).join(near, [*LINE, f"_at{k}"])
    ax, ay, bx, by = col("_xb") - col("x"), col("_yb") - col("y"), col("_xf") - col("x"), col("_yf") - col("y")
    cosine = F.try_divide(ax * bx + ay * by, F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)))
    turned = sized.where(col("_n") > 2 * SPAN).select(*LINE, "idx", F.round(cosine, 9).alias("c"), "_n", "closed").where(col("c") > SHARP)
    # the ends of a closed line see each other
    round_ = F.array(F.lit(0), F.when(col("closed") & (col("idx") < SPAN), col("_n")), F.when(col("closed") & (col("idx") >= col("_n") - SPAN), -col("_n")))
    turned = turned.select(*LINE, "c", "idx", F.explode(F.array_compact(round_)).alias("_r")).withColumn("_i", (col("idx") + col("_r")).cast("int"))
    near = Window.partitionBy(*LINE).orderBy("_i").rangeBetween(-SPAN, SPAN)
    best = F.max(F.struct("c", (-col("_i")).alias("i"))).over(near)
    return turned.withColumn("_m", best).where((col("_r") == 0) & (-col("_m.i") == col("idx"))).select(*LINE, "idx")


def parts(lines: DataFrame) -> DataFrame:
    """(image_id, ring, part, idx, x, y): points by part, both ends in both parts that they belong to. A part begins at the line's first point,
    at each corner, and after PART points; closed lines end with their first point."""
    key = [*LINE, "idx"]
    w = Window.partitionBy(*LINE).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.join(corners(lines).withColumn("_c", F.lit(1)), key, "left")
    begun = marked.withColumn("_b", F.max(F.when((col("idx") == 0) | col("_c").isNotNull(), col("idx"))).over(w))
    first = (col("idx") - col("_b")) % PART == 0
    placed = begun.withColumn("part", F.sum(first.cast("int")).over(w) - 1).withColumn("_first", first)
    own = placed.select(*LINE, "part", "idx", "x", "y")
    ends = placed.where(col("_first") & (col("part") > 0)).select(*LINE, (col("part") - 1).alias("part"), "idx", "x", "y")
    last = placed.groupBy(*LINE).agg(F.max("part").alias("part"), (F.max("idx") + 1).alias("idx"), F.first("closed").alias("_o"))
    start = lines.where("idx = 0").select(*LINE, "x", "y")
    closing = last.where("_o").join(start, LINE).select(*LINE, "part", "idx", "x", "y")
    return own.unionByName(ends).unionByName(closing)


def _basis(t: np.ndarray) -> np.ndarray:
    s = 1 - t
    return np.stack([s**3, 3 * s * s * t, 3 * s * t * t, t**3], axis=-1)


def fitted(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p: (k, n, 2), k runs of n points. The four control points of a cubic from the first to the last of each, and how far each point is
    from its place on it."""
    k, n, _ = p.shape
    steps = np.hypot(*np.moveaxis(np.diff(p, axis=1), 2, 0))
    t = np.concatenate([np.zeros((k, 1)), np.cumsum(steps, axis=1)], axis=1) / np.maximum(steps.sum(axis=1), 1e-12)[:, None]
    first, last = p[:, :1], p[:, -1:]
    best = least = None
    for _ in range(ROUNDS if n > 2 else 1):
        b = _basis(t)
        if n > 3:
            rest = p - b[..., :1] * first - b[..., 3:] * last
            inner = np.stack([np.linalg.lstsq(f[1:-1, 1:3], r[1:-1], rcond=None)[0] for f, r in zip(b, rest, strict=True)])
        else:
            inner = first + (last - first) * np.array([[1], [2]]) / 3
        control = np.concatenate([first, inner, last], axis=1)
        off = b @ control - p
        away = np.hypot(off[..., 0], off[..., 1])
        if best is None:
            best, least = control, away
        else:
            nearer = away.max(axis=1) < least.max(axis=1)
            best, least = np.where(nearer[:, None, None], control, best), np.where(nearer[:, None], away, least)
        d = np.diff(control, axis=1)[:, :, None]
        s, u = (1 - t)[..., None], t[..., None]
        speed = 3 * (s * s * d[:, 0] + 2 * s * u * d[:, 1] + u**2 * d[:, 2])
        bend = 6 * (s * (d[:, 1] - d[:, 0]) + u * (d[:, 2] - d[:, 1]))
        slope = (speed * speed).sum(axis=2) + (off * bend).sum(axis=2)
        move = np.divide((off * speed).sum(axis=2), slope, out=np.zeros(t.shape), where=np.abs(slope) > 1e-12)
        t = np.sort(np.clip(t - np.clip(move, -0.1, 0.1), 0, 1), axis=1)
        t[:, 0], t[:, -1] = 0, 1
    return best, least


def fitted_within(p: np.ndarray, first: np.ndarray, last: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, control points, error) of curves through the runs of points p[first] to p[last], in the runs' order and one after the
    other, none further off than the bound. Runs of one length are fitted together; those that are too far off are split and come again."""
    out = []
    while len(first):
        size, again = last - first, []
        for n in np.unique(size):
            a, b = first[size == n], last[size == n]
            control, away = fitted(p[a[:, None] + np.arange(n + 1)])
            error = away.max(axis=1)
            good = error <= bound
            out.append((a[good], b[good], control[good], error[good]))
            middle = a[~good] + np.clip(away[~good].argmax(axis=1), 1, n - 1)
            again += [(a[~good], middle), (middle, b[~good])]
        first, last = (np.concatenate(c) for c in zip(*again, strict=True))
    if not out:
        return first, last, np.zeros((0, 4, 2)), np.zeros(0)
    every = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.argsort(every[0], kind="stable")
    return tuple(c[order] for c in every)


_NAMES = [f"{c}{i}" for i in range(4) for c in "xy"]


def curves(lines: DataFrame, bound: float = 0.5) -> DataFrame:
    """(image_id, ring, part, piece, from_idx, to_idx, x0, y0 .. x3, y3, error): cubic curves through lines (image_id, ring, idx, x, y, closed),
    in their order. Each point between from_idx and to_idx (a closed line's first point ends it too) is at most `bound` from its curve."""
    shape = pa.schema([(IMAGE, pa.int64()), ("ring", pa.int32()), ("part", pa.int64()), *((n, pa.int32()) for n in ("piece", "from_idx", "to_idx")), *((n, pa.float64()) for n in (*_NAMES, "error"))])

    key = [*LINE, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, begin in whole_groups(batches, key):
            end = np.append(begin[1:], len(v["idx"])) - 1
            a, b, control, error = fitted_within(np.stack([v["x"], v["y"]], axis=1), begin[end > begin], end[end > begin], bound)
            own = begin[np.searchsorted(begin, a, side="right") - 1]
            piece = np.arange(len(a)) - np.searchsorted(own, own)
            values = (*(v[k][a] for k in key), piece, v["idx"][a], v["idx"][b], *control.reshape(-1, 8).T, error)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(values, shape, strict=True)], schema=shape)

    schema = f"{IMAGE} long, ring int, part long, piece int, from_idx int, to_idx int, {', '.join(f'{n} double' for n in _NAMES)}, error double"
    return parts(lines).repartition(*key).sortWithinPartitions(*key, "idx").mapInArrow(run, schema)


ship(__name__)
