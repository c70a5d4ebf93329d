"""Lines around soft masks. Where the level is crossed between two neighbouring pixels there is one point; a cell of 2 x 2 pixel centres
joins its points, with the inside always on the same hand, so a point has one successor at most. Stitching is list ranking: the segments of
a block of cells are chained in a task, and successors of chains that cross blocks are doubled until each knows its line and its place on
it. Simplifying splits every part of a line where it is furthest from its chord: in a task, or in rounds where a line is long. A single large
image spreads over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import discard, ship, stored
from .batches import whole_groups
from .windows import IMAGE, along

#: Alpha at which a pixel's inside ends.
LEVEL = 127.5
LINE = [IMAGE, "ring"]
#: Side of the blocks of cells that are chained in a task, and points of a line from which it is simplified in rounds.
BLOCK, LONG = 256, 65_536


def col(name: str) -> Column:
    return F.col(name)


def cells(px: DataFrame) -> DataFrame:
    """(image_id, x, y, c): the four alphas of each cell, clockwise from the upper left corner, as an array; cells that lie on one side of
    the level are left out."""
    beside = lambda axis, value: F.when(F.lead(axis).over(along(axis)) == col(axis) + 1, F.lead(value).over(along(axis)))
    rows = px.select(IMAGE, "x", "y", F.struct(col("a").alias("near"), beside("x", "a").alias("far")).alias("_top"))
    whole = rows.withColumn("_low", beside("y", "_top")).where("_top.far IS NOT NULL AND _low.near IS NOT NULL AND _low.far IS NOT NULL")
    corners = F.array(*(col(f"{row}.{end}") for row, end in (("_top", "near"), ("_top", "far"), ("_low", "far"), ("_low", "near"))))
    return whole.select(IMAGE, "x", "y", corners.alias("c")).where((F.array_max("c") > LEVEL) & (F.array_min("c") < LEVEL))


def segments(px: DataFrame) -> DataFrame:
    """(image_id, cy, cx, side, to_side, from_point, to_point, ax, ay, bx, by): the segments of each cell (cx, cy). Sides are numbered
    clockwise from the upper one. A segment runs from a side on which, clockwise, the inside ends to one on which it begins; of four
    crossed sides each goes to the next one if the cell's mean is inside, else to the one before. Points are placed on the sides by linear
    interpolation, to six digits, and numbered by the side that they lie on, so that two cells that share a side name one point."""
    c = lambda i: F.get("c", i % 4)
    inside = lambda i: c(i) > LEVEL
    # corners at the ends of a side, as offsets from the cell, and the pixel and direction that name the side
    cut = lambda a, b, start: F.round(start + F.try_divide(F.lit(LEVEL) - a, (b - a).cast("double")), 6)  # null on a side without a point
    point = lambda x, y, name: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), name.alias("name"))
    name = lambda x, y, down: F.shiftleft(y.cast("long"), 32) + x.cast("long") * 2 + down
    x, y = col("x"), col("y")
    sides = F.array(
        point(cut(c(F.lit(0)), c(F.lit(1)), x), y, name(x, y, 0)),
        point(x + 1, cut(c(F.lit(1)), c(F.lit(2)), y), name(x + 1, y, 1)),
        point(cut(c(F.lit(3)), c(F.lit(2)), x), y + 1, name(x, y + 1, 0)),
        point(x, cut(c(F.lit(0)), c(F.lit(3)), y), name(x, y, 1)),
    )
    four = F.sequence(F.lit(0), F.lit(3))
    ends = F.filter(four, lambda i: inside(i) & ~inside(i + 1))
    turn = lambda i, k: F.when(~inside(i + k) & inside(i + k + 1), (i + k) % 4)
    saddle = (F.size(ends) == 2) & (F.aggregate("c", F.lit(0), lambda s, v: s + v) < 4 * LEVEL)
    to = lambda i: F.when(saddle, (i + 3) % 4).otherwise(F.coalesce(turn(i, 1), turn(i, 2), turn(i, 3)))
    runs = F.transform(ends, lambda i: F.struct(i.alias("side"), to(i).alias("to_side")))
    found = cells(px).select(IMAGE, "x", "y", "c", F.explode(runs).alias("r"))
    placed = found.withColumn("_p", sides).select(IMAGE, col("y").alias("cy"), col("x").alias("cx"), "r.side", "r.to_side", F.get("_p", col("r.side")).alias("_a"), F.get("_p", col("r.to_side")).alias("_b"))
    return placed.select(IMAGE, "cy", "cx", "side", "to_side", col("_a.name").alias("from_point"), col("_b.name").alias("to_point"), *(col(f"_{e}.{k}").alias(f"{e}{k}") for e in "ab" for k in "xy"))


def _until_still(state: DataFrame, step, changed: str) -> DataFrame:
    """step(state), written, again and again until no row is marked as changed."""
    while True:
        after = stored(step(state), "ranks")
        discard(state)
        state = after
        if state.where(changed).isEmpty():
            return state


def _seam(cell: Column) -> Column:
    """The block of a cell along an axis. Seams lie in the middle, so that an image of up to half a block is one."""
    return F.floor((cell + BLOCK // 2) / BLOCK)


def _on_seam(node: np.ndarray) -> np.ndarray:
    """Whether points lie between two blocks, by the pixel and direction that name them."""
    side = ((node + (1 << 31)) & ((1 << 32) - 1)) - (1 << 31)
    y, x, down = (node - side) >> 32, side >> 1, side & 1
    return (np.where(down == 1, x, y) + BLOCK // 2) % BLOCK == 0


def _ranked(after: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, closed) of segments with a successor each, or -1: the first one of their chain, their place on it, and whether it goes
    round; such chains begin with the lowest name."""
    every = np.arange(len(after))
    before = np.full(len(after), -1)
    before[after[after >= 0]] = every[after >= 0]
    ptr = np.where(before < 0, every, before)
    for _ in range(len(every).bit_length()):
        ptr = ptr[ptr]
    closed = before[ptr] >= 0
    at = np.flatnonzero(closed)
    ahead, low = np.searchsorted(at, before[at]), name[at]
    while not np.array_equal(least := np.minimum(low, low[ahead]), low):
        ahead, low = ahead[ahead], least
    before[at[name[at] == low]] = -1
    head, place = np.where(before < 0, every, before), (before >= 0).astype(np.int64)
    while not np.array_equal(further := head[head], head):
        head, place = further, place + place[head]
    return head, place, closed


_CHAINED = pa.schema([(IMAGE, pa.int64()), ("chain", pa.int64()), ("off", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("n", pa.int32()), ("closed", pa.bool_()), ("low", pa.int64()), ("low_off", pa.int32()), ("to", pa.int64()), ("ex", pa.float64()), ("ey", pa.float64())])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of the chains of each block, in their order; closed is null for chains that may go on in other blocks, and `to` (at ex,
    ey) the point in which they do."""
    for v, begin in whole_groups(batches, [IMAGE, "_by", "_bx"]):
        n = len(v["ax"])
        block = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        name, both = np.append(v["from_point"], v["to_point"]), np.append(block, block)
        order = np.lexsort((name, both))
        fresh = np.append(True, (np.diff(name[order]) != 0) | (np.diff(both[order]) != 0))
        node = np.empty(2 * n, np.int64)
        node[order] = np.cumsum(fresh) - 1
        at = np.full(2 * n, -1)
        at[node[:n]] = np.arange(n)
        head, place, closed = _ranked(at[node[n:]], v["from_point"])
        order = np.lexsort((place, head))
        start = np.flatnonzero(place[order] == 0)
        size = np.diff(np.append(start, n))
        first, tail, closed = order[start], order[start + size - 1], closed[order[start]]
        goes_on, came = ~closed & _on_seam(v["to_point"][tail]), ~closed & _on_seam(v["from_point"][first])
        own_end = ~closed & ~goes_on  # the free end is a point of the chain
        points = size + own_end
        chain = np.repeat(np.arange(len(start)), points)
        off = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        is_end = off == size[chain]
        row = order[start[chain] + np.minimum(off, size[chain] - 1)]
        pick = lambda a, b: np.where(is_end, v[b][row], v[a][row])
        names, heads = pick("from_point", "to_point"), np.cumsum(points) - points
        low = np.minimum.reduceat(names, heads)
        low_off = off[np.flatnonzero(names == low[chain])]
        loose = goes_on | came
        kept = (loose | closed | (points >= 4))[chain]
        chain, off, names = chain[kept], off[kept], names[kept]
        x, y = pick("ax", "bx")[kept], pick("ay", "by")[kept]
        last = lambda c: pa.array(v[c][tail][chain], mask=~goes_on[chain])
        values = (v[IMAGE][first][chain], v["from_point"][first][chain], off, x, y, points[chain], pa.array(closed[chain], mask=loose[chain]), low[chain], low_off[chain], last("to_point"), last("bx"), last("by"))
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(values, _CHAINED, strict=True)], schema=_CHAINED)


def _crossing(loose: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains that cross blocks: (image_id, chain, first, closed, n, base, turn), the lowest point of their line, its points, those before
    the chain, and the place of the first one; and the line's free ends on seams as points (image_id, chain, off, x, y)."""
    key = [IMAGE, "node"]
    starts = loose.where("off = 0").select(IMAGE, col("chain").alias("node"), col("to").alias("next"), "low", "low_off", "n", "ex", "ey")
    ends = starts.where("next IS NOT NULL").select(IMAGE, col("next").alias("node"), "ex", "ey").join(starts, key, "left_anti")
    ends = stored(ends, "ends")
    none = F.lit(None).cast("long")
    chains = starts.select(*key, "next", "low", "low_off", "n").unionByName(ends.select(*key, none.alias("next"), col("node").alias("low"), F.lit(0).alias("low_off"), F.lit(1).alias("n")))
    chains = stored(chains, "chains")

    # lines: each chain sees ever more of what follows, the end of an open line, or the lowest point and chain of a closed one
    def further(s: DataFrame) -> DataFrame:
        ahead = s.select(IMAGE, col("node").alias("ptr"), *(col(c).alias(f"_{c}") for c in ("ptr", "low", "cut", "last")))
        joined = s.join(ahead, [IMAGE, "ptr"], "left")
        low, cut, last = F.least("low", "_low"), F.least("cut", "_cut"), F.coalesce("last", "_last")
        changed = (low < col("low")) | (cut < col("cut")) | (col("last").isNull() & last.isNotNull())
        return joined.select(*key, col("_ptr").alias("ptr"), low.alias("low"), cut.alias("cut"), last.alias("last"), changed.alias("changed"))

    seen = chains.select(*key, col("next").alias("ptr"), "low", col("node").alias("cut"), F.when(col("next").isNull(), col("node")).alias("last"))
    lines = _until_still(stored(seen, "ranks"), further, "changed")
    whole = chains.withColumnRenamed("low", "_own").join(lines.select(*key, "low", "cut", "last"), key)

    # places: closed lines are cut before their lowest chain; each chain counts the points to the end
    def nearer(s: DataFrame) -> DataFrame:
        ahead = s.select(IMAGE, col("node").alias("ptr"), col("ptr").alias("_ptr"), col("steps").alias("_steps"))
        joined = s.join(ahead, [IMAGE, "ptr"], "left")
        return joined.select(*key, col("_ptr").alias("ptr"), (col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), col("_ptr").isNotNull().alias("changed"))

    to = F.when(col("last").isNotNull() | (col("next") != col("cut")), col("next"))
    ranks = _until_still(stored(whole.select(*key, to.alias("ptr"), col("n").alias("steps")), "ranks"), nearer, "changed")
    line = [IMAGE, "line"]
    laid = whole.join(ranks.select(*key, "steps"), key).withColumn("line", F.coalesce("last", "cut"))
    from_end = F.max(F.when(col("_own") == col("low"), col("steps") - col("low_off")))
    # what an open line's chains see ahead is not the whole line
    about = laid.groupBy(*line).agg(F.max("steps").cast("int").alias("_n"), F.min("_own").alias("first"), from_end.alias("_from_end"))
    about = about.withColumn("turn", (col("_n") - col("_from_end")).cast("int"))
    found = laid.join(about, line).select(IMAGE, col("node").alias("chain"), "first", col("last").isNull().alias("closed"), col("_n").alias("n"), (col("_n") - col("steps")).cast("int").alias("base"), "turn")
    return found, ends.select(IMAGE, col("node").alias("chain"), F.lit(0).alias("off"), col("ex").alias("x"), col("ey").alias("y"))


def stitched(found: DataFrame) -> DataFrame:
    """(image_id, ring, idx, x, y, closed): the points of all lines in their order. Lines of an image are numbered by their first point in row
    order. A closed line begins with that point, an open one (which ends at the image's border) with its free end. Open lines of fewer than
    four points are no contours."""
    block = [IMAGE, "_by", "_bx"]
    dealt = found.select(IMAGE, _seam(col("cy")).alias("_by"), _seam(col("cx")).alias("_bx"), "from_point", "to_point", "ax", "ay", "bx", "by")
    schema = f"{IMAGE} long, chain long, off int, x double, y double, n int, closed boolean, low long, low_off int, to long, ex double, ey double"
    points = stored(dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_chains, schema), "points")
    lines = points.where("off = 0 AND closed IS NOT NULL").select(IMAGE, "chain", col("low").alias("first"), "closed", "n", F.lit(0).alias("base"), F.lit(0).alias("turn"))
    loose, placed = points.where("closed IS NULL"), points.select(IMAGE, "chain", "off", "x", "y")
    if not loose.isEmpty():
        crossing, ends = _crossing(loose)
        lines, placed = lines.unionByName(crossing), placed.unionByName(ends)
    ring = F.dense_rank().over(Window.partitionBy(IMAGE).orderBy("first")) - 1
    lines = lines.where("closed OR n >= 4").withColumn("ring", ring)
    at = col("base") + col("off")
    idx = F.when(col("closed"), F.pmod(at - col("turn"), col("n"))).otherwise(at).cast("int")
    return placed.join(lines, [IMAGE, "chain"]).select(IMAGE, "ring", idx.alias("idx"), "x", "y", "closed")


def _away(x: str, y: str) -> Column:
    """Distance of a point from the chord of its part; from the chord's end where that has no length."""
    cx, cy = col("hx") - col("lx"), col("hy") - col("ly")
    dx, dy = col(x) - col("lx"), col(y) - col("ly")
    length = F.sqrt(cx * cx + cy * cy)
    return F.when(length > 0, F.abs(cx * dy - cy * dx) / length).otherwise(F.sqrt(dx * dx + dy * dy))


def _far(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
    """The points at which parts between two kept points (of one line, whose first point follows its last) are split, again and again."""
    kept = []
    while True:
        open_ = high - low > 1
        low, high = low[open_], high[open_]
        if not len(low):
            return np.concatenate([np.zeros(0, np.int64), *kept])
        size = high - low - 1
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(low + 1 - begin, size)
        part = np.repeat(np.arange(len(low)), size)
        cx, cy = (x[high] - x[low])[part], (y[high] - y[low])[part]
        dx, dy = x[at] - x[low][part], y[at] - y[low][part]
        length = np.sqrt(cx * cx + cy * cy)
        away = np.where(length > 0, np.abs(cx * dy - cy * dx) / np.where(length > 0, length, 1), np.sqrt(dx * dx + dy * dy))
        most = np.maximum.reduceat(away, begin)
        first = np.minimum.reduceat(np.where(away == most[part], at, len(x)), begin)
        split = most > tolerance
        kept.append(first[split])
        low, high = np.concatenate([low[split], first[split]]), np.concatenate([first[split], high[split]])


def simplified(lines: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """(image_id, ring, idx, x, y) of the points that are kept: a line's first point, and in each part (at first the whole line, closed by
    its first point) the furthest one from the chord, the first of several, if it is further than the tolerance; it splits the part in two.
    Lines of which fewer than three points are left are no contours."""
    shape = pa.schema([(IMAGE, pa.int64()), ("ring", pa.int32()), ("idx", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, begin in whole_groups(batches, LINE):
            # each line is followed by its first point
            size = np.diff(np.append(begin, len(v["x"])))
            x, y = (np.insert(v[c], begin + size, v[c][begin]) for c in "xy")
            low = begin + np.arange(len(begin))
            at = np.sort(np.append(low, _far(x, y, low, low + size, tolerance)))
            line = np.searchsorted(low, at, side="right") - 1
            enough = np.bincount(line, minlength=len(low))[line] >= 3
            at = (at - line)[enough]
            yield pa.RecordBatch.from_arrays([pa.array(v[f.name][at], f.type) for f in shape], schema=shape)

    point = [*LINE, "idx", "x", "y"]
    long = lines.where(col("idx") >= LONG).select(*LINE).distinct()
    none = long.isEmpty()
    short = (lines if none else lines.join(long, LINE, "left_anti")).select(*point)
    kept = short.repartition(*LINE).sortWithinPartitions(*LINE, "idx").mapInArrow(run, f"{IMAGE} long, ring int, idx int, x double, y double")
    return kept if none else kept.unionByName(_simplified_in_rounds(lines.join(long, LINE, "left_semi"), tolerance))


def _simplified_in_rounds(lines: DataFrame, tolerance: float) -> DataFrame:
    """As simplified, for lines that spread over tasks. Each round settles parts or halves them; settled ones drop out."""
    point = [*LINE, "idx", "x", "y"]
    first = lines.where("idx = 0").select(*LINE, col("x").alias("lx"), col("y").alias("ly"))
    size = lines.groupBy(*LINE).agg((F.max("idx") + 1).alias("high"))
    kept = [lines.where("idx = 0").select(*point)]
    open_ = lines.where("idx > 0").select(*point).join(first, LINE).join(size, LINE)
    open_ = stored(open_.select(*point, F.lit(0).alias("low"), "high", "lx", "ly", col("lx").alias("hx"), col("ly").alias("hy")), "parts")
    part = [*LINE, "low"]
    while not open_.isEmpty():
        far = open_.withColumn("_d", _away("x", "y")).groupBy(*part).agg(F.max(F.struct("_d", (-col("idx")).alias("i"), "x", "y")).alias("m"))
        split = stored(far.where(col("m._d") > tolerance).select(*part, (-col("m.i")).alias("at"), col("m.x").alias("sx"), col("m.y").alias("sy")), "splits")
        kept.append(split.select(*LINE, col("at").alias("idx"), col("sx").alias("x"), col("sy").alias("y")))
        joined = open_.join(split, part).where("idx <> at")
        before = col("idx") < col("at")
        halves = {"low": ("low", "at"), "lx": ("lx", "sx"), "ly": ("ly", "sy")}
        after = {"high": ("at", "high"), "hx": ("sx", "hx"), "hy": ("sy", "hy")}
        fresh = joined.select(*point, *(F.when(before, col(a)).otherwise(col(b)).alias(n) for n, (a, b) in (halves | after).items()))
        done, open_ = open_, stored(fresh, "parts")
        discard(done)
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    every = stored(every, "kept")
    enough = every.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*LINE)
    return every.join(enough, LINE, "left_semi")


def contours(found: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """(image_id, ring, idx, x, y): the segments of each image stitched into lines, simplified, and numbered anew."""
    kept = simplified(stored(stitched(found), "lines"), tolerance)
    idx = F.row_number().over(Window.partitionBy(*LINE).orderBy("idx")) - 1
    return kept.select(*LINE, idx.alias("idx"), "x", "y")


ship(__name__)
