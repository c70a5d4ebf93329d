"""Near-duplicate detection with b-bit MinHash.

Each text's set of word shingles gets HASHES minima. Bands of them, hashed, are the buckets for candidate generation; of each
minimum only the low BITS bits are kept, packed into 64-bit words, and the similarity of a candidate pair is estimated from
the number of equal bit groups, corrected for chance collisions. Pairs whose estimate is more than MARGIN below the threshold
are ruled out (over four standard errors); all others are confirmed on the full sets.

Texts with equal sets form one class, and only a class's representative (its smallest id) goes on, so a group of copies costs
one row. Candidates do not pair up all members of a bucket: first every member meets the bucket's leader, and each document
tries its best leader; confirmed links merge components. Then a bucket's strays, whose component is not its leader's, meet
the members of other components, and each tries its best candidate. With the components merged again, the strays that are left
meet all members of other components. No link between different texts is dropped. Buckets of up to SMALL members meet by a
join; larger ones are compared in blocks of bounded size, which put out only each stray's best candidate, and in the end
only confirmed links, one for each stray and component; full sets go only to the rows that are near enough to another.

Cases: texts without words have an empty set and are linked with nothing. Texts with fewer words than a shingle have the whole
sequence as their only shingle. Rows with a null id are linked with nothing and have a null component. Rows that repeat an
id share its component. Very long texts are hashed whole, a bounded number of bytes at a time for all other texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import mixed64, ship, stored

BANDS, ROWS, BITS = 24, 4, 4
HASHES = BANDS * ROWS
PER_WORD = 64 // BITS
WORDS = HASHES // PER_WORD
MARGIN = 0.18
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 18
BROADCAST_IDS = 1 << 20
SMALL, BLOCK = 48, 1024

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _odd(n: int, seed: int, kind: type) -> np.ndarray:
    info = np.iinfo(kind)
    return np.random.default_rng(seed).integers(0, info.max, n, dtype=kind, endpoint=True) | kind(1)


def text_chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with about `size` bytes; a longer text is a run of its own."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the number of the first word of each row (with the end)."""
    space = _SPACE[data]
    after = np.empty(len(data), bool)
    after[1:] = space[:-1]
    after[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(after & ~space)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    at = np.arange(len(data))
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = at - np.maximum.accumulate(begun)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    values = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place]
    values[space] = 0
    return mixed64(np.add.reduceat(values, starts)), bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words, bounds = word_hashes(data, offsets)
    factors = _odd(width, 11, np.uint64)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i, f in enumerate(factors):
        joined += words[i : i + len(joined)] * f
    joined = mixed64(joined)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            out.append(mixed64(np.array([np.bitwise_xor.reduce(mixed64(words[a:b] + np.arange(b - a, dtype=np.uint64))) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(joined[:0])
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(HASHES, sets) uint32; the sets are not empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low, high = every.astype(np.uint32), (every >> np.uint64(32)).astype(np.uint32)
    a, b = _odd(HASHES, 21, np.uint32), _odd(HASHES, 22, np.uint32)
    out, x, y = np.empty((HASHES, len(sets)), np.uint32), np.empty_like(low), np.empty_like(low)
    for k in range(HASHES):
        np.multiply(low, a[k], out=x)
        np.multiply(high, b[k], out=y)
        x += y
        out[k] = np.minimum.reduceat(x, starts)
    return out


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, WORDS) packed low bits, (sets, BANDS) bucket numbers."""
    wide = least.astype(np.uint64)
    low = mixed64(wide + np.uint64(1)) & np.uint64((1 << BITS) - 1)
    low <<= (np.arange(HASHES, dtype=np.uint64) % np.uint64(PER_WORD) * np.uint64(BITS))[:, None]
    packed = np.bitwise_or.reduce(low.reshape(WORDS, PER_WORD, -1), axis=1)
    factors = _odd(ROWS, 31, np.uint64)
    banded = (mixed64(wide).reshape(BANDS, ROWS, -1) * factors[None, :, None]).sum(axis=1, dtype=np.uint64)
    return packed.T.view(np.int64), mixed64(banded + np.arange(BANDS, dtype=np.uint64)[:, None]).T.view(np.int64)


def _longs(rows: np.ndarray, width: int, present: np.ndarray) -> pa.Array:
    """A list column with `width` longs where present, else null."""
    offsets = np.concatenate([[0], np.cumsum(present * width)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1), pa.int64()))
    return pa.ListArray.from_buffers(lists.type, len(present), [pa.array(present).buffers()[1], lists.buffers()[1]], children=[lists.values])


def sketch(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(key, n, f1, f2, sig, bands) of each text: set size, fingerprint of the set, packed signature, bucket numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1), CHUNK):
                sets = shingle_sets(data, offsets, width)
                size = np.array([len(s) for s in sets], np.int64)
                filled = [s for s in sets if len(s)]
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                sig, bands = np.empty((0, WORDS), np.int64), np.empty((0, BANDS), np.int64)
                if filled:
                    every, starts = np.concatenate(filled), np.cumsum([0, *map(len, filled[:-1])])
                    f1[size > 0] = np.add.reduceat(mixed64(every + np.uint64(5)), starts)
                    f2[size > 0] = np.bitwise_xor.reduceat(mixed64(every ^ _BASE), starts)
                    sig, bands = signatures(minima(filled))
                keys = batch.column(0).slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _longs(sig, WORDS, size > 0), _longs(bands, BANDS, size > 0)],
                    names=["key", "n", "f1", "f2", "sig", "bands"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n long, f1 long, f2 long, sig array<long>, bands array<long>")


def full_sets(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(key, members): the whole shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_chunks(batch.column(1), CHUNK):
                sets = shingle_sets(data, offsets, width)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["key", "members"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, members array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the equal bit groups of two packed signatures, corrected for chance: (m - c) / (1 - c), c = 2^-BITS."""
    ones = F.lit(int("0001" * PER_WORD, 2)).cast("long")
    unequal = F.lit(0)
    for i in range(WORDS):
        x = a[i].bitwiseXOR(b[i])
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        unequal = unequal + F.bit_count(x.bitwiseAND(ones))
    c = 2.0**-BITS
    return (1 - unequal / F.lit(float(HASHES)) - c) / (1 - c)


def _chosen(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids: by broadcast up to BROADCAST_IDS of them, else by shuffling."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


class Linker:
    """Confirms candidate pairs (a, b, est) of representatives on their full sets."""

    def __init__(self, docs: DataFrame, width: int, percent: int, key: str, text: str) -> None:
        self.docs, self.width, self.percent, self.key, self.text = docs.select(key, text), width, percent, key, text

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias(self.key))
        texts = _chosen(self.docs, ids, self.key)
        sets = stored(full_sets(texts, self.width, self.key, self.text), "sets")
        left, right = sets.select(F.col("key").alias("a"), F.col("members").alias("_a")), sets.select(F.col("key").alias("b"), F.col("members").alias("_b"))
        joined = pairs.select("a", "b").join(right, "b").join(left, "a")
        both = F.size(F.array_intersect("_a", "_b"))
        return joined.where(100 * both >= self.percent * (F.size("_a") + F.size("_b") - both)).select("a", "b")


def rooted(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) with parent < node, by jumping to the parent's parent until nothing moves."""
    now = stored(parents, "parents")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        now = stored(now.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        moved = not now.where("moved").isEmpty()
        now = now.select("node", "parent")
        if not moved:
            return now.withColumnRenamed("parent", "root")


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(kind).reshape(-1, width)


def equal_groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate for packed signatures, as in estimate()."""
    x = a ^ b
    step = 1
    while step < BITS:
        x |= x >> np.uint64(step)
        step *= 2
    unequal = np.bitwise_count(x & np.uint64(int("0001" * PER_WORD, 2))).sum(axis=-1, dtype=np.int64)
    return (1 - unequal / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def best_of_block(block: pa.Table, low: float) -> pa.Table:
    """(stray, other, est): of each stray of a block, its best candidate in another component."""
    side = block.column("stray").to_numpy(zero_copy_only=False)
    key, comp, sig = block.column("key").to_numpy(), block.column("comp").to_numpy(), _matrix(block.column("sig"), WORDS, np.uint64)
    order = np.argsort(key, kind="stable")
    x, y = order[side[order]], order[~side[order]]
    out: list[list[np.ndarray]] = [[], [], []]
    for i in range(0, len(x) if len(y) else 0, 64):
        part = x[i : i + 64]
        est = np.where(comp[part][:, None] != comp[y][None], equal_groups(sig[part][:, None], sig[y][None]), -1.0)
        top = est.argmax(axis=1)
        value = est[np.arange(len(part)), top]
        for o, v in zip(out, (key[part], key[y][top], value), strict=True):
            o.append(v[value >= low])
    kinds = (np.int64, np.int64, np.float64)
    return pa.table({n: np.concatenate([np.empty(0, k), *o]) for n, o, k in zip(("stray", "other", "est"), out, kinds, strict=True)})


def near_in_block(block: pa.Table, low: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(stray, others, estimates) by place: of each stray, the members of other components that are near enough. A pair is judged
    in the bucket of its first common band only."""
    side = block.column("stray").to_numpy(zero_copy_only=False)
    comp, sig = block.column("comp").to_numpy(), _matrix(block.column("sig"), WORDS, np.uint64)
    bands, bucket = _matrix(block.column("bands"), BANDS, np.int64), block.column("bucket")[0].as_py()
    y = np.flatnonzero(~side)
    for i in np.flatnonzero(side):
        est = equal_groups(sig[i][None], sig[y])
        near = np.flatnonzero((est >= low) & (comp[y] != comp[i]))
        near = near[bands[i][(bands[i][None] == bands[y[near]]).argmax(axis=1)] == bucket]
        yield int(i), y[near], est[near]


def candidates_of_block(block: pa.Table, low: float) -> pa.Table:
    """The rows (bucket, sb, mb, key, comp, stray) of a block that are near enough to another: those whose sets are needed."""
    wanted = np.zeros(len(block), bool)
    for i, others, _ in near_in_block(block, low):
        wanted[others] = True
        wanted[i] |= len(others) > 0
    return block.select(["bucket", "sb", "mb", "key", "comp", "stray"]).filter(pa.array(wanted))


def links_of_block(block: pa.Table, low: float, percent: int) -> pa.Table:
    """(a, b): of each stray, the first confirmed link into each other component, best estimates first."""
    key, comp, sets, found = block.column("key").to_numpy(), block.column("comp").to_numpy(), block.column("members").combine_chunks(), []
    members: dict[int, np.ndarray] = {}

    def members_of(i: int) -> np.ndarray:
        if i not in members:
            members[i] = sets[i].values.to_numpy()
        return members[i]

    for i, others, est in near_in_block(block, low):
        for of in np.unique(comp[others]):
            own = comp[others] == of
            for j in others[own][np.argsort(-est[own], kind="stable")]:
                a, b = members_of(i), members_of(int(j))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found.append((min(key[i], key[j]), max(key[i], key[j])))
                    break
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (bucket, many, strays, key, stray, ...) dealt into blocks (bucket, sb, mb): each stray meets each member of its bucket in
    one block. A stray is also one of the members that other strays meet. Members are repeated once for each block of strays, of
    which a bucket with few strays has one."""
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("key"), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    strays = rows.where("stray").withColumn("sb", own("strays")).withColumn("mb", every("many"))
    others = rows.withColumn("stray", F.lit(False)).withColumn("mb", own("many")).withColumn("sb", every("strays"))
    return strays.unionByName(others)


def _with_strays(placed: DataFrame) -> DataFrame:
    """placed (bucket, many, key, comp, home) plus stray, of the buckets that have strays, and their number."""
    marked = stored(placed.select("bucket", "many", "key", "comp", "home", (F.col("comp") != F.col("home")).alias("stray")), "placed")
    return stored(marked.join(marked.where("stray").groupBy("bucket").agg(F.count(F.lit(1)).alias("strays")), "bucket"), "strays")


def _met(placed: DataFrame, sigs: DataFrame, low: float) -> DataFrame:
    """(stray, other, est): pairs of small buckets that join different components and whose estimate is not too low."""
    small = placed.where(F.col("many") <= SMALL).join(sigs, "key")
    x, y = small.where("stray").alias("x"), small.alias("y")
    est = estimate(F.col("x.sig"), F.col("y.sig"))
    passing = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.comp") != F.col("y.comp")) & (est >= low)
    return stored(x.join(y, passing).select(F.col("x.key").alias("stray"), F.col("y.key").alias("other"), est.alias("est")).distinct(), "met")


def _between(links: DataFrame, comps: DataFrame) -> DataFrame:
    """links (a, b) as links of components (node, root)."""
    ca, cb = (comps.select(F.col("node").alias(i), F.col("root").alias(f"_r{i}")) for i in "ab")
    return links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: components of 100 * intersection >= percent * union. Ids are integers."""
    low = percent / 100 - MARGIN
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    sketched = stored(sketch(docs, width, "key", "text"), "sketched")
    classes = stored(sketched.where("n > 0 AND key IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("key").alias("rep")), "classes")
    reps = stored(sketched.join(classes.select(F.col("rep").alias("key"), "f1", "f2", "n"), ["key", "f1", "f2", "n"], "left_semi").select("key", "sig", "bands"), "reps")
    rows = reps.select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1")
    members = stored(rows.join(stored(shared, "shared"), "bucket").select("bucket", "lead", "many", "key"), "members")
    sigs = reps.select("key", "sig")
    linker = Linker(docs, width, percent, "key", "text")

    sa, sb = (sigs.select(F.col("key").alias(x), F.col("sig").alias(f"_s{x}")) for x in "ab")
    stars = members.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct()
    stars = stars.join(sb, "b").join(sa, "a").select("a", "b", estimate(F.col("_sa"), F.col("_sb")).alias("est")).where(F.col("est") >= low)
    best = stored(stars.groupBy("b").agg(F.max(F.struct("est", "a")).alias("_x")).select("_x.a", "b"), "pairs")
    comps = rooted(linker.confirmed(best).select(F.col("b").alias("node"), F.col("a").alias("parent")))

    # The members of buckets with strays, with their components
    known = comps.withColumnRenamed("node", "key")
    placed = members.join(known, "key", "left").join(comps.select(F.col("node").alias("lead"), F.col("root").alias("_home")), "lead", "left")
    placed = placed.select("bucket", "many", "key", F.coalesce("root", "key").alias("comp"), F.coalesce("_home", "lead").alias("home"))
    placed = _with_strays(placed)

    def compare(block: pa.Table) -> pa.Table:
        return best_of_block(block, low)

    def candidates(block: pa.Table) -> pa.Table:
        return candidates_of_block(block, low)

    def link(block: pa.Table) -> pa.Table:
        return links_of_block(block, low, percent)

    tops = _blocks(placed.where(F.col("many") > SMALL).join(sigs, "key")).groupBy("bucket", "sb", "mb").applyInArrow(compare, "stray long, other long, est double")
    top = _met(placed, sigs, low).unionByName(tops).groupBy("stray").agg(F.max(F.struct("est", "other")).alias("_x")).select("stray", "_x.other")
    top = stored(top.select(F.least("stray", "other").alias("a"), F.greatest("stray", "other").alias("b")).distinct(), "pairs")
    second = components(_between(linker.confirmed(top), comps), "a", "b").withColumnsRenamed({"node": "comp", "root": "_new"})

    # With these merged: all that still join different components
    placed = placed.join(second, "comp", "left").join(second.withColumnsRenamed({"comp": "home", "_new": "_newhome"}), "home", "left")
    placed = _with_strays(placed.select("bucket", "many", "key", F.coalesce("_new", "comp").alias("comp"), F.coalesce("_newhome", "home").alias("home")))
    rest = _met(placed, sigs, low).select(F.least("stray", "other").alias("a"), F.greatest("stray", "other").alias("b")).distinct()
    third = linker.confirmed(stored(rest.join(top, ["a", "b"], "left_anti"), "pairs"))
    large = _blocks(placed.where(F.col("many") > SMALL).join(reps, "key")).groupBy("bucket", "sb", "mb")
    near = stored(large.applyInArrow(candidates, "bucket long, sb int, mb int, key long, comp long, stray boolean"), "near")
    texts = _chosen(docs, stored(near.select("key").distinct(), "ids"), "key").dropDuplicates(["key"])
    near = near.join(reps, "key").join(full_sets(texts, width, "key", "text"), "key")
    fourth = near.groupBy("bucket", "sb", "mb").applyInArrow(link, "a long, b long")
    new = second.select(F.col("comp").alias("node"), F.col("_new").alias("root"))
    later = _between(_between(third.unionByName(fourth), comps), new)
    merged = components(later, "a", "b").select(F.col("node").alias("_second"), F.col("root").alias("_third"))

    first = F.coalesce("root", "rep")
    of_class = classes.join(comps, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", first.alias("_first"))
    of_class = of_class.join(second.withColumnRenamed("comp", "_first"), "_first", "left").select("f1", "f2", "n", F.coalesce("_new", "_first").alias("_second"))
    of_class = of_class.join(merged, "_second", "left").select("f1", "f2", "n", F.coalesce("_third", "_second").alias("_component"))
    found = sketched.select("key", "n", "f1", "f2").join(stored(of_class, "named"), ["f1", "f2", "n"], "left")
    component = F.coalesce(F.when(F.col("key").isNotNull(), F.col("_component")), F.col("key"))
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one document of each component, with all their columns."""
    gone = stored(near_duplicates(docs, width, percent, key, text).where("NOT kept").select(key), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key, "left_anti")


ship(__name__)
