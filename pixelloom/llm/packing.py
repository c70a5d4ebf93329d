"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Equal rows are counted before they shuffle. Documents are dealt into shards of bounded size by a hash of the whole row, many
copies of one row in portions of COPIES; each shard is packed on its own. Within a shard, pieces come in order of falling size. Bins are indexed by their residual, and each carries a bitmap of what it may not take again:
the sources that have reached their quota and the duplicate clusters that it holds. The successor search starts at the
piece's size and goes on to larger residuals until it finds the tightest compatible bin; a bitmap of residuals for each
conflict key skips residuals at which every bin is blocked, so a hot source or cluster costs no scan of its bins.

A document longer than a bin fills whole bins of its own first; its rest is packed. Nothing is dropped or cut off.

Cases: documents without words (null or empty text) get one row with n_words 0 and no bin. A null source is a source of its
own, a null id an id like any other; ids of any type come back as they are. Repeated rows are copies, numbered from 0, of one
duplicate cluster, so no bin holds two; other texts of the same id are told by their cluster. Clusters are equal normalised
texts unless a cluster column is named (rows without one then conflict with nothing). Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, ship
from .mixing import word_count

CAPACITY = 2048
SOURCE_QUOTA = 2
ROWS_PER_SHARD = 20_000
COPIES = 100


class Bins:
    """Open bins by residual, with what blocks them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.at: dict[int, list[list]] = defaultdict(list)  # residual -> [bin, blocked keys, source counts]
        self.open = 0  # bit r: some bin has residual r
        self.blocked: dict[int, Counter] = defaultdict(Counter)  # key -> residual -> bins that it may not enter
        self.shut: dict[int, int] = defaultdict(int)  # key -> bit r: all bins of residual r are blocked

    def _recount(self, r: int, keys: int) -> None:
        total = len(self.at[r])
        self.open = self.open | 1 << r if total else self.open & ~(1 << r)
        while keys:
            key = (keys & -keys).bit_length() - 1
            keys &= keys - 1
            if total and self.blocked[key][r] == total:
                self.shut[key] |= 1 << r
            else:
                self.shut[key] &= ~(1 << r)

    def _index(self, item: list, r: int, by: int) -> None:
        """Adds (by=1) or removes (by=-1) a bin at residual r."""
        if by > 0:
            self.at[r].append(item)
        else:
            self.at[r].remove(item)
        keys = item[1]
        while keys:
            key = (keys & -keys).bit_length() - 1
            keys &= keys - 1
            self.blocked[key][r] += by
        affected = item[1]
        for other in self.at[r][:1] if len(self.at[r]) > 1 or by < 0 else []:
            affected |= other[1]
        self._recount(r, affected)

    def place(self, size: int, source: int, cluster: int | None, quota: int) -> int:
        """The bin that takes a piece; source and cluster are numbers of conflict keys."""
        mask = 1 << source | (0 if cluster is None else 1 << cluster)
        shut = self.shut[source] | (0 if cluster is None else self.shut[cluster])
        candidates = (self.open & ~shut) >> size
        found, r = None, size
        while candidates and found is None:
            step = (candidates & -candidates).bit_length() - 1
            r, candidates = r + step, candidates >> step
            found = next((b for b in self.at[r] if not b[1] & mask), None)
            candidates &= ~1
        if found is None:
            found, r = [self.made, 0, Counter()], self.capacity
            self.made += 1
        else:
            self._index(found, r, -1)
        found[2][source] += 1
        if found[2][source] >= quota:
            found[1] |= 1 << source
        if cluster is not None:
            found[1] |= 1 << cluster
        if r > size:
            self._index(found, r - size, 1)
        return found[0]


def pack_shard(rows: list[dict], capacity: int, quota: int) -> Iterator[tuple]:
    """(bin or None, row number, copy, piece, word_start, n_words) of each piece of rows (key, source, cluster, size, first, times)."""
    numbers: dict = {}
    copies = Counter()
    for r in rows:
        copies[r["cluster"]] += r["times"]
    order = sorted(range(len(rows)), key=lambda i: (-rows[i]["size"], rows[i]["key"] is None, rows[i]["key"] if rows[i]["key"] is not None else 0, rows[i]["cluster"] or 0, rows[i]["source"] or "", rows[i]["first"]))
    bins, rests = Bins(capacity), []
    for i in order:
        r = rows[i]
        whole, rest = divmod(r["size"], capacity)
        source = numbers.setdefault(("source", r["source"]), len(numbers))
        many = r["cluster"] is not None and copies[r["cluster"]] > 1
        cluster = numbers.setdefault(("cluster", r["cluster"]), len(numbers)) if many else None
        for copy in range(r["first"], r["first"] + r["times"]):
            if not r["size"]:
                yield None, i, copy, 0, 0, 0
            for piece in range(whole):
                yield bins.made, i, copy, piece, piece * capacity, capacity
                bins.made += 1
            if rest:
                rests.append((rest, i, copy, whole, source, cluster))
    rests.sort(key=lambda x: -x[0])
    for size, i, copy, piece, source, cluster in rests:
        yield bins.place(size, source, cluster, quota), i, copy, piece, piece * capacity, size


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA, rows_per_shard: int = ROWS_PER_SHARD, key: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """(bin_id, key, cluster, copy, piece, word_start, n_words): which words of a document go into which bin."""
    shards = 1 + docs.count() // rows_per_shard
    same = F.xxhash64(lowered(F.col(text))) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(F.col(cluster)))
    columns = [F.col(key).alias("key"), F.col(source).cast("string").alias("source"), same.alias("cluster"), word_count(F.col(text)).alias("size")]
    counted = docs.select(*columns).groupBy("key", "source", "cluster", "size").agg(F.count(F.lit(1)).alias("n"))
    portions = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    shard = F.pmod(F.xxhash64("key", "source", "cluster", "size", "first"), F.lit(shards)).cast("int")
    dealt = portions.select(shard.alias("shard"), "key", "source", "cluster", "size", "first", F.least(F.lit(COPIES), F.col("n") - F.col("first")).alias("times"))
    kind = docs.schema[key].dataType.simpleString()

    def pack(number: tuple, table: pa.Table) -> pa.Table:
        found = list(zip(*pack_shard(table.to_pylist(), capacity, quota), strict=True))
        bins, rows, *rest = found
        base = number[0].as_py() << 32
        at = pa.array(rows, pa.int64())
        columns = [pa.array([None if b is None else base + b for b in bins], pa.int64()), table.column("key").take(at), table.column("cluster").take(at)]
        columns += [pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
        return pa.table(columns, names=["bin_id", "key", "cluster", "copy", "piece", "word_start", "n_words"])

    packed = dealt.groupBy("shard").applyInArrow(pack, f"bin_id long, key {kind}, cluster long, copy int, piece int, word_start long, n_words long")
    return packed.withColumnRenamed("key", key)


ship(__name__)
