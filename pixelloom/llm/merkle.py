"""Merkle manifests: a digest over a whole dataset, with an authentication path for each row.

Each row is a leaf: the SHA-256 of its fields, each as its length in UTF-8 bytes, a colon and the value, or - if null. Per group
(language) leaves ascend by id, and every two consecutive nodes become the hash of their hex digests (a last one alone its own
hash) until one is left, the subroot; the subroots, ordered by group with null first, become the root in the same way.

Leaves are digested where the rows lie; from then on only ids and digests move. They are range-sorted and numbered within their
group by counts of each partition, then dealt into aligned blocks of 2 ** BLOCK_LEVELS, the blocks' tops into blocks again, and so on:
a hot group is as many blocks as it needs. Within a block, paths come by Merkle traversal: a stack for each level
holds the pieces of that level's next sibling, each leaf spends a fixed number of steps on the stacks that lag most, and so the
path advances leaf by leaf with memory for one path and one stack a level. The path above a block is shared by its leaves and appended.

Cases: null fields are -, a null id comes first in its group, a null group is a group of its own and the first. Rows that
repeat an id are ordered by their digests; equal rows are leaves each, with digests and root in common. Empty and very long texts are
digested whole. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import settled
from .common import ship, stored

BLOCK_LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every so many ids, by their checksum, stand for rows that were tampered with.
TAMPERED = 7


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, fields)), 256))


def joined_hash(left: str | None, right: str | None = None) -> str | None:
    """The parent of two hex digests or of one; an absent left node has an absent parent."""
    return left and sha256((left + (right or "")).encode()).hexdigest()


class LevelStack:
    """Pieces of one node at `level`, built from the nodes at the bottom by one step at a time."""

    def __init__(self, level: int, node: str | None) -> None:
        self.level, self.node, self.pieces, self.next, self.done = level, node, [], 0, True

    def restart(self, first: int) -> None:
        self.pieces, self.next, self.done = [], first, False

    def lag(self) -> int:
        """Height of the lowest piece; the level itself before the first piece."""
        return self.pieces[-1][0] if self.pieces else self.level

    def step(self, nodes: Sequence[str]) -> None:
        p = self.pieces
        if len(p) > 1 and p[-1][0] == p[-2][0]:
            height, right = p.pop()
            p[-1] = (height + 1, joined_hash(p[-1][1], right))
        else:
            p.append((0, nodes[self.next] if self.next < len(nodes) else None))
            self.next += 1
        if p[0][0] == self.level:
            self.node, self.done = p[0][1], True


def begin(nodes: Sequence[str], levels: int) -> tuple[list[LevelStack], list[str | None], str]:
    """Stacks that hold the first node of each level, the second node of each (the first leaf's siblings), and the top node."""
    firsts, seconds, pieces = [], [None] * levels, []
    for i in range(1 << levels):
        height, node = 0, nodes[i] if i < len(nodes) else None
        while True:
            if height < levels and i + 1 == 1 << height:
                firsts.append(LevelStack(height, node))
            elif height < levels and i + 1 == 2 << height:
                seconds[height] = node
            if not (pieces and pieces[-1][0] == height):
                break
            node = joined_hash(pieces.pop()[1], node)
            height += 1
        pieces.append((height, node))
    return firsts, seconds, pieces[0][1]


def authentication_paths(nodes: Sequence[str], levels: int) -> Iterator[list[str | None]]:
    """For each node in turn its siblings from the bottom up, None where a node stands alone."""
    stacks, siblings, _ = begin(nodes, levels)
    for at in range(1, len(nodes) + 1):
        yield siblings
        for level, stack in enumerate(stacks):
            if at & ((1 << level) - 1):
                break
            siblings[level] = stack.node
            first = (at + (1 << level)) ^ (1 << level)
            if first < 1 << levels:
                stack.restart(first)
        for _ in range(2 * levels - 1):
            behind = min((s for s in stacks if not s.done), key=LevelStack.lag, default=None)
            if behind is None:
                break
            behind.step(nodes)


def height(n: int) -> int:
    """Levels of a block whose tree has n nodes at the block's bottom."""
    return min(BLOCK_LEVELS, (n - 1).bit_length())


def path_text(at: int, siblings: Sequence[str | None]) -> str:
    """A path as text: for each level L or R, the side of the sibling, and its digest, or - where the node stands alone."""
    return "".join("-" if s is None else ("L" if at >> level & 1 else "R") + s for level, s in enumerate(siblings))


def folded(node: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    at = 0
    while at < len(path):
        side = path[at]
        if side == "-":
            node, at = joined_hash(node), at + 1
        else:
            sibling, at = path[at + 1 : at + 65], at + 65
            node = joined_hash(sibling, node) if side == "L" else joined_hash(node, sibling)
    return node


def path_digest(path: str) -> str:
    """The hash of the siblings on a path."""
    return sha256(path.translate(_SIDES).encode()).hexdigest()


_SIDES = str.maketrans("", "", "LR-")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (tree and others) plus `pos`, the place within the tree by `order`, and `size`, the tree's rows."""
    spread = rows.repartitionByRange(*map(F.col, ("tree", *order))).sortWithinPartitions("tree", *order)
    placed = stored(spread.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy(F.col("tree").alias("of"), part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select("of", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")), "starts")
    joined = placed.withColumn("in_part", part).join(starts, F.col("tree").eqNullSafe(F.col("of")) & (F.col("in_part") == F.col("part")))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "size")


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], pa.StructArray]]:
    """(row, hex digests, members) of each block of a batch."""
    lists = batch.column(batch.schema.get_field_index("members"))
    for i in range(batch.num_rows):
        members = lists[i].values
        yield i, [x.hex() for x in members.field("node").to_pylist()], members


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).to_pylist()
        tops = [bytes.fromhex(begin(nodes, height(sizes[i]))[2]) for i, nodes, _ in _members(batch)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(tops, pa.binary())], names=["tree", "size", "block", "node"])


def tree_tiers(nodes: DataFrame, *items: str) -> tuple[list[DataFrame], DataFrame]:
    """Of nodes (tree, size, pos, node, items): the blocks of each tier, the lowest first, and (tree, node), the trees' top nodes."""
    fan, kind = 1 << BLOCK_LEVELS, nodes.schema["tree"].dataType.simpleString()
    tiers, tops = [], []
    while True:
        members = F.sort_array(F.collect_list(F.struct("pos", "node", *items)))
        blocks = stored(nodes.groupBy("tree", "size", F.floor(F.col("pos") / fan).alias("block")).agg(members.alias("members")), "blocks")
        top = stored(blocks.mapInArrow(_tops, f"tree {kind}, size long, block long, node binary"), "tops")
        tiers.append(blocks)
        tops.append(top.where(F.col("size") <= fan).select("tree", "node"))
        rest = top.where(F.col("size") > fan)
        if rest.isEmpty():
            break
        nodes, items = rest.select("tree", F.ceil(F.col("size") / fan).alias("size"), F.col("block").alias("pos"), "node"), ()
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return tiers, whole


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a tier's nodes, from blocks with the path above each."""
    for batch in batches:
        sizes, uppers = batch.column(1).to_pylist(), batch.column(4).to_pylist()
        for i, nodes, members in _members(batch):
            paths = [path_text(k, s) + uppers[i] for k, s in enumerate(authentication_paths(nodes, height(sizes[i])))]
            yield pa.RecordBatch.from_arrays([_repeated(batch.column(0), i, len(nodes)), members.field("pos"), pa.array(paths, pa.string()), _repeated(batch.column(5), i, len(nodes))], names=["of", "at", "upper", "subroot"])


def _repeated(column: pa.Array, i: int, n: int) -> pa.Array:
    return column.take(pa.array([i] * n, pa.int64()))


def with_upper_paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks (tree, size, block, members) with `upper`, the path from a block's top to the root, and `subroot`. above: (of, upper, subroot) of each tree."""
    fan, kind = 1 << BLOCK_LEVELS, tiers[0].schema["tree"].dataType.simpleString()
    same = F.col("tree").eqNullSafe(F.col("of"))
    found = None
    for k in reversed(range(len(tiers))):
        columns = ["tree", "size", "block", "members", "upper", "subroot"]
        joined = tiers[k].where(F.col("size") <= fan).join(above, same).select(*columns)
        if found is not None:
            joined = joined.unionByName(tiers[k].where(F.col("size") > fan).join(found, same & (F.col("block") == F.col("at"))).select(*columns))
        if not k:
            return joined
        found = stored(joined.mapInArrow(_placed, f"of {kind}, at long, upper string, subroot string"), "paths")


def _group_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, upper, subroot) of each group, from the blocks of the tree over the subroots."""
    for batch in batches:
        sizes, uppers = batch.column(1).to_pylist(), batch.column(4).to_pylist()
        for i, nodes, members in _members(batch):
            paths = [path_text(k, s) + uppers[i] for k, s in enumerate(authentication_paths(nodes, height(sizes[i])))]
            yield pa.RecordBatch.from_arrays([members.field("group"), pa.array(paths, pa.string()), pa.array(nodes, pa.string())], names=["of", "upper", "subroot"])


def _proofs(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, uppers, subroots = (batch.column(k).to_pylist() for k in (1, 4, 5))
            for i, nodes, members in _members(batch):
                changed, digests, ends = members.field("changed").to_pylist(), [], []
                for k, siblings in enumerate(authentication_paths(nodes, height(sizes[i]))):
                    path = path_text(k, siblings) + uppers[i]
                    digests.append(path_digest(path))
                    ends.append(folded(changed[k].hex() if changed[k] is not None else nodes[k], path))
                n = len(nodes)
                columns = [members.field("key"), *(pa.array(x, pa.string()) for x in (nodes, [subroots[i]] * n, [root] * n, digests, ends)), pa.array([e == root for e in ends])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def manifest_proofs(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, count: str = "n_chars") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. Rows whose id's checksum TAMPERED divides
    are checked as if 1 had been added to their `count`: they must not verify, unless it is null."""
    own = [F.col(f) for f in fields]
    other = [(F.col(f).cast("decimal(38,0)") + 1).cast("string") if f == count else F.col(f) for f in fields]
    hit = F.crc32(F.col(key).cast("string")) % TAMPERED == 0
    leaves = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), leaf_digest(own).alias("node"), F.when(hit, leaf_digest(other)).alias("changed"))
    tiers, subroots = tree_tiers(numbered(stored(leaves, "leaves"), ("key", "node")), "key", "changed")

    def over() -> tuple[list[DataFrame], DataFrame]:
        groups = stored(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("group"), "node"), "subroots")
        return tree_tiers(numbered(groups, ("group",)), "group")

    top_tiers, tops = over()
    found = tops.head()
    root = bytes(found.node).hex() if found else ""
    kind = docs.schema[group].dataType.simpleString()
    start = docs.sparkSession.range(1).select(F.lit(0).alias("of"), F.lit("").alias("upper"), F.lit("").alias("subroot"))
    above = settled(lambda: with_upper_paths(top_tiers, start).mapInArrow(_group_paths, f"of {kind}, upper string, subroot string"), "above")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_upper_paths(tiers, above).mapInArrow(_proofs(root), schema).withColumnRenamed("key", key)


ship(__name__)
