"""Exact dedup with two Bloom passes, DataFrame functions only.

Pass 1 inserts the hash of every text into a blocked counting filter: a block is one long with CELLS counters of three bits, and
a count of its texts on top. Each text adds one number to its block, so partial sums combine before the shuffle, and no more
rows than blocks leave a task. A block of eight texts or more overflows (as one with a hot group of copies does) and counts
as hit twice everywhere. Cells hit twice form the second filter. Pass 2 tests every row against it: a text that occurs twice
hits twice-filled cells only, so a row that fails the test is unique and passes straight through; only the possibly repeated
rows (of unique ones about 1.5 %) shuffle, and grouping by the SHA-256 of the normalised text removes false positives.

The filter has one to two blocks for each row, whatever the number of rows. Of these only blocks with cells hit twice are kept; they
are broadcast up to FILTER_ROWS of them, and joined by block beyond: keys and digests shuffle then, each once, but never a text. What
is read with its text are the groups of two rows or more that come out; where they are too many to be broadcast, only rows that hit a
Bloom filter of their digests shuffle with their text.

Cases: null text counts as empty, and all empty texts are one group. A null id is smaller than any other. Rows that
repeat an id within a group share their fate in exact_dedup (all are kept if the id is the largest); drop_exact_copies
leaves one row. Empty tables give empty results. Other columns are never read by exact_dedup; drop_exact_copies keeps
them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lowered, power_of_two, stored
from .url_filter import possible_hits

CELLS = 20
#: Lowest bit of each counter, and the step of a block's count of texts: the eighth one overflows.
ONES = sum(1 << 3 * i for i in range(CELLS))
TEXT = 1 << 60
MAX_BLOCKS = 1 << 40
#: Rows of a filter or of a table of groups that are sent to every task (some 100 MB); larger ones are joined.
FILTER_ROWS = 1 << 21
#: Blocks of the filter that keeps texts from shuffling where there are more groups.
MAX_SENT = 1 << 20


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(lowered(text), 256))


def _places(digest: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a digest, and a word with the lowest bits of its two counters there."""
    h = F.xxhash64(digest)
    high = F.shiftrightunsigned(h, 40)
    first = F.pmod(high, F.lit(CELLS))
    second = F.pmod(first + 1 + F.pmod(F.floor(high / CELLS), F.lit(CELLS - 1)), F.lit(CELLS))
    bit = lambda cell: F.call_function("shiftleft", F.lit(1).cast("long"), (3 * cell).cast("int"))
    return h.bitwiseAND(F.lit(blocks - 1)), bit(first) + bit(second)


def repeat_filter(digests: DataFrame, digest: Column, blocks: int) -> DataFrame:
    """(block, twice) of the blocks with cells that two or more digests hit."""
    block, word = _places(digest, blocks)
    sums = digests.select(block.alias("block"), (word + F.lit(TEXT)).alias("word")).groupBy("block").agg(F.try_sum("word").alias("sums"))
    twice = F.shiftright("sums", 1).bitwiseOR(F.shiftright("sums", 2)).bitwiseAND(F.lit(ONES))
    return sums.select("block", F.coalesce(twice, F.lit(ONES)).alias("twice")).where("twice <> 0")


def flag_possible_repeats(rows: DataFrame, digest: Column, digests: DataFrame, n: int, flag: str) -> DataFrame:
    """rows plus the boolean `flag`: false means that no other of the n `digests` equals a row's."""
    blocks = power_of_two(n, 1024, MAX_BLOCKS)
    block_name, twice_name = fresh(rows.columns, "block", "twice")
    seen = stored(repeat_filter(digests, digest, blocks).withColumnsRenamed({"block": block_name, "twice": twice_name}), "filter")
    block, word = _places(digest, blocks)
    hit = F.coalesce(F.col(twice_name).bitwiseAND(word) == word, F.lit(False))
    joined = rows.withColumn(block_name, block).join(F.broadcast(seen) if seen.count() <= FILTER_ROWS else seen, block_name, "left")
    return joined.withColumn(flag, hit).drop(block_name, twice_name)


def repeated_groups(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, digest): the rows with the flag `maybe`, and (digest, keep, n, n_keep) of the digests that more than one row has: the
    largest key, the number of rows, and of rows with that key."""
    flagged = stored(flag_possible_repeats(digests, F.col("digest"), digests, digests.count(), "maybe"), "flagged")
    each = flagged.where("maybe").groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("digest").agg(F.max(F.struct("key", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    return flagged, stored(groups.select("digest", F.col("top.key").alias("keep"), "n", F.col("top.n").alias("n_keep")), "groups")


def split_by_groups(rows: DataFrame, digest: str, groups: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """rows whose digest is in none of the groups, and the others with keep, n and n_keep as a struct. Up to FILTER_ROWS groups
    are broadcast, and no row shuffles; beyond, only rows that hit a blocked Bloom filter of the groups' digests do."""
    packed = groups.select(F.col("digest").alias(digest), F.struct("keep", "n", "n_keep").alias(group))
    count = groups.count()
    if count <= FILTER_ROWS:
        joined = rows.join(F.broadcast(packed), digest, "left")
        return joined.where(F.col(group).isNull()).select(*rows.columns), joined.where(F.col(group).isNotNull()).select(*rows.columns, group)
    (maybe,) = fresh(rows.columns, "maybe")
    tested = possible_hits(rows, F.col(digest), groups, "digest", count, maybe, MAX_SENT)
    hits = tested.where(maybe).join(packed, digest, "left")
    straight = tested.where(~F.col(maybe)).select(*rows.columns).unionByName(hits.where(F.col(group).isNull()).select(*rows.columns))
    return straight, hits.where(F.col(group).isNotNull()).select(*rows.columns, group)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row; of equal texts the largest key stays."""
    flagged, groups = repeated_groups(stored(docs.select(F.col(key).alias("key"), text_digest(F.col(text)).alias("digest")), "digests"))
    one = F.lit(1).cast("long")
    straight = flagged.where("NOT maybe").select("key", "digest", F.col("key").alias("keep_id"), one.alias("group_size"))
    found = flagged.where("maybe").join(groups.select("digest", "keep", "n"), "digest", "left")
    alone = F.col("n").isNull()
    settled = found.select("key", "digest", F.when(alone, F.col("key")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", one).alias("group_size"))
    sha = F.lower(F.hex("digest"))
    return straight.unionByName(settled).select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Groups are found on keys and digests alone; then a row passes straight if it is of no
    group or the only row with its group's largest key. Where several rows have that key, one of them is taken."""
    digest, row, group = fresh(docs.columns, "digest", "row", "group")
    _, groups = repeated_groups(stored(docs.select(F.col(key).alias("key"), text_digest(F.col(text)).alias("digest")), "digests"))
    straight, grouped = split_by_groups(docs.withColumn(digest, text_digest(F.col(text))), digest, groups, group)
    largest = grouped.where(F.col(key).eqNullSafe(F.col(group)["keep"]))
    only, several = largest.where(F.col(group)["n_keep"] == 1).select(*docs.columns), largest.where(F.col(group)["n_keep"] > 1)
    best = several.groupBy(digest).agg(F.max_by(F.struct(*docs.columns), F.struct(key, text)).alias(row))
    return straight.select(*docs.columns).unionByName(only).unionByName(best.select(f"{row}.*"))
