"""Ranked lexical search: an inverted index in shards, searched document at a time.

Index: each task cuts its documents into shards of about SHARD_BYTES of text, so no text shuffles. A shard is one row with its
ids in order and their numbers of terms, and one row for each term with its postings: gaps between documents and counts, as
bytes of seven bits each. A term is known by two 64-bit hashes of its bytes, A-Z lower-cased.

Search: queries go in blocks of QUERY_BLOCK; the terms they ask for select postings by an equi-join, and with these come weights from
the documents that hold each term over all shards. For each shard and block a k-way heap merges the postings of a query's terms by
document; a second, bounded heap keeps the best, keyed by score, then id. Terms whose highest contributions together can't lift a document
above the worst of a full heap no longer drive the merge: they are probed by halving, and only while the document can still get in.
So no document that belongs to the result is passed over. The shards' results meet by query, each task's own best only.

Scores are whole numbers: a term in a document counts weight * ((10^9 * tf) div (1000 * tf + 8 * m)), m by the document's number of terms.

Cases: null text has no terms. Documents with a null id count and rank before others of their score, rows that repeat
an id rank as documents each; rows that repeat a query's id are one query. A query that is null, empty or has no term that occurs has no result. Longer texts than a shard are
a shard each, and cut into pieces between terms while they are hashed. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed64, ship, stored
from .minhash import text_chunks

SHARD_BYTES = 12 << 20
PIECE = 1 << 18
QUERY_BLOCK = 512
#: Asked terms that are sent to every task; more meet the postings by a shuffle.
SENT_TERMS = 1 << 18
MAX_TASKS = 1 << 14

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and both hashes of each term in some bytes; a gap stands at their start and end."""
    gap = _GAP[data]
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.uint64)
    begun = np.zeros(len(data), np.int64)
    begun[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begun)
    place[gap] = 0
    low = _LOWER[data].astype(np.uint64) + np.uint64(1)
    low[gap] = 0
    found = []
    for base in _BASES:
        powers = np.cumprod(np.full(int(place.max()) + 1, base))
        found.append(mixed64(np.add.reduceat(low * powers[place], starts)))
    return starts, *found


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of each term of some texts, and each text's number of terms."""
    parts, counts, at = [], np.zeros(len(offsets) - 1, np.int64), 0
    if len(offsets) > 1:
        # texts are set apart by a gap of their own
        room = np.insert(data, offsets[1:], 32)
        ends = offsets[1:] + np.arange(1, len(offsets))
        while at < len(room):
            end = min(at + PIECE, len(room))
            if end < len(room):
                gaps = np.flatnonzero(_GAP[room[at:end]])
                if not len(gaps):  # a term longer than a piece
                    later = np.flatnonzero(_GAP[room[end:]])
                    gaps = np.array([end + later[0] - at])
                end = at + int(gaps[-1]) + 1
            starts, first, second = _hashed(room[at:end])
            counts += np.bincount(np.searchsorted(ends, starts + at, "right"), minlength=len(counts))
            parts.append((first, second))
            at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), counts
    return *(np.concatenate(p) for p in zip(*parts, strict=True)), counts


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the last one marked; and where each number ends."""
    values = values.astype(np.uint64)
    widths = np.ones(len(values), np.int64)
    for i in range(1, 9):
        widths += values >= np.uint64(1 << 7 * i)
    ends = np.cumsum(widths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(widths.max(initial=0))):
        has = widths > i
        out[(ends - 1 - i)[has]] = (values[has] >> np.uint64(7 * i)) & np.uint64(127)
    out[ends - 1] |= 128
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """The numbers that packed() was given."""
    found = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(found >= 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    widths, values = ends - starts + 1, np.zeros(len(ends), np.int64)
    for i in range(int(widths.max(initial=0))):
        has = widths > i
        values[has] |= (found[(ends - i)[has]].astype(np.int64) & 127) << 7 * i
    return values


class Shard:
    """Documents while their shard is filled."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts, self.first, self.second = [], [], []
        self.bytes = 0

    def add(self, ids: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        first, second, counts = term_hashes(data, offsets)
        self.ids += ids
        self.counts.append(counts)
        self.first.append(first)
        self.second.append(second)
        self.bytes += len(data)

    def rows(self, number: int) -> pa.RecordBatch:
        """Of the shard, a row with ids and lengths (term 0 and 0, df 0), and a row for each term."""
        counts, first, second = (np.concatenate(x) for x in (self.counts, self.first, self.second))
        null = np.array([x is None for x in self.ids], bool)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        order = np.lexsort((ids, ~null))
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        doc = np.repeat(rank, counts)
        by_term = np.argsort(first, kind="stable")
        first, second, doc = first[by_term], second[by_term], doc[by_term]
        same = first[1:] == first[:-1]
        if (second[1:][same] != second[:-1][same]).any():  # two terms with one first hash
            again = np.lexsort((second, first))
            first, second, doc = first[again], second[again], doc[again]
        fresh_term = np.ones(len(first), bool)
        fresh_term[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        numbers = np.cumsum(fresh_term) - 1
        pairs = np.sort(numbers << 32 | doc)
        heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        tf, pairs = np.diff(np.append(heads, len(pairs))), pairs[heads]
        term, doc = pairs >> 32, pairs & 0xFFFFFFFF
        begins = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
        gaps = np.diff(doc, prepend=0)
        gaps[begins] = doc[begins]
        data, ends = packed(np.stack([gaps, tf], axis=1).ravel())
        cuts = np.concatenate([[0], ends[2 * np.append(begins[1:], len(term)) - 1]]) if len(begins) else np.array([0])
        postings = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        at = np.flatnonzero(fresh_term)
        heads = [pa.array(x[at].view(np.int64)) for x in (first, second)]
        df = pa.array(np.diff(np.append(begins, len(term))).astype(np.int64))
        own = pa.array([ids[order].tobytes() + np.packbits(null[order]).tobytes()], pa.binary()), pa.array([packed(counts[order])[0].tobytes()], pa.binary())
        n = len(begins) + 1
        whole = lambda a, b: pa.concat_arrays([a, b])
        columns = [
            pa.array(np.full(n, number)), whole(pa.array([0]), heads[0]), whole(pa.array([0]), heads[1]), whole(pa.array([0]), df),
            whole(own[1], postings), whole(own[0], pa.nulls(n - 1, pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "first", "second", "df", "postings", "ids"])


INDEX = "shard long, first long, second long, df long, postings binary, ids binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of all shards; rows with `ids` are the shards' documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for begin, data, offsets in text_chunks(batch.column(1).fill_null(""), PIECE):
                if shard.bytes and shard.bytes + len(data) > SHARD_BYTES:
                    yield shard.rows(number)
                    number, shard = number + 1, Shard()
                shard.add(batch.column(0).slice(begin, len(offsets) - 1).to_pylist(), data, offsets)
        if shard.ids:
            yield shard.rows(number)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [unpacked(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([int((c > 0).sum()) for c in counts], pa.int64()), pa.array([int(c.sum()) for c in counts], pa.int64())], names=["n", "terms"])


def asked_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(query, first, second): the terms of each query, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets in text_chunks(batch.column(1).fill_null(""), PIECE):
                first, second, counts = term_hashes(data, offsets)
                of = np.repeat(np.arange(len(counts)), counts)
                own = batch.column(0).slice(begin, len(counts)).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], names=["query", "first", "second"])

    rows = queries.select(F.col(key).cast("long").alias("query"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "query long, first long, second long").distinct()


def impacts(weight: int, tf: np.ndarray, lengths: np.ndarray, n: int, terms: int) -> np.ndarray:
    """What a term adds to each document that holds it."""
    m = 100 - 90 + (90 * lengths * n) // terms
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def best_documents(lists: Sequence[tuple[memoryview, memoryview, int]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best, best first, equal ones by document. lists: for each term its documents in order, what it
    adds to each, and the most that it adds."""
    lists = sorted(lists, key=lambda x: x[2])
    docs, adds = [x[0] for x in lists], [x[1] for x in lists]
    reach, total = [], 0
    for x in lists:
        total += x[2]
        reach.append(total)
    at = [0] * len(lists)
    heads = [(d[0], i) for i, d in enumerate(docs)]
    heapify(heads)
    best: list[tuple[int, int]] = []  # the worst in front: lowest score, then highest document
    bar, idle = 0, 0  # lists before `idle` can't lift a document above the bar together
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            i = heads[0][1]
            p = at[i]
            score += adds[i][p]
            at[i] = p = p + 1
            if p < len(docs[i]):
                heapreplace(heads, (docs[i][p], i))
            else:
                heappop(heads)
        for i in range(idle - 1, -1, -1):
            if score + reach[i] <= bar:
                break
            p = bisect_left(docs[i], doc, at[i])
            at[i] = p
            if p < len(docs[i]) and docs[i][p] == doc:
                score += adds[i][p]
        if score > bar:
            if len(best) < k:
                heappush(best, (score, -doc))
            else:
                heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > bar:
                bar, before = best[0][0], idle
                while idle < len(lists) and reach[idle] <= bar:
                    idle += 1
                if idle > before:
                    heads = [h for h in heads if h[1] >= idle]
                    heapify(heads)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _searcher(n: int, terms: int, k: int):
    def found(rows: list[dict]) -> tuple[list, list, list]:
        """Results of one shard and block: queries, ids, scores."""
        own = next(r for r in rows if r["ids"] is not None)
        lengths = unpacked(own["postings"])
        ids, null = np.frombuffer(own["ids"], np.int64, len(lengths)), np.unpackbits(np.frombuffer(own["ids"], np.uint8, -1, 8 * len(lengths)), count=len(lengths))
        of_query = defaultdict(list)
        for r in rows:
            if r["ids"] is None:
                pairs = unpacked(r["postings"])
                docs, tf = np.cumsum(pairs[::2]), pairs[1::2]
                adds = impacts(r["weight"], tf, lengths[docs], n, terms)
                entry = memoryview(docs), memoryview(adds), int(adds.max())
                for q in r["queries"]:  # structs, as a list would lose a null id
                    of_query[q["query"]].append(entry)
        out = [(q, None if null[d] else int(ids[d]), s) for q, lists in of_query.items() for s, d in best_documents(lists, k)]
        return tuple(zip(*out, strict=True)) if out else ((), (), ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["block"]) != group:
                    if rows:
                        yield _results(*found(rows))
                    group, rows = (row["shard"], row["block"]), []
                rows.append(row)
        if rows:
            yield _results(*found(rows))

    return run


def _results(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "key", "score"])


def term_weight(df: Column, n: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * df + 1))).cast("long")


def search(index: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, key, score): the k best documents of each query with a score above 0. index: a written table of build_index();
    asked: of asked_terms()."""
    shards = index.where("ids IS NOT NULL")
    n, terms = shards.select("postings").mapInArrow(_lengths, "n long, terms long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).head()
    blocks_n = max(1, -(-asked.select("query").distinct().count() // QUERY_BLOCK))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks_n)))
    wanted = stored(blocks.groupBy("block", "first", "second").agg(F.collect_list(F.struct("query")).alias("queries")), "wanted")
    sent = (lambda df: F.broadcast(df)) if wanted.count() <= SENT_TERMS else lambda df: df
    term = ["first", "second"]
    held = index.where("ids IS NULL").join(sent(wanted.select(*term).distinct()), term, "left_semi")
    weights = stored(held.groupBy(*term).agg(term_weight(F.sum("df"), n).alias("weight")), "weights")
    weighted = wanted.join(weights, term)
    postings = index.where("ids IS NULL").select("shard", *term, "postings").join(sent(weighted), term).where("weight > 0")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_n - 1).cast("long"))).alias("block")
    of_shards = shards.select("shard", each, "postings", "ids")
    rows = postings.select("shard", "block", "postings", "weight", "queries", F.lit(None).cast("binary").alias("ids")).unionByName(of_shards.select("shard", "block", "postings", F.lit(0).cast("long").alias("weight"), F.array().cast("array<struct<query:long>>").alias("queries"), "ids"))
    # a group is small but takes long to search: their number, not their bytes, decides the number of tasks
    tasks = min(MAX_TASKS, max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards.count() * blocks_n))
    dealt = rows.repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block")
    found = dealt.mapInArrow(_searcher(n, max(terms, 1), k), "query long, key long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query, rank, key, score) of all documents for each query."""
    asked = stored(asked_terms(queries, query, query_text), "asked")
    found = search(stored(build_index(docs, key, text), "postings"), asked, k)
    return found.select(F.col("query").alias(query), "rank", F.col("key").alias(key), "score")


ship(__name__)
