"""Suffix-array dedup: removes each byte that a long enough string covers which also starts in a document with a smaller id.

Equal strings of LENGTH bytes must meet in one shard, whatever their documents. Texts are dealt by id into groups of bounded
size (all rows that repeat one id share a group, so an id must not repeat without bound), and each group, bucket and shard exchanges packed arrays, not a row for each string:

1. Equal whole texts: all but the smallest id are covered throughout; only the first goes on.
2. Every window of LENGTH bytes is represented by its anchor, the smallest hash of its GRAM-byte substrings. Groups send their
   distinct anchors, dealt by hash into buckets; those that occur in one document only are ruled out there, as their
   windows can't repeat across documents.
3. Of the other anchors, each group sends the segments (maximal runs of windows with one anchor), equal ones once with their
   smallest document, dealt by anchor into shards. Anchors in HOT_DOCS or more documents, which may have any number of
   different segments, are dealt window by window instead.
4. Each shard merges equal segments of its groups. Of the different segments that share their anchor with another one, it
   builds the suffix array by induced sorting, and permuted common prefixes; neighbours in the order with LENGTH common
   bytes inside their segments are one string, whose smallest document is the smallest of its segments'. The groups get
   back the smallest document of each window that they sent.
5. Windows whose smallest document is smaller than their own are covered; covered bytes are cut from the text.

Cases: null text counts as empty; texts shorter than LENGTH bytes lose nothing. Matches never cross documents. Rows that repeat
an id, with the same text or others, don't cover each other; rows with a null id lose nothing and cover nothing. Ids are
integers. Texts are handled whole, one chunk of bounded size at a time (a longer text is a chunk of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed64, ship, stored
from .minhash import text_chunks
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 50, 24
CHUNK = 1 << 18
#: Bytes of text in a group, anchors dealt into a bucket, bytes of segments dealt into a shard.
GROUP_BYTES, BUCKET_ANCHORS, SHARD_BYTES = 4 << 20, 1 << 19, 3 << 20
HOT_DOCS = 1 << 14
BROADCAST_IDS = 1 << 20
SEPARATOR = np.uint8(255)  # never occurs in UTF-8


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each substring of `gram` bytes, by doubling the hashed length."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    power, width, total, done = factor, 1, None, 0
    level = data.astype(np.uint64) + np.uint64(1)
    while True:
        if gram & width:
            if total is None:
                total, done, scale = level, width, power
            else:
                m = len(data) - done - width + 1
                total = total[:m] * power + level[done : done + m]
                done += width
        if 2 * width > gram:
            return mixed64(total[: max(0, len(data) - gram + 1)])
        m = len(level) - width
        level = level[:m] * power + level[width:]
        power = np.multiply([power], [power])[0]
        width *= 2


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, anchor hash) of each maximal run of windows of a row with one anchor; a run ends where the next one
    starts or at the row's last window."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low = gram_hashes(data, gram)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    valid = np.zeros(len(low), bool)
    first, last = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    change = np.zeros(len(low) + 1, np.int64)
    some = last > first
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    valid = np.cumsum(change[:-1]) > 0
    starts = np.append(True, low[1:] != low[:-1])
    starts[first[some]] = True
    at = np.flatnonzero(starts & valid)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets))), at, low[at]


def anchor_codes(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of an anchor hash, in one number: a bucket holds so few anchors that these tell them apart."""
    return ((values >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (values & np.uint64(0xFFFFFFFF))


class Runs:
    """Runs of windows with one anchor, of the texts of one chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int) -> None:
        self.data, self.offsets = data, offsets
        self.row, self.at, values = window_anchors(data, offsets, LENGTH, GRAM)
        self.code = anchor_codes(values, buckets)
        last = offsets[self.row + 1] - LENGTH + 1
        self.end = np.minimum(np.append(self.at[1:], len(data)), last)  # one past the last window

    def only(self, chosen: np.ndarray) -> None:
        self.row, self.at, self.end, self.code = self.row[chosen], self.at[chosen], self.end[chosen], self.code[chosen]

    def split(self, hot: np.ndarray) -> None:
        """Runs of hot anchors become runs of one window, dealt by the whole window's hash."""
        many = np.isin(self.code, hot)
        if not many.any():
            return
        count = np.where(many, self.end - self.at, 1)
        order = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        each = many[order]
        at = self.at[order] + np.where(each, shift, 0)
        end = np.where(each, at + 1, self.end[order])
        code = self.code[order]
        code[each] = gram_hashes(self.data, LENGTH)[at[each]]
        self.row, self.at, self.end, self.code = self.row[order], at, end, code

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all runs, one behind the other, and their lengths."""
        size = self.end - self.at + LENGTH - 1
        starts = np.cumsum(size) - size
        return self.data[np.repeat(self.at - starts, size) + np.arange(int(size.sum()))], size


def string_hashes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(strings, 2) hashes of strings that stand one behind the other."""
    starts = np.cumsum(size) - size
    place = np.arange(len(data)) - np.repeat(starts, size)
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        powers = np.cumprod(np.full(int(size.max()), base, np.uint64))
        out.append(mixed64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts) + size.astype(np.uint64)))
    return np.stack(out, axis=1)


def firsts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: the first place of each distinct pair, and each one's number among them."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]).any(axis=1)) if len(order) else np.empty(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def _group_chunks(texts: pa.Table, buckets: int) -> Iterator[tuple[int, Runs]]:
    """(first row, runs) of each chunk of a group, in a fixed order."""
    column = texts.column("text").combine_chunks()
    for first, data, offsets in text_chunks(column, CHUNK):
        yield first, Runs(data, offsets, buckets)


def _fixed(texts: pa.Table) -> pa.Table:
    """A group's rows in an order that does not depend on how they came."""
    return texts.sort_by([("key", "ascending"), ("digest", "ascending")])


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _cut(codes: np.ndarray, shift: int) -> list[tuple[int, slice]]:
    """(part, slice) of sorted codes by their upper bits."""
    if not len(codes):
        return []
    part = codes >> np.uint64(shift)
    at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    return [(int(part[a]), slice(a, b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def send_anchors(texts: pa.Table, buckets: int) -> pa.Table:
    """Of one group: its distinct anchors, and in how many of its documents each is."""
    texts = _fixed(texts)
    keys = texts.column("key").to_numpy()
    codes, owners = [], []
    for first, runs in _group_chunks(texts, buckets):
        codes.append(runs.code)
        owners.append(keys[first + runs.row])
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]
    fresh = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)]
    code, docs = np.unique(code[fresh], return_counts=True)
    low, docs = code.astype(np.uint32), np.minimum(docs, 65_535).astype(np.uint16)
    group = texts.column("group")[0].as_py()
    rows = [(bucket, group, low[part].tobytes(), docs[part].tobytes()) for bucket, part in _cut(code, 32)]
    return _table([("bucket", pa.int32()), ("group", pa.int32()), ("codes", pa.binary()), ("docs", pa.binary())], rows)


def answer_anchors(sent: pa.Table) -> pa.Table:
    """Of one bucket: to each group, its anchors that occur in two documents or more, and those that occur in HOT_DOCS."""
    sent = sent.sort_by("group")
    parts = [np.frombuffer(x.as_py(), np.uint32) for x in sent.column("codes")]
    code, docs = np.concatenate(parts), np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in sent.column("docs")])
    _, number = np.unique(code, return_inverse=True)
    total = np.bincount(number, weights=docs)[number]
    wide = np.uint64(sent.column("bucket")[0].as_py()) << np.uint64(32) | code.astype(np.uint64)
    ends = np.cumsum([len(x) for x in parts])
    columns = []
    for chosen in (np.flatnonzero(total > 1), np.flatnonzero(total >= HOT_DOCS)):
        at, kept = np.searchsorted(chosen, np.append(0, ends)), wide[chosen]
        columns.append([kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
    rows = list(zip(sent.column("group").to_pylist(), *columns, strict=True))
    return _table([("group", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())], rows)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_py(), kind) for x in column)])


def group_segments(texts: pa.Table, answers: pa.Table, buckets: int) -> Iterator[tuple[int, Runs]]:
    """(first row, runs) of each chunk, only runs whose strings may repeat."""
    repeated, hot = np.sort(_joined(answers.column("repeated"), np.uint64)), _joined(answers.column("hot"), np.uint64)
    for first, runs in _group_chunks(texts, buckets):
        at = np.minimum(np.searchsorted(repeated, runs.code), max(0, len(repeated) - 1))
        runs.only(repeated[at] == runs.code if len(repeated) else np.zeros(len(runs.code), bool))
        runs.split(hot)
        if len(runs.code):
            yield first, runs


def distinct_segments(texts: pa.Table, answers: pa.Table, buckets: int, shards: int) -> dict[str, np.ndarray]:
    """One group's distinct segments by shard, their smallest keys, and for each run its segment."""
    keys = texts.column("key").to_numpy()
    found: dict[str, list] = {k: [] for k in ("data", "size", "shard", "mark", "hash", "owner", "at", "end", "row")}
    for first, runs in group_segments(texts, answers, buckets):
        data, size = runs.strings()
        code = mixed64(runs.code)
        shard, mark = (code % np.uint64(shards)).astype(np.int64), (code >> np.uint64(32)).astype(np.uint32)
        begun = runs.offsets[runs.row]
        for k, v in (("data", data), ("size", size), ("shard", shard), ("mark", mark), ("hash", string_hashes(data, size)), ("owner", keys[first + runs.row]), ("at", runs.at - begun), ("end", runs.end - begun), ("row", first + runs.row)):
            found[k].append(v)
    if not found["size"]:
        return {}
    every = {k: np.concatenate(v) for k, v in found.items()}
    first, number = firsts(every["hash"])
    smallest = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(smallest, number, every["owner"])
    order = np.lexsort((every["hash"][first, 0], every["shard"][first]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return every | {"first": first[order], "smallest": smallest[order], "number": rank[number]}


def send_segments(texts: pa.Table, answers: pa.Table, buckets: int, shards: int) -> pa.Table:
    schema = [("shard", pa.int32()), ("group", pa.int32()), ("data", pa.binary()), ("size", pa.binary()), ("mark", pa.binary()), ("smallest", pa.binary())]
    if not len(texts):
        return _table(schema, [])
    texts = _fixed(texts)
    d = distinct_segments(texts, answers, buckets, shards)
    if not d:
        return _table(schema, [])
    starts = (np.cumsum(d["size"]) - d["size"])[d["first"]]
    size, shard, mark, group = d["size"][d["first"]], d["shard"][d["first"]], d["mark"][d["first"]], texts.column("group")[0].as_py()
    ends = np.cumsum(size)
    data = np.empty(int(ends[-1]), np.uint8)
    blocks = np.append(0, np.searchsorted(ends, np.arange(CHUNK, ends[-1] + CHUNK, CHUNK), "right"))  # of about CHUNK bytes, in the order of shards
    for a, b in zip(blocks[:-1], np.append(blocks[1:-1], len(size)), strict=True):
        begun = ends[a:b] - size[a:b]
        if a < b:
            data[begun[0] : ends[b - 1]] = d["data"][np.repeat(starts[a:b] - begun, size[a:b]) + np.arange(begun[0], ends[b - 1])]
    at = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
    size, bounds = size.astype(np.uint32), np.append(0, ends)[at]
    rows = []
    for a, b, low, high in zip(at[:-1], at[1:], bounds[:-1], bounds[1:], strict=True):
        rows.append((int(shard[a]), group, data[low:high].tobytes(), size[a:b].tobytes(), mark[a:b].tobytes(), d["smallest"][a:b].tobytes()))
    return _table(schema, rows)


def equal_windows(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of distinct segments, in order: the smallest of `least` (of each segment) over all equal windows, by a suffix array."""
    laid = np.cumsum(size + 1) - (size + 1)  # a separator behind each segment
    text = np.full(int((size + 1).sum()), SEPARATOR, np.uint8)
    begun = np.cumsum(size) - size
    within = np.arange(len(data)) - np.repeat(begun, size)
    place = np.repeat(laid, size) + within
    text[place] = data
    room = np.zeros(len(text), np.int64)  # bytes up to the end of the segment
    room[place] = np.repeat(size, size) - within
    owner = np.repeat(least, size + 1)
    order = suffix_array(text)
    whole = order[room[order] >= LENGTH]  # strings with one beginning are neighbours, also without the others
    head = common_prefixes(text, whole, LENGTH)[whole] < LENGTH
    head[0] = True
    heads = np.flatnonzero(head)
    result = np.empty(len(text), np.int64)
    result[whole] = np.repeat(np.minimum.reduceat(owner[whole], heads), np.diff(np.append(heads, len(whole))))
    return result[room >= LENGTH]


def smallest_documents(data: np.ndarray, size: np.ndarray, smallest: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each window of each segment, in order: the smallest document of any equal window of the shard. mark: 32 bits of each segment's
    anchor. Equal windows have one anchor, so a segment that no other one shares its anchor with meets no other."""
    first, number = firsts(string_hashes(data, size))
    starts = np.cumsum(size) - size
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, smallest)
    length = size[first]
    _, anchor, often = np.unique(mark[first], return_inverse=True, return_counts=True)
    shared = often[anchor] > 1
    windows = length - LENGTH + 1
    result = np.repeat(least, windows)
    if shared.any():
        own = length[shared]
        text = data[np.repeat(starts[first][shared] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        result[np.repeat(shared, windows)] = equal_windows(text, own, least[shared])
    begun, windows = np.cumsum(windows) - windows, size - LENGTH + 1
    ends = np.cumsum(windows)
    return result[np.repeat(begun[number] - (ends - windows), windows) + np.arange(int(ends[-1]))]


def answer_segments(sent: pa.Table) -> pa.Table:
    """Of one shard: to each group, the smallest document of each window that it sent."""
    sent = sent.sort_by("group")
    sizes = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in sent.column("size")]
    found = smallest_documents(_joined(sent.column("data"), np.uint8), np.concatenate(sizes), _joined(sent.column("smallest"), np.int64), _joined(sent.column("mark"), np.uint32))
    ends = np.cumsum([int((s - LENGTH + 1).sum()) for s in sizes])
    shard = sent.column("shard")[0].as_py()
    rows = [(g, shard, part.tobytes()) for g, part in zip(sent.column("group").to_pylist(), np.split(found, ends[:-1]), strict=True)]
    return _table([("group", pa.int32()), ("shard", pa.int32()), ("found", pa.binary())], rows)


RESULT = [("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]


def cut_texts(texts: pa.Table, back: pa.Table, buckets: int, shards: int, with_text: bool) -> pa.Table:
    """Of one group: what stays of each text. back holds answers to anchors and to segments."""
    if not len(texts):
        return _table(RESULT, [])
    texts = _fixed(texts)
    answers = back.filter(pa.compute.is_valid(back.column("repeated")))
    found = back.filter(pa.compute.is_valid(back.column("found"))).sort_by("shard")
    d = distinct_segments(texts, answers, buckets, shards)
    covered: dict[int, list] = {}
    if d:
        windows = d["size"][d["first"]] - LENGTH + 1
        starts = np.cumsum(windows) - windows
        least = _joined(found.column("found"), np.int64)
        count = d["end"] - d["at"]
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        smaller = least[np.repeat(starts[d["number"]], count) + step] < np.repeat(d["owner"], count)
        row, at = np.repeat(d["row"], count)[smaller], (np.repeat(d["at"], count) + step)[smaller]
        cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
        for r, part in zip(row[np.concatenate([[0], cuts])] if len(row) else [], np.split(at, cuts), strict=False):
            covered.setdefault(int(r), []).append(part)
    rows = []
    for i, (key, text) in enumerate(zip(texts.column("key").to_pylist(), texts.column("text"), strict=True)):
        data = text.as_py()
        removed = spans = 0
        if i in covered:
            change = np.zeros(len(data) + 1, np.int64)
            starts = np.concatenate(covered[i])
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        else:
            left = data
        rows.append((key, len(data), removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
    return _table(RESULT, rows)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]) of every row. kept_text: what stays, as text; bytes of a
    character that is cut in two are replaced there."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("key"), content.alias("text"))
    sized = rows.select("key", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    sized = stored(sized, "digests")
    fit = sized.where(f"key IS NOT NULL AND n_bytes >= {LENGTH}")
    repeated = stored(fit.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select("digest", "first"), "repeated")
    copies = stored(fit.join(repeated, "digest").where("key > first").select("key", "digest", "n_bytes"), "copies")
    total = fit.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    groups, buckets, shards = 1 + total // GROUP_BYTES, 1 + total * 2 // (LENGTH - GRAM + 2) // BUCKET_ANCHORS, 1 + total // SHARD_BYTES

    # an id may also stand for other texts, which stay: the text goes by id and digest
    gone = copies.select("key", F.unhex("digest").alias("sha")).distinct()
    texts = rows.where((F.col("key").isNotNull()) & (F.octet_length("text") >= LENGTH)).withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = texts.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["key", "sha"], "left_anti")
    texts = texts.select(F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group"), "key", "text", F.crc32("text").alias("digest"))

    def anchors(t: pa.Table) -> pa.Table:
        return send_anchors(t, buckets)

    def segments(t: pa.Table, a: pa.Table) -> pa.Table:
        return send_segments(t, a, buckets, shards)

    def cut(t: pa.Table, b: pa.Table) -> pa.Table:
        return cut_texts(t, b, buckets, shards, with_text)

    sent = texts.groupBy("group").applyInArrow(anchors, "bucket int, group int, codes binary, docs binary")
    answers = stored(sent.groupBy("bucket").applyInArrow(answer_anchors, "group int, repeated binary, hot binary"), "anchors")
    strings = texts.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(segments, "shard int, group int, data binary, size binary, mark binary, smallest binary")
    found = strings.groupBy("shard").applyInArrow(answer_segments, "group int, shard int, found binary")
    nothing = F.lit(None).cast("binary")
    back = found.select("group", "shard", "found", nothing.alias("repeated"), nothing.alias("hot")).unionByName(
        answers.select("group", F.lit(None).cast("int").alias("shard"), nothing.alias("found"), "repeated", "hot")
    )
    result = texts.groupBy("group").cogroup(back.groupBy("group")).applyInArrow(cut, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")

    zero, hollow = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    copied = copies.select("key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), hollow.alias("kept_sha256"), F.lit("").alias("kept_text"))
    rest = rows.where(F.col("key").isNull() | (F.octet_length("text") < LENGTH))
    rest = rest.select("key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("string").alias("kept_text"))
    every = result.unionByName(copied).unionByName(rest).withColumnRenamed("key", key)
    return every if with_text else every.drop("kept_text")


ship(__name__)
