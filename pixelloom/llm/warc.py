"""WARC archives of pages, with a two-level capture index.

Writing: each task streams its rows into archives of its own in the shared folder, a gzip member for each record, and puts out
where each record lies. Of equal payloads (of at least `least` bytes) the row with the largest id is the response, the others
are revisit records without a payload. Equal payloads are found on ids and digests, behind a counting Bloom filter; payloads stay where
they are, unless there are too many groups to be broadcast (then those of possible groups shuffle once).

Index: captures are range-sorted by (URL key with the host reversed, id) into index files. A file is a run of compressed
blocks of BLOCK_LINES lines, and behind them its directory, the first entry of each block with its byte range; the first entries
of the files, one row a task or FILE_BLOCKS blocks, are all that tasks are sent. A lookup searches files, then directory, then
block by halving, and reads only the block that it needs; lookups are range-sorted too, so that a block is read once. A
key with many captures is looked up in slices, each taking its share of the blocks.

Reading: locations are range-sorted by archive and offset, neighbouring records come in one range read, and each is checked against
its block digest. A revisit's size and digest come from the response that it refers to.

Cases: a null html is an empty payload, a null url or one without :// has an empty host and no target header; control
characters of a url are escaped. A null id is smaller than any other; if all ids of a group are null, or rows repeat its
largest id, each of these rows is a response. Rows that repeat url and id are records each. Files of attempts that failed are never
looked at. Tables may be empty. Archives and index need a shared folder that pyarrow reads and writes (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stored
from .exact_dedup import repeated_groups, split_by_groups
from .url_filter import url_host
from ..plans.shared import shared_folder

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 2048
FILE_BLOCKS = 4096
#: Captures of one key and id that a lookup takes; more are looked up in slices.
SLICE = 1 << 14
READ_BYTES, TASK_BYTES = 1 << 20, 1 << 28
DATE = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Host labels from the top down, a closing bracket, path and query; control characters and blanks as _."""
    host = F.array_join(F.reverse(F.split(url_host(url), r"\.")), ",")
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    return F.regexp_replace(F.concat(host, F.lit(")"), rest), r"[\x00-\x20\x7F]", "_")


def id_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("-"))


def digest_text(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    found, path = fs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def _own_name(kind: str) -> str:
    """A file name that no other task or attempt has."""
    return f"{kind}-{TaskContext.get().partitionId():06d}-{uuid4().hex}"


def warc_record(name: str, url: str | None, payload: bytes | None, digest: str, refers: str | None = None, date: str = DATE) -> bytes:
    """A response record of an HTTP message with this payload, or a revisit record where that is None; as a gzip member."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head.encode() + (b"\r\n" if payload is None else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:row:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_text(block)}", "Content-Type: application/http; msgtype=response"]
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:row:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


_CONTROL = re.compile(r"[\x00-\x20\x7F]")


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; ValueError if it is damaged."""
    try:
        raw = zlib.decompress(data, 31)
    except zlib.error as e:
        raise ValueError(f"not a gzip member: {e}") from e
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(headers.get("content-length", -1))
    block = rest[: max(length, 0)]
    if not found or not first.startswith("WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if headers.get("warc-block-digest") != f"sha1:{digest_text(block)}":
        raise ValueError(f"{headers.get('warc-record-id')}: block digest differs")
    return headers, block.partition(b"\r\n\r\n")[2]


def judged_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(id, url, payload, sha1, refers) of every page: payload is null in revisits, refers null in responses."""
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), text.cast("binary").alias("payload"), F.unhex(F.sha2(text, 256)).alias("digest"))
    light = rows.where(F.octet_length("payload") >= least).select(F.col("id").alias("key"), "digest")
    _, groups = repeated_groups(stored(light, "digests"))
    alone, grouped = split_by_groups(rows, "digest", groups, "group")
    none, first = F.lit(None), F.col("id").eqNullSafe(F.col("group.keep"))
    kind, sha = pages.schema[key].dataType, F.sha1("payload").alias("sha1")
    again = grouped.select("id", "url", F.when(first, F.col("payload")).alias("payload"), sha, F.when(~first, F.col("group.keep")).alias("refers"))
    return alone.select("id", "url", "payload", sha, none.cast(kind).alias("refers")).unionByName(again)


def write_archives(judged: DataFrame, folder: str) -> DataFrame:
    """Writes the records; (key, id, file, offset, length) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for key, ident, url, payload, sha, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{_own_name('pages')}.warc.gz", 0
                        out = where.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                    record = warc_record(ident.as_py(), url.as_py(), payload.as_py(), digest, refers.as_py())
                    out.write(record)
                    found.append((key.as_py(), ident.as_py(), name, at, len(record)))
                    at += len(record)
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CAPTURE, strict=True)], names=["key", "id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = judged.select(url_key(F.col("url")).alias("key"), id_text(F.col("id")).alias("id"), "url", "payload", "sha1", F.col("refers").cast("string").alias("refers"))
    return rows.mapInArrow(run, "key string, id string, file string, offset long, length long")


_CAPTURE = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
Entry = tuple[bytes, bytes]


class CaptureIndex:
    """Index files in a folder: the first entry of each, and where its directory lies. Methods run in tasks."""

    def __init__(self, folder: str, files: list[tuple[str, bytes, bytes, int, int]]) -> None:
        self.folder = folder
        self.files = sorted(files, key=lambda f: f[1:3])
        self.firsts: list[Entry] = [f[1:3] for f in self.files]

    def open(self) -> IndexReader:
        return IndexReader(self)


class IndexReader:
    """Looks up entries; the directory and the block read last are kept."""

    def __init__(self, index: CaptureIndex) -> None:
        self.index, (self.where, self.base) = index, _folder(index.folder)
        self.directory: tuple[str, list[Entry], list[tuple[int, int]]] = ("", [], [])
        self.block: tuple[str, int, list[Entry], list[bytes]] = ("", -1, [], [])
        self.stream = None
        self.reads = 0

    def _read(self, name: str, offset: int, length: int) -> bytes:
        self.reads += 1
        if self.stream is None or self.stream[0] != name:
            if self.stream:
                self.stream[1].close()
            self.stream = name, self.where.open_input_file(f"{self.base}/{name}")
        self.stream[1].seek(offset)
        return zlib.decompress(self.stream[1].read(length))

    def _directory(self, number: int) -> tuple[str, list[Entry], list[tuple[int, int]]]:
        name, _, _, offset, length = self.index.files[number]
        if self.directory[0] != name:
            rows = [line.split(b"\t") for line in self._read(name, offset, length).split(b"\n")]
            self.directory = name, [(r[0], r[1]) for r in rows], [(int(r[2]), int(r[3])) for r in rows]
        return self.directory

    def _block(self, name: str, offset: int, length: int) -> tuple[list[Entry], list[bytes]]:
        if self.block[:2] != (name, offset):
            lines = self._read(name, offset, length).split(b"\n")
            self.block = name, offset, [tuple(x.split(b"\t", 2)[:2]) for x in lines], lines
        return self.block[2:]

    def find(self, entry: Entry, part: int = 0, parts: int = 1) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the captures of an entry: of those blocks that hold some, each parts-th from `part` on."""
        seen = 0
        for number in _span(self.index.firsts, entry):
            name, firsts, places = self._directory(number)
            for b in _span(firsts, entry):
                seen += 1
                if (seen - 1) % parts != part:
                    continue
                entries, lines = self._block(name, *places[b])
                for line in lines[bisect_left(entries, entry) : bisect_right(entries, entry)]:
                    _, _, file, offset, length = line.split(b"\t")
                    yield file.decode(), int(offset), int(length)


def _span(firsts: list[Entry], entry: Entry) -> range:
    """Numbers of the sorted pieces, given by their first entries, that may hold an entry."""
    return range(max(0, bisect_left(firsts, entry) - 1), bisect_right(firsts, entry))


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _folder(folder)
        out, name, at, lines, directory, done = None, "", 0, [], [], []

        def end_block() -> None:
            nonlocal at
            packed = zlib.compress(b"\n".join(lines))
            first = lines[0].split(b"\t", 2)
            directory.append(b"\t".join((first[0], first[1], str(at).encode(), str(len(packed)).encode())))
            out.write(packed)
            at += len(packed)
            lines.clear()

        def end_file() -> None:
            if lines:
                end_block()
            packed = zlib.compress(b"\n".join(directory))
            out.write(packed)
            out.close()
            first = directory[0].split(b"\t", 2)
            done.append((name, first[0], first[1], at, len(packed)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at, directory = _own_name("index"), 0, []
                    out = where.open_output_stream(f"{base}/{name}", compression=None)
                lines.append("\t".join(map(str, row)).encode())
                if len(lines) == BLOCK_LINES:
                    end_block()
                    if len(directory) == FILE_BLOCKS:
                        end_file()
                        out = None
        if out is not None:
            end_file()
        kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        columns = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "key", "id", "offset", "length"])

    return run


def capture_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Writes the index of captures (key, id, file, offset, length); what comes back has a row for each index file."""
    order = ("key", "id", "file", "offset")
    rows = captures.select(*order, "length").repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    files = stored(rows.mapInArrow(_write_index(folder), "name string, key binary, id binary, offset long, length long"), "index")
    return CaptureIndex(folder, [(r.name, bytes(r.key), bytes(r.id), r.offset, r.length) for r in files.collect()])


def look_up(wanted: DataFrame, index: CaptureIndex) -> DataFrame:
    """(file, offset, length) of all captures of the wanted (key, id), each once, however often these are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = index.open()
        for batch in batches:
            found = []
            for key, ident, part, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found += reader.find((key.encode(), ident.encode()), part, parts)
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CAPTURE[2:], strict=True)], names=["file", "offset", "length"])

    counted = wanted.groupBy("key", "id").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("parts"))
    sliced = counted.select("key", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    ordered = sliced.repartitionByRange("key", "id", "part").sortWithinPartitions("key", "id", "part")
    return ordered.mapInArrow(run, "file string, offset long, length long")


def read_archives(places: DataFrame, folder: str, size: int) -> DataFrame:
    """(id, bytes, digest, kind, refers) of the records at (file, offset, length); a revisit has no bytes of its own. size: bytes of
    all archives; a task reads some TASK_BYTES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _folder(folder)
        name, stream, begun, window = "", None, 0, b""
        for batch in batches:
            found = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    name, stream, window = file, where.open_input_file(f"{base}/{file}"), b""
                if not begun <= offset or offset + length > begun + len(window):
                    stream.seek(offset)
                    begun, window = offset, stream.read(max(length, READ_BYTES))
                headers, payload = read_record(window[offset - begun : offset - begun + length])
                kind, refers = headers["warc-type"], headers.get("warc-refers-to")
                own = None if kind == "revisit" else len(payload)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if own is not None and digest != digest_text(payload):
                    raise ValueError(f"{headers['warc-record-id']}: payload digest differs")
                found.append((_row(headers["warc-record-id"]), own, digest, kind, refers and _row(refers)))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "bytes", "digest", "kind", "refers"])

    tasks = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    ordered = places.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "id string, bytes long, digest string, kind string, refers string")


def _row(urn: str) -> str:
    return urn.removeprefix("<urn:row:").removesuffix(">")


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the tables that cut lineage; it goes when the JVM ends."""
    uri = f"{shared_folder(spark)}/warc-{uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return str(store.makeQualified(path).toString()).replace("file:/", "file:///", 1) if str(path.toUri().getScheme()) in ("None", "file") else uri


def archived_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes every page, indexes the archives and reads each page back through the index:
    (key, payload_bytes, payload_digest, record_type, refers_to)."""
    folder = archive_folder(pages.sparkSession)
    captures = stored(write_archives(judged_pages(pages, key, url, html, least), folder), "captures")
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    index = capture_index(captures, folder)
    wanted = pages.select(url_key(F.col(url)).alias("key"), id_text(F.col(key)).alias("id"))
    records = stored(read_archives(stored(look_up(wanted, index), "places"), folder, size), "records")
    responses, kind = records.where("kind = 'response'"), pages.schema[key].dataType
    known = responses.select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), F.col("bytes").alias("full")).distinct()
    revisits = records.where("kind = 'revisit'").join(known, (F.col("refers") == F.col("of")) & (F.col("digest") == F.col("of_digest")))
    found = responses.unionByName(revisits.select("id", F.col("full").alias("bytes"), "digest", "kind", "refers"))
    number = F.when(F.col("id") != "-", F.col("id")).cast(kind)
    return found.select(number.alias(key), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))


ship(__name__)
