"""Image and embedding files as data sources of Spark: spark.read.format("image_pixels") and ("embedding_tensors"), and a sink of files,
df.write.format("named_files").

Files are listed once, on the driver, and dealt into partitions of about PARTITION_BYTES (a larger file is one of its own). Filters on
the path leave files out before any is opened. Of a file, no more is read than the wanted columns need: where these are all of the
header, the reader skips from one part of the file's header to the next and never comes to its content. Name the wanted columns by
.schema(...), as a source in Python is not told what a query selects. For stores that pyarrow reads (file, hdfs, s3, gs).

The sink writes each row's content under a name of its own attempt, and moves the files to their names when all tasks are through; of a job
that fails, nothing stays."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..plans.shared import ship
from . import formats
from .formats import DIMENSIONS, INFO_SCHEMA, MAGIC, PNG, PNG_CHANNELS, png_pixels

PARTITION_BYTES = 64 << 20
#: Bytes that are fetched at once while a header is read.
STEP = 512


class Prefix:
    """Bytes of a file by place, fetched as they are asked for; fetched: how many so far."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.size, self.fetched = stream, size, 0
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer only at the file's end."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.stream.seek(at)
            self.at, self.held = at, self.stream.read(min(max(n, STEP), max(0, self.size - at)))
            self.fetched += len(self.held)
        return self.held[at - self.at : at - self.at + n]


def png_header(f: Prefix) -> tuple:
    """(format, width, height, channels, has_alpha, space, dpi), from what stands before the pixels."""
    width, height, _, kind = struct.unpack(">IIBB", f.read(16, 10))
    dpi, alpha, at = None, kind in (4, 6), 8
    while at + 8 <= f.size:
        size, name = struct.unpack(">I4s", f.read(at, 8))
        if name == b"IDAT":
            break
        if name == b"pHYs" and size == 9:
            x, _, unit = struct.unpack(">IIB", f.read(at + 8, 9))
            dpi = (round(x * 0.0254, 2) or None) if unit == 1 else None
        alpha = alpha or name == b"tRNS"
        at += 12 + size
    return "png", width, height, PNG_CHANNELS[kind], alpha, "b-w" if kind in (0, 4) else "srgb", dpi


def jpeg_header(f: Prefix) -> tuple:
    at, dpi = 2, None
    while at + 4 <= f.size:
        _, mark, size = struct.unpack(">BBH", f.read(at, 4))
        if mark == 0xE0 and f.read(at + 4, 5) == b"JFIF\0":
            unit, density = struct.unpack(">BH", f.read(at + 11, 3))
            dpi = {1: float(density), 2: density * 2.54}.get(unit) or None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack(">HHB", f.read(at + 5, 5))
            return "jpeg", width, height, channels, False, {1: "b-w", 3: "srgb", 4: "cmyk"}.get(channels), dpi
        at += 2 + size
    raise ValueError("no frame header")


def image_header(f: Prefix) -> tuple:
    """As png_header; all null where the format is unknown or the header damaged."""
    try:
        start = f.read(0, 8)
        return png_header(f) if start == PNG else jpeg_header(f) if start[:2] == b"\xff\xd8" else (None,) * 7
    except (ValueError, KeyError, struct.error):
        return (None,) * 7


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class FileReader(DataSourceReader):
    """Lists files, leaves out those whose path can't match, deals the others, and reads rows of the wanted columns."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields]
        self.root, self.filters = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, In):
                return path in f.value
            return path == f.value if isinstance(f, EqualTo) else path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)

        return all(map(holds, self.filters))

    def partitions(self) -> Sequence[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.root)
        about = store.get_file_info(base)
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and self._wanted(f.path))
        parts, size = [], PARTITION_BYTES
        for path, n in names:
            if size + n > PARTITION_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append((path, n))
            size += n
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.root)
        for path, size in partition.paths:
            with store.open_input_file(path) as stream:
                for row in self.rows(path, Prefix(stream, size)):
                    yield tuple(row[c] for c in self.columns)

    def rows(self, path: str, f: Prefix) -> Iterator[dict]:
        raise NotImplementedError


class PixelReader(FileReader):
    def rows(self, path: str, f: Prefix) -> Iterator[dict]:
        names = [c.split()[0] for c in INFO_SCHEMA.split(", ")]
        about = {"path": path} | dict(zip(names, (*image_header(f), f.size), strict=True))
        if not set(self.columns) & set("xyrgba"):
            yield about | {"bytes_read": f.fetched}
            return
        px = png_pixels(f.read(0, f.size))
        about["bytes_read"] = f.fetched
        for y, line in enumerate(px.tolist()):
            for x, (r, g, b, a) in enumerate(line):
                yield about | {"x": x, "y": y, "r": r, "g": g, "b": b, "a": a}


class TensorReader(FileReader):
    def rows(self, path: str, f: Prefix) -> Iterator[dict]:
        start = len(MAGIC) + 4
        if f.read(0, len(MAGIC)) != MAGIC:
            yield dict.fromkeys(("header", "tensor", "dims", "data")) | {"path": path, "size_bytes": f.size, "bytes_read": f.fetched}
            return
        (n,) = struct.unpack("<I", f.read(len(MAGIC), 4))
        header = f.read(start, n).decode()
        about = {"path": path, "size_bytes": f.size, "header": header, "bytes_read": f.fetched}
        if not set(self.columns) & {"tensor", "dims", "data"}:
            yield about
            return
        at = start + n
        for i, dims in enumerate(d for d in map(json.loads(header).get, DIMENSIONS) if d):
            count = int(np.prod(dims))
            data = np.frombuffer(f.read(at, 4 * count), "<f4").tolist() if "data" in self.columns else None
            yield about | {"tensor": i, "dims": dims, "data": data, "bytes_read": f.fetched}
            at += 4 * count


class ImagePixels(DataSource):
    """A row for each pixel of PNG files (8 bits, not interlaced), or with header columns only one for each PNG or JPEG file."""

    @classmethod
    def name(cls) -> str:
        return "image_pixels"

    def schema(self) -> str:
        return f"path string, {INFO_SCHEMA}, x int, y int, r int, g int, b int, a int"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PixelReader(schema, self.options)


class EmbeddingTensors(DataSource):
    """A row for each tensor of embedding files, or with header columns only one for each file; null where a file is of another kind."""

    @classmethod
    def name(cls) -> str:
        return "embedding_tensors"

    def schema(self) -> str:
        return "path string, size_bytes long, header string, tensor int, dims array<int>, data array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TensorReader(schema, self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and its name


class FileWriter(DataSourceWriter):
    """Rows (name, content) as files. Tasks write into a folder of the job; commit moves the files of the attempts that count."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, f"_writing-{uuid4().hex}"

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.root)
        folder, done = f"{base}/{self.job}/{uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for i, row in enumerate(rows):
            if not row["name"] or row["name"].startswith("/") or ".." in row["name"].split("/"):
                raise ValueError(f"{row['name']!r} is no name for a file")
            with store.open_output_stream(f"{folder}/{i}", compression=None) as out:
                out.write(bytes(row["content"] or b""))
            done.append((f"{folder}/{i}", row["name"]))
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                if old.type == fs.FileType.File and f"/{self.job}/" not in old.path:
                    store.delete_file(old.path)
        for at, name in files:
            if "/" in name:
                store.create_dir(f"{base}/{name.rpartition('/')[0]}", recursive=True)
            store.move(at, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.root)
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class NamedFiles(DataSource):
    """A sink of rows (name, content): one file for each, in folders where a name holds slashes."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ImagePixels, EmbeddingTensors, NamedFiles):
        spark.dataSource.register(source)


ship(formats.__name__)
ship(__name__)
