"""Files as tables: image headers and pixels, embedding files, event lines. Files come from Spark's binaryFile and text sources,
so they may be in any store that Spark reads; each file is parsed alone in the task that reads it."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
INFO_SCHEMA = "format string, width int, height int, channels int, has_alpha boolean, space string, dpi double, size_bytes long"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content); a missing path is an error when the table is made."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _png_info(data: bytes) -> tuple:
    head = dict(takewhile(lambda c: c[0] != b"IDAT", _chunks(data)))
    width, height, _, kind = struct.unpack_from(">IIBB", head[b"IHDR"])
    dpi = None
    if b"pHYs" in head and head[b"pHYs"][8] == 1:
        dpi = round(struct.unpack_from(">I", head[b"pHYs"])[0] * 0.0254, 2) or None
    alpha = kind in (4, 6) or b"tRNS" in head
    return "png", width, height, PNG_CHANNELS[kind], alpha, "b-w" if kind in (0, 4) else "srgb", dpi


def _jpeg_info(data: bytes) -> tuple:
    at, dpi = 2, None
    while at + 4 <= len(data):
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xE0 and data[at + 4 : at + 9] == b"JFIF\0":
            unit, density = data[at + 11], struct.unpack_from(">H", data, at + 12)[0]
            dpi = (density * (2.54 if unit == 2 else 1.0) if unit else 0) or None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, channels = struct.unpack_from(">HHB", data, at + 5)
            return "jpeg", width, height, channels, False, {1: "b-w", 3: "srgb", 4: "cmyk"}.get(channels), dpi
        at += 2 + size
    raise ValueError("no frame header")


def image_info(found: DataFrame) -> DataFrame:
    """(path, columns of INFO_SCHEMA) of image files; null where the format is unknown or the header is damaged."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                try:
                    info = _png_info(data) if data[:8] == PNG else _jpeg_info(data) if data[:2] == b"\xff\xd8" else (None,) * 7
                except (ValueError, KeyError, struct.error):
                    info = (None,) * 7
                rows.append((path, *info, len(data)))
            yield pd.DataFrame(rows, columns=["path", *(x.split()[0] for x in INFO_SCHEMA.split(", "))])

    return found.mapInPandas(read, f"path string, {INFO_SCHEMA}")


def png_pixels(data: bytes) -> np.ndarray:
    """RGBA rows of an 8-bit PNG that is not interlaced."""
    parts = list(_chunks(data))
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", dict(parts)[b"IHDR"])
    if depth != 8 or interlaced:
        raise ValueError("only plain 8-bit files")
    n = PNG_CHANNELS[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        line, up = raw[y, 1:].astype(np.int32), (out[y - 1] if y else np.zeros(width * n, np.uint8)).astype(np.int32)
        if raw[y, 0] == 2:
            line = line + up
        elif raw[y, 0] == 1:
            line = np.cumsum(line.reshape(width, n), axis=0).reshape(-1)
        elif raw[y, 0] in (3, 4):
            done = [0] * (width * n)
            for i in range(width * n):
                a, b, c = (done[i - n] if i >= n else 0), int(up[i]), (int(up[i - n]) if i >= n else 0)
                if raw[y, 0] == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                done[i] = (int(line[i]) + guess) & 255
            line = np.array(done)
        out[y] = line & 255
    px = out.reshape(height, width, n)
    if kind == 3:
        colors = np.frombuffer(dict(parts)[b"PLTE"], np.uint8).reshape(-1, 3)
        clear = np.frombuffer(dict(parts).get(b"tRNS", b""), np.uint8)
        alpha = np.concatenate([clear, np.full(len(colors) - len(clear), 255, np.uint8)])
        return np.dstack([colors[px[..., 0]], alpha[px[..., 0]]])
    color = px[..., :1].repeat(3, axis=2) if n < 3 else px[..., :3]
    return np.dstack([color, px[..., -1] if n in (2, 4) else np.full((height, width), 255, np.uint8)])


def png_file(px: np.ndarray, dpi: float | None = None) -> bytes:
    """A PNG of RGBA rows, with its density."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = px.shape
    rows = np.zeros((height, 1 + width * 4), np.uint8)
    rows[:, 1:] = px.reshape(height, -1)
    density = b"" if dpi is None else chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + density + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: Rows, about, that files are read and images written in at a time.
BATCH = 1 << 16


def decoded(found: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b, a) of PNG files, a row for each pixel. Small files share a batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, parts, rows = [], [], 0

        def table() -> pd.DataFrame:
            flat = np.concatenate(parts)
            names = np.repeat(np.array(paths, object), [len(p) for p in parts])
            return pd.DataFrame({"path": names, **{c: flat[:, i] for i, c in enumerate("xyrgba")}})

        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                px = png_pixels(data)
                y, x = np.mgrid[0 : px.shape[0], 0 : px.shape[1]].astype(np.int32)
                paths.append(path)
                parts.append(np.column_stack([x.ravel(), y.ravel(), px.reshape(-1, 4).astype(np.int32)]))
                rows += len(parts[-1])
                if rows >= BATCH:
                    yield table()
                    paths, parts, rows = [], [], 0
        if parts:
            yield table()

    return found.mapInPandas(read, "path string, x int, y int, r int, g int, b int, a int")


def encoded(px: DataFrame, dpi: float | None = 300.0) -> DataFrame:
    """(image_id, content): each image as a PNG; missing pixels are clear. Images of a partition follow each other, and a task holds one."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, files, rows, last, held = [], [], 0, None, []

        def add() -> int:
            x, y, *colors = np.concatenate(held, axis=1)
            grid = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
            grid[y, x] = np.column_stack(colors)
            ids.append(last)
            files.append(png_file(grid, dpi))
            return len(x)

        for b in batches:
            keys = b["image_id"].to_numpy()
            values = np.stack([b[c].to_numpy() for c in "xyrgba"])
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if held and keys[begin] != last:
                    rows += add()
                    held = []
                    if rows >= BATCH:
                        yield pd.DataFrame({"image_id": ids, "content": files})
                        ids, files, rows = [], [], 0
                last = int(keys[begin])
                held.append(values[:, begin:end])
        if held:
            add()
        if ids:
            yield pd.DataFrame({"image_id": ids, "content": files})

    return px.select("image_id", *"xyrgba").repartition("image_id").sortWithinPartitions("image_id").mapInPandas(write, "image_id long, content binary")


# --- embedding files: a magic word, the header's length, a JSON header, one or two float tensors -------------------------

#: The magic word, and the names of the tensors' dimensions in the header.
MAGIC = b"SAMEMB1\n"
DIMENSIONS = ("dims", "posDims")


def embedding_file(meta: dict, *tensors: np.ndarray, magic: bytes = MAGIC) -> bytes:
    head = json.dumps(meta | {n: list(t.shape) for n, t in zip(DIMENSIONS, tensors, strict=False)}).encode()
    return magic + struct.pack("<I", len(head)) + head + b"".join(t.astype("<f4").tobytes() for t in tensors)


def embedding_headers(found: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """(path, header): JSON headers only; of the files no more than their headers is parsed. Files of another kind are null."""
    byte = lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("int")
    length = sum((byte(len(magic) + 1 + i) * 256**i for i in range(1, 4)), byte(len(magic) + 1))
    header = F.decode(F.substring(F.col("content"), F.lit(len(magic) + 5), length), "UTF-8")
    return found.select("path", F.when(F.substring("content", 1, len(magic)) == F.lit(magic), header).alias("header"))


def embedding_headers_of(spark: SparkSession, path: str, magic: bytes = MAGIC, first: int = 1024) -> DataFrame:
    """(path, header) of the embedding files at a path. Spark lists the files without their content; each task then reads the first
    bytes of its files, and more only where a header is longer. For stores that pyarrow reads too."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b["path"]:
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    data, start = f.read(first), len(magic) + 4
                    header = None
                    if data[: len(magic)] == magic and len(data) >= start:
                        n = struct.unpack_from("<I", data, len(magic))[0]
                        data += f.read(max(0, start + n - len(data)))
                        header = data[start : start + n].decode()
                rows.append((name, header))
            yield pd.DataFrame(rows, columns=["path", "header"])

    names = spark.read.format("binaryFile").load(path).select("path")
    return names.mapInPandas(read, "path string, header string")


def embeddings(found: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """(path, tensor, dims, data): the tensors of embedding files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                if data[: len(magic)] != magic:
                    raise ValueError(f"{path} is no embedding file")
                n = struct.unpack_from("<I", data, len(magic))[0]
                at = len(magic) + 4 + n
                header = json.loads(data[at - n : at])
                for i, dims in enumerate(header[d] for d in DIMENSIONS if header.get(d)):
                    count = int(np.prod(dims))
                    rows.append((path, i, dims, np.frombuffer(data, "<f4", count, at)))
                    at += 4 * count
            yield pd.DataFrame(rows, columns=["path", "tensor", "dims", "data"])

    return found.mapInPandas(read, "path string, tensor int, dims array<int>, data array<float>")


# --- event lines ---------------------------------------------------------------------------------------------------------

EVENT_SCHEMA = "type string, stage string, progress double, message string, code string"


def parsed_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Fields of JSON event lines; lines that are none are dropped."""
    event: Column = F.from_json(line, EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    return lines.withColumn("_e", event).where("_e.type IN ('progress', 'result', 'error')").select("*", "_e.*").drop("_e")


def event_lines(events: DataFrame) -> DataFrame:
    """One JSON line for each event; empty fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
