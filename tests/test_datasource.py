"""Files as data sources: headers without content, filters on paths, partitions by bytes, and files that appear only on commit."""

import os
import struct

import numpy as np
import pytest
from pixelloom.sources import datasource as ds
from pixelloom.sources import formats as fm
from pyspark.sql import functions as F

HEAD = "path string, format string, width int, height int, channels int, has_alpha boolean, space string, dpi double, size_bytes long, bytes_read long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ds.register(spark)
    at = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(1)
    os.makedirs(at / "deep")
    for i in range(4):
        px = rng.integers(0, 256, (3 + i, 5, 4), dtype=np.uint8)
        (at / ("deep" if i % 2 else "") / f"p{i}.png").write_bytes(fm.png_file(px, 300 if i else None))
    (at / "odd.txt").write_bytes(b"no image")
    (at / "empty.png").write_bytes(b"")
    (at / "cut.png").write_bytes(fm.png_file(px)[:20])
    exif = b"\xff\xe1" + struct.pack(">H", 60_000) + b"x" * 59_998
    (at / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\1" + struct.pack(">HH", 72, 72) + b"\0\0" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 3) + b"rest")
    (at / "_hidden").write_bytes(b"x")
    return str(at)


def test_headers(spark, folder):
    found = spark.read.format("image_pixels").schema(HEAD).load(folder).collect()
    wanted = {r.path.removeprefix("file:"): tuple(r)[1:] for r in fm.image_info(fm.files(spark, f"{folder}/*").unionByName(fm.files(spark, f"{folder}/deep/*"))).collect()}
    assert {r.path: tuple(r)[1:9] for r in found if "empty" not in r.path} == {k: v for k, v in wanted.items() if "_hidden" not in k}
    assert {r.format for r in found} == {"png", "jpeg", None} and max(r.bytes_read for r in found) < 2048


def test_a_large_file_is_not_read_for_its_header(spark, tmp_path):
    ds.register(spark)
    chunk = lambda kind, n: struct.pack(">I", n) + kind + b"\0" * n + b"\0" * 4
    head = fm.png_file(np.zeros((1, 1, 4), np.uint8), 150)
    cut = head.index(b"IDAT") - 4
    with open(tmp_path / "big.png", "wb") as f:
        f.write(head[:cut] + chunk(b"iCCP", 400_000) + chunk(b"IDAT", 1000))
        f.truncate(100_000_000)
    with open(tmp_path / "big.emb", "wb") as f:
        f.write(fm.embedding_file({"k": 1, "dims": [25_000_000]}, magic=fm.MAGIC))
        f.truncate(100_000_000)
    (r,) = spark.read.format("image_pixels").schema(HEAD).load(str(tmp_path / "big.png")).collect()
    assert (r.width, round(r.dpi), r.size_bytes) == (1, 150, 100_000_000) and r.bytes_read < 2048
    (e,) = spark.read.format("embedding_tensors").schema("path string, header string, bytes_read long").load(f"file://{tmp_path}/big.emb").collect()
    assert '"k": 1' in e.header and e.bytes_read < 2048


def test_pixels(spark, folder):
    found = spark.read.format("image_pixels").load(folder).where(F.col("path").endswith("p3.png")).drop("bytes_read")
    wanted = fm.decoded(fm.files(spark, f"{folder}/deep/p3.png"))
    names = ["x", "y", "r", "g", "b", "a"]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, wanted.select(*names).collect()))
    assert found.select("width", "height").distinct().collect() == [(5, 6)]


def test_filters_leave_files_out(spark, folder):
    reader = ds.PixelReader(ds.T.StructType([]), {"path": folder})
    paths = lambda: [p for part in reader.partitions() for p, _ in part.paths]
    assert len(paths()) == 8
    left = list(reader.pushFilters([ds.StringEndsWith(("path",), ".png"), ds.EqualTo(("width",), 5), ds.StringStartsWith(("path",), f"{folder}/deep")]))
    assert left == [ds.EqualTo(("width",), 5)] and sorted(map(os.path.basename, paths())) == ["p1.png", "p3.png"]
    df = spark.read.format("image_pixels").schema(HEAD).load(folder)
    assert df.where(F.col("path") == f"{folder}/photo.jpg").count() == 1 and df.where(F.col("path").isin(f"{folder}/photo.jpg", "x")).count() == 1
    assert df.where(F.col("path") == "nothing").count() == 0 and df.where("width = 5 AND path LIKE '%p0.png'").count() == 1
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("image_pixels").load(f"{folder}/nowhere").count()


def test_partitions_by_bytes(folder, monkeypatch):
    sizes = lambda: [sum(n for _, n in p.paths) for p in ds.PixelReader(ds.T.StructType([]), {"path": folder}).partitions()]
    assert len(sizes()) == 1
    monkeypatch.setattr(ds, "PARTITION_BYTES", 300)
    parts = sizes()
    assert len(parts) > 3 and sum(n > 300 for n in parts) == 1  # the photo is a partition of its own


def test_tensors(spark, tmp_path):
    ds.register(spark)
    (tmp_path / "a").write_bytes(fm.embedding_file({"m": "x"}, np.arange(6, dtype="f4").reshape(2, 3), np.arange(4, dtype="f4").reshape(1, 4)))
    (tmp_path / "b").write_bytes(b"something else")
    found = sorted(spark.read.format("embedding_tensors").load(str(tmp_path)).collect(), key=lambda r: (r.path, r.tensor or 0))
    assert [(os.path.basename(r.path), r.tensor, r.dims, r.data) for r in found] == [("a", 0, [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), ("a", 1, [1, 4], [0.0, 1.0, 2.0, 3.0]), ("b", None, None, None)]


def test_files_appear_on_commit(spark, tmp_path):
    ds.register(spark)
    path = str(tmp_path / "out")
    px = spark.createDataFrame([(i, x, 0, i, x, 0, 255) for i in range(3) for x in range(4)], "image_id long, x int, y int, r int, g int, b int, a int")
    files = fm.encoded(px).select(F.concat(F.lit("set/"), "image_id", F.lit(".png")).alias("name"), "content")
    files.write.format("named_files").mode("append").save(path)
    back = spark.read.format("image_pixels").load(path).select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "x", "y", "r", "g", "b", "a")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
    bad = spark.createDataFrame([("fine.png", b"1"), ("../out.png", b"2")], "name string, content binary")
    for df in (bad, spark.createDataFrame([("same", b"1"), ("same", b"2")], "name string, content binary")):
        with pytest.raises(Exception, match="name"):
            df.write.format("named_files").mode("append").save(path)
    every = sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)
    assert every == ["set/0.png", "set/1.png", "set/2.png"] and not [d for d in os.listdir(path) if d.startswith("_writing")]
    spark.createDataFrame([("new", b"x")], "name string, content binary").write.format("named_files").mode("overwrite").save(path)
    assert [n for _, _, names in os.walk(path) for n in names] == ["new"]
