"""Queries that write their tables as files and read these again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import datasource as ds
from ..sources import fixtures as fx
from ..sources import formats as fm
from ..sources.formats import embedding_file
from .catalogue import TILES, col, query
from .shared import own_folder

AT = ["image_id", "x", "y"]


def _id() -> Column:
    """The number that is a file's name."""
    return F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("image_id")


def _image_files(spark: SparkSession, sf_dir: str) -> str:
    ds.register(spark)
    folder = own_folder(spark, "images")
    named = fm.encoded(fx.tiles(spark, sf_dir)).select(F.concat((col("image_id") % 16).cast("string"), F.lit("/"), "image_id", F.lit(".png")).alias("name"), "content")
    named.write.format("named_files").mode("append").save(folder)
    return folder


@query("IO1 IO3 IO4 IO5", f"WITH {TILES} SELECT * FROM px")
def file_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile as a PNG file, in folders, and back."""
    found = spark.read.format("image_pixels").load(_image_files(spark, sf_dir))
    return found.select(_id(), "x", "y", *"rgba")


@query("IO2 IO9", "SELECT vec_id AS image_id, 'png' AS format, 8 AS width, 8 AS height, 4 AS channels, true AS has_alpha, 'srgb' AS space, 300e0 AS dpi, true AS little FROM embeddings WHERE vec_id % 16 < 10")
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers alone, of the files whose path the filter lets through."""
    columns = "path string, format string, width int, height int, channels int, has_alpha boolean, space string, dpi double, bytes_read long"
    found = spark.read.format("image_pixels").schema(columns).load(_image_files(spark, sf_dir)).where(col("path").rlike("/[0-9]/[0-9]+[.]png$"))
    return found.select(_id(), "format", "width", "height", "channels", "has_alpha", "space", "dpi", (col("bytes_read") <= 2 * ds.STEP).alias("little"))


@query("IO8", "SELECT vec_id // 64 AS image_id, (vec_id % 64)::INT AS row, (k - 1)::INT AS k, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) t(k)")
def file_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in files of 64 rows, one tensor each, and back. Rows of a file are a run of ids from a multiple of 64 on."""
    ds.register(spark)
    folder = own_folder(spark, "tensors")
    rows = fx.table(spark, sf_dir, "embeddings").groupBy(F.floor(col("vec_id") / 64).alias("block")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))
    files = rows.select("block", F.transform("rows", lambda r: r["embedding"]).alias("rows"))

    def packed(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            content = [embedding_file({}, np.array([list(r) for r in rows], "f4")) for rows in b["rows"]]
            yield pd.DataFrame({"name": [f"{k}.emb" for k in b["block"]], "content": content})

    files.mapInPandas(packed, "name string, content binary").write.format("named_files").mode("append").save(folder)
    found = spark.read.format("embedding_tensors").load(folder)
    flat = found.select(_id(), F.posexplode("data").alias("at", "v"), F.element_at("dims", 2).alias("wide"))
    return flat.select("image_id", F.floor(col("at") / col("wide")).cast("int").alias("row"), (col("at") % col("wide")).alias("k"), col("v").cast("double").alias("v"))
