"""Where results go: tables, event lines and texts. Folders are made as needed; each task writes its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .formats import event_lines


def write_output(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """df as files of a kind that Spark writes, in folders by the columns of `by`."""
    df.write.format(kind).mode(mode).partitionBy(*by).save(path)


def event_sink(events: DataFrame, path: str, state: str, once: bool = False) -> StreamingQuery:
    """JSON lines of a stream of events (with a column type): errors into path/err, all others into path/out. state: the checkpoint folder.
    Each trigger has folders of its own, which a repeated trigger writes anew, so no line is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        error = F.col("type") == "error"
        for name, part in (("err", batch.where(error)), ("out", batch.where(~error))):
            event_lines(part).write.mode("overwrite").text(f"{path}/{name}/trigger={number}")

    stream = events.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (stream.trigger(availableNow=True) if once else stream).start()


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each text file, such as an SVG drawing, as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder for each name, with its text and a line end."""
    df.select(name, text).write.mode("overwrite").partitionBy(name).text(path)
