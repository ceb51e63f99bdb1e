"""Pairs and books as they arrive: a file source, and batches that are appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.pairs import not_yet
from vellum.sources.files import there


def json_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """New JSONL files of a folder, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def parquet_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def append_once(stream: DataFrame, out: str, key: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append each batch's rows whose key isn't in ``out`` yet, after ``step``.

    A batch that is run again finds its keys there and appends nothing, so a restart neither loses nor repeats a row; of
    rows in one batch that share a key one is kept.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = step(batch).dropDuplicates([key])
        if there(spark, out):
            rows = not_yet(rows, spark.read.schema(rows.schema).parquet(out), key)
        rows.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str, by: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by window of arrival and ``by``; rows later than ``late`` are left out once their window is closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("window"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
