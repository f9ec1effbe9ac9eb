"""Streaming ingest of recognised pages: files land, are measured line by line, and replace their page's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkframe.operators.quality import as_lines, line_measures


def read_pages(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def measured(pages: DataFrame, text: str = "text") -> DataFrame:
    """Stateless: every line with its measures."""
    return line_measures(as_lines(pages, text))


def upsert_to(pages: DataFrame, folder: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each batch overwrites the partitions of the keys it holds; the checkpoint is what a rerun goes on from."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: tumbling counts by key, with a watermark for late rows; works on batches and streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
