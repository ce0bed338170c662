"""Extraction over streams of pages: the batch kernel as it is, as it keeps no state between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators.extract import Options, extract_articles

PAGE_SCHEMA = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Pages of a folder of Parquet files, as files arrive."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def article_stream(pages: DataFrame, opts: Options | None = None) -> DataFrame:
    return extract_articles(pages, opts)


def first_of_each_address(pages: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Pages without repeats of an address within the delay; state older than the watermark is dropped."""
    marked = pages.withColumn("address", C.remove_anchor(F.col("url"))).withWatermark(time, delay)
    return marked.dropDuplicatesWithinWatermark(["address"]).drop("address")


def write_stream(articles: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append articles as Parquet; the checkpoint makes a restart go on where it stopped."""
    writer = articles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
