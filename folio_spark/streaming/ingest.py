"""Structured Streaming over the same operators: pages are stateless, counters aggregate, redelivered documents fall out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio_spark.functions import classify as C
from folio_spark.operators.signals import with_text_signals

FILES = "path string, modificationTime timestamp, length long, content binary"


def pdf_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New PDF files of a folder: doc, path, content."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return files.select(F.sha2("content", 256).alias("doc"), "path", "content", "modificationTime")


def routed_stream(pages: DataFrame) -> DataFrame:
    """A stream of pages (text) with signals, route and quality."""
    return C.with_quality(C.with_route(with_text_signals(pages)))


def once(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The stream without redelivered keys; state is kept for the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latency_windows(events: DataFrame, time: str, value: str, by: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; events later than the delay are dropped."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), by)
    return w.agg(F.count("*").alias("pages"), F.sum(value).alias("us")).select(F.col("w.start").alias("window_start"), by, "pages", "us")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each key, which a gap ends."""
    w = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by)
    return w.agg(F.count("*").alias("pages")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), by, "pages")


def run_available(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops: Parquet files in the folder, exactly once by the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
