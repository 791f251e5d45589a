"""Continuous ingest of page files: extraction, duplicate bodies by state, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.extraction import extract_records
from webloom.plans.metrics import RunMetrics, page_metrics


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows (url, html, captured_at) of Parquet files as they arrive in a folder."""
    return spark.readStream.schema("url string, html string, captured_at timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_bodies(pages: DataFrame, within: str = "1 day") -> DataFrame:
    """The first capture of each body within the watermark's reach; empty bodies all pass.

    Only the body's hash is kept as state.
    """
    key = F.when(F.octet_length("html") > 0, F.sha2("html", 256)).otherwise(F.concat(F.col("url"), F.col("captured_at").cast("string")))
    return pages.withColumn("body_key", key).withWatermark("captured_at", within).dropDuplicatesWithinWatermark(["body_key"]).drop("body_key")


def capture_counts(pages: DataFrame, width: str = "1 hour", late: str = "1 day", by: tuple[str, ...] = ()) -> DataFrame:
    """Captures per time window and group, for rows no later than the watermark allows."""
    windows = pages.withWatermark("captured_at", late).groupBy(F.window("captured_at", width), *by).agg(F.count("*").alias("captures"))
    return windows.select(F.col("window.start").alias("window_start"), *by, "captures")


def ingest(pages: DataFrame, target: str, checkpoint: str, records: tuple[str, ...] = ("seo", "links", "headings", "meta", "images", "schema")):
    """Starts a query that appends extracted pages to a Parquet table and ends when the input is read."""
    extracted = extract_records(pages, records)
    return extracted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_counted(pages: DataFrame, target: str, checkpoint: str, records: tuple[str, ...] = ("seo",), more: dict | None = None) -> dict[str, int]:
    """:func:`ingest` to the end of the input, and what its batches counted: rows, failed rows, failures by extractor.

    The counts are taken as the rows pass, so no batch is read twice; those of a restarted query are of what it read since.
    """
    spark = pages.sparkSession
    metrics = RunMetrics("pages")
    spark.streams.addListener(metrics)
    try:
        extracted = extract_records(pages, records, more)
        counted = extracted.observe("pages", *page_metrics(extracted.columns, (*records, *(more or ()))))
        query = counted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return metrics.totals(str(query.id))
    finally:
        spark.streams.removeListener(metrics)
