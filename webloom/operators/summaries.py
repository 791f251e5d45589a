"""Summaries of snapshots and sitemaps: distributions, flag totals, word statistics, top targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.columns import hostname_of, path_depth, to_fixed_1
from webloom.operators.extraction import explode_links
from webloom.operators.search import seo_flags

FLAGS = (
    "ERR_4XX", "ERR_5XX", "ERR_MISSING_DESC", "ERR_MISSING_H1", "WARN_DESC_TOO_LONG", "WARN_DESC_TOO_SHORT", "WARN_DUPLICATE",
    "WARN_THIN_CONTENT", "WARN_TITLE_TOO_LONG", "WARN_TITLE_TOO_SHORT",
)
BUCKETS = (("<150", 150), ("150-500", 500), ("500-1k", 1000), ("1k-2k", 2000), ("2k-5k", 5000), ("5k+", None))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def distribution(snapshot: DataFrame, column: str) -> DataFrame:
    return snapshot.groupBy(column).agg(F.count("*").alias("pages"))


def flag_totals(snapshot: DataFrame) -> DataFrame:
    """(flag, pages) for every flag, duplicates of pages included, zeros too."""
    flagged = snapshot.select(seo_flags().alias("flags"))
    sums = [F.count_if(F.array_contains("flags", f)).alias(f) for f in FLAGS]
    totals = flagged.agg(*sums)
    return totals.select(F.explode(F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.col(f))])).alias("flag", "pages"))


def word_statistics(snapshot: DataFrame, column: str) -> DataFrame:
    """min, max, upper median and rounded mean of a count over pages that have the record; zeros if none.

    The median is read from value counts, of which there are few, instead of from sorted rows.
    """
    values = snapshot.where("seo is not null").groupBy(F.col(f"seo.{column}").alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("v")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return ranked.agg(zero(F.min("v")).alias("min"), zero(F.max("v")).alias("max"), zero(middle).alias("median"), zero(round_half_up(F.sum(F.col("v") * F.col("n")) / F.sum("n"))).alias("avg"))


def word_buckets(snapshot: DataFrame) -> DataFrame:
    """(bucket, pages) over article words, all six buckets."""
    words = F.coalesce(F.col("seo.article_word_count"), F.lit(0))
    name = None
    for bucket, below in BUCKETS[:-1]:
        name = F.when(words < below, bucket) if name is None else name.when(words < below, bucket)
    counted = snapshot.where("seo is not null").groupBy(name.otherwise(BUCKETS[-1][0]).alias("bucket")).agg(F.count("*").alias("pages"))
    every = snapshot.sparkSession.createDataFrame([(b,) for b, _ in BUCKETS], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("pages", F.lit(0).cast("long")).alias("pages"))


def top_linked(snapshot: DataFrame, limit: int = 15) -> DataFrame:
    """The internal targets with the most links, as written; ties by first sight."""
    seen = explode_links(snapshot)
    counted = seen.groupBy("href").agg(F.count("*").alias("links"), F.min(F.struct("ord", "pos")).alias("first"))
    return counted.orderBy(F.desc("links"), "first").limit(limit).select("href", "links")


def top_external_hosts(snapshot: DataFrame, limit: int = 10) -> DataFrame:
    seen = explode_links(snapshot, "external").withColumn("host", hostname_of("href")).where("host is not null")
    counted = seen.groupBy("host").agg(F.count("*").alias("links"), F.min(F.struct("ord", "pos")).alias("first"))
    return counted.orderBy(F.desc("links"), "first").limit(limit).select("host", "links")


def sitemap_totals(entries: DataFrame) -> DataFrame:
    dated = F.when(F.col("lastmod") != "", F.col("lastmod"))
    return entries.agg(
        F.count("*").alias("total_urls"), F.count(dated).alias("with_lastmod"), F.count("priority").alias("with_priority"),
        F.min(dated).alias("oldest_lastmod"), F.max(dated).alias("newest_lastmod"),
    )


def priority_histogram(entries: DataFrame) -> DataFrame:
    return entries.where("priority is not null").groupBy(to_fixed_1("priority").alias("priority")).agg(F.count("*").alias("urls"))


def changefreq_histogram(entries: DataFrame) -> DataFrame:
    return entries.where("changefreq <> ''").groupBy("changefreq").agg(F.count("*").alias("urls"))


def url_depth_histogram(entries: DataFrame) -> DataFrame:
    return entries.select(path_depth("url").alias("url_depth")).where("url_depth is not null").groupBy("url_depth").agg(F.count("*").alias("urls"))
