"""A capture against a sitemap or discovery results: gaps either way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import graph_key_of
from webloom.functions.urls import hostname
from webloom.plans.tables import Stash


def last_by_key(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """(key, columns): the last row of each key, by ``ord`` and, where that is the same, by the url's code points."""
    keyed = rows.select("ord", graph_key_of("url").alias("key"), F.col("url").alias("tie"), *columns)
    kept = [c for c in keyed.columns if c not in ("ord", "key", "tie")]
    return keyed.groupBy("key").agg(F.max_by(F.struct(*kept), F.struct("ord", "tie")).alias("last")).select("key", "last.*")


def sitemap_gaps(snapshot: DataFrame, sitemap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in the sitemap but not captured; captured but not in the sitemap, classed with a note).

    ``sitemap`` has (ord, url). Duplicates do not count as captured. Classes are noindex, error and genuine. Both sides
    are read once, with their keys, into written tables.
    """
    stash = Stash(snapshot.sparkSession, "gaps")
    noindex = F.coalesce("meta.robots.noindex", F.lit(False)).alias("noindex")
    title = F.col("seo.title") if "seo" in snapshot.columns else F.lit(None).cast("string").alias("title")
    captured = stash.put(last_by_key(snapshot.where("not is_duplicate"), "url", title, "status_code", "depth", noindex), "captured")
    listed = stash.put(last_by_key(sitemap, "url"), "listed")
    missing = listed.join(captured.select("key"), "key", "left_anti").select("url")
    error = F.col("status_code") >= 400
    extra = captured.join(listed.select("key"), "key", "left_anti").select(
        "url", "title", "status_code", "depth", "noindex",
        F.when(F.col("noindex"), "noindex").when(error, "error").otherwise("genuine").alias("gap"),
        F.when(F.col("noindex"), "noindex, rightly not listed").when(error, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("note"),
    )
    return missing, extra


def gap_counts(missing: DataFrame, extra: DataFrame) -> DataFrame:
    counts = extra.agg(F.count("*").alias("captured_not_in_sitemap"), *(F.count_if(F.col("gap") == g).alias(g) for g in ("noindex", "error", "genuine")))
    return counts.crossJoin(missing.agg(F.count("*").alias("in_sitemap_not_captured")))  # one row by one row


def host_warning(seed_url: str, sitemap_url: str) -> str | None:
    one, two = hostname(seed_url), hostname(sitemap_url)
    return f"the capture is of {one}, the sitemap of {two}" if one and two and one != two else None


def undiscovered(snapshot: DataFrame, discovery: DataFrame) -> DataFrame:
    """Discovery rows whose key no captured page has; here duplicates count as captured, and rows stay as they are."""
    captured = snapshot.select(graph_key_of("url").alias("key")).distinct()
    return discovery.withColumn("key", graph_key_of("url")).join(captured, "key", "left_anti").drop("key")
