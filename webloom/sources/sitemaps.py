"""Sitemap XML to entries, by pattern: entities stay as written, CDATA wrappers go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.texts import decoded


def tag_text(xml: Column, name: str) -> Column:
    """The trimmed text of the first such tag, null if there is none or it is empty."""
    raw = F.trim(F.regexp_extract(xml, rf"(?is)<{name}>(.*?)</{name}>", 1), F.lit(" \t\r\n"))
    inner = F.trim(F.regexp_replace(raw, r"(?is)^<!\[CDATA\[(.*?)\]\]>$", "$1"), F.lit(" \t\r\n"))
    return F.when(inner != "", inner)


def is_index(xml: Column) -> Column:
    return xml.rlike(r"(?i)<sitemapindex[\s>]")


def parse_urlset(files: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, pos, url, lastmod, changefreq, priority): one row per entry that names a location.

    A priority is the number its text begins with; unreadable ones are null.
    """
    blocks = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    each = files.select(*[c for c in files.columns if c != xml], F.posexplode(blocks).alias("pos", "block"))
    block = F.col("block")
    number = F.regexp_extract(tag_text(block, "priority"), r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
    return each.select(
        *[c for c in each.columns if c != "block"], tag_text(block, "loc").alias("url"), tag_text(block, "lastmod").alias("lastmod"),
        tag_text(block, "changefreq").alias("changefreq"), number.try_cast("double").alias("priority"),
    ).where("url is not null")


def expand_index(root: DataFrame, files: DataFrame, max_urls: int = 5000) -> DataFrame:
    """Entries of a sitemap, or of an index's children one level down, in order, at most ``max_urls``.

    ``root`` is one row (xml); ``files`` has (url, xml) of fetched children; those missing are skipped.
    """
    own = parse_urlset(root.withColumn("nested", is_index(F.col("xml"))))
    children = own.where("nested").select(F.col("pos").alias("child"), F.col("url").alias("child_url"))
    nested = parse_urlset(children.join(files, children["child_url"] == files["url"]).select("child", "xml"))
    plain = own.where("not nested").withColumn("child", F.lit(0)).select("child", "pos", "url", "lastmod", "changefreq", "priority")
    return plain.unionByName(nested.select(plain.columns)).orderBy("child", "pos").limit(max_urls)


def seed_locations(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Locations that seed a capture; here the XML character references are decoded, once."""
    return parse_urlset(files, xml).withColumn("url", decoded(F.col("url")))
