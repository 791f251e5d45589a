"""A made site for the audits: one captured page for each part, all of its markup a function of the part's key.

The page table holds no images, structured data, cards or alternates; these pages do, in all the cases that audits tell apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.plans.tables import spread, table

HOME = "https://site.example/p/"


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def by(number: Column, cases: dict[int, Column | str], other: Column | str = "") -> Column:
    """The case of a number, else ``other``."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    out = None
    for value, case in cases.items():
        out = F.when(number == value, lit(case)) if out is None else out.when(number == value, lit(case))
    return out.otherwise(lit(other))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, url, html, status_code, depth, is_duplicate)."""
    k = F.col("p_partkey")
    title = F.trim(F.expr("repeat(p_name || ' ', cast(1 + p_partkey % 7 as int))"))
    meta = text(
        by(k % 4, {1: text("<meta name=description content='Short ", k, "'>"), 2: text("<meta name=description content='", "about " * 12, "'>"), 3: text("<meta name=description content='", "more about " * 16, "'>")}),
        by(k % 11, {0: "<meta name=robots content='noindex, nofollow'>", 1: "<meta name=robots content=none>"}),
        by(k % 6, {0: "", 2: text("<link rel=canonical href='/p/", k + 1, "'>"), 3: text("<link rel=canonical href='https://other.example/p/", k, "'>")}, text("<link rel=canonical href='", HOME, k, "'>")),
        by(k % 3, {1: "<meta property='og:title' content=a><meta property='og:description' content=b><meta property='og:image' content=c>", 2: "<meta property='og:title' content=a>"}),
        by(k % 4, {1: "<meta name='twitter:card' content=summary>"}), by(k % 2, {0: "<meta name=viewport content='width=device-width'>"}),
        by(k % 10, {3: "<link rel=alternate hreflang=en href=/en><link rel=alternate hreflang=de href=/de>", 4: "<link rel=alternate hreflang=fr href=/fr>"}),
        by(k % 3, {1: "<script type='application/ld+json'>{\"@type\": \"Product\"}</script>", 2: text("<script type='application/ld+json'>{\"@graph\": [{\"@type\": [\"Product\", \"Thing\"], \"sku\": ", k, "}, {\"@type\": \"Offer\"}]}</script>")}),
    )
    headings = by(k % 5, {0: "<h1>One</h1><h2>Two</h2>", 1: "<h2>Two</h2><h3>Three</h3>", 2: "<h1>One</h1><h1>Uno</h1>", 3: "<h2>Two</h2><h1>One</h1>", 4: "<h1>One</h1><h3>Three</h3>"})
    one = lambda i: text(
        "<img src='/i/", k, "-", i, ".png'", by((k + i) % 3, {1: " alt=''", 2: " alt=photo"}), by((k + i) % 2, {0: " width=10 height=20"}), F.when(i == 1, " loading=lazy").otherwise(""), ">"
    )
    images = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= k % 4, one(i - 1)).otherwise("")), "")
    links = text(*(part for n in (k * 2, k * 2 + 1, F.expr("p_partkey div 2")) for part in ("<a href='/p/", n, "'>to ", n, "</a>")))
    away = text("<a rel=nofollow href='https://h", k % 7, ".example.org/x/", k, "'>away</a>", by(k % 2, {0: text("<a href='https://www.h", k % 3, ".example.net/'>net</a>")}))
    body = text("<article><p>", F.expr("repeat('word ', cast(p_partkey % 300 as int))"), "</p></article>")
    html = text("<html><head><title>", title, "</title>", meta, "</head><body>", headings, images, "<div>", links, away, "</div>", body, "</body></html>")
    status = F.when(k % 40 == 39, 404).otherwise(200)
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(k.alias("ord"), text(HOME, k).alias("url"), html.alias("html"), status.alias("status_code"), (k % 5).cast("int").alias("depth"), (k % 50 == 0).alias("is_duplicate"))
