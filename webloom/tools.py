"""One function per audit task: tables in, a dictionary of small values and DataFrames out.

DataFrames in a result are lazy; lists are cut where the task names a limit, and counts are of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import hints
from webloom.operators import audits, comparison, extraction, link_graph, search, summaries
from webloom.operators.walk import WalkConfig, duplicate_bodies, stop_reason, walk
from webloom.parameters import checked
from webloom.plans.tables import Stash
from webloom.sources import api_pages, fetches, sitemaps


def observed(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, object]:
    """The rows, and an observation that holds their count and failures once an action has read them."""
    from pyspark.sql import Observation

    seen = Observation(name)
    failed = F.count_if(F.size("errors") > 0) if "errors" in rows.columns else F.lit(0)
    return rows.observe(seen, F.count("*").alias("rows"), failed.alias("failed")), seen


@checked
def capture(
    spark: SparkSession, store: DataFrame, url: str, max_depth: int = 2, max_pages: int = 50, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (),
    subdomains: bool = False, robots: DataFrame | None = None,
) -> dict:
    """Walks a page store (url, status, content_type, html, location) and extracts all records.

    ``robots`` has (host, status, text). The snapshot's order is depth, then url.
    """
    stash = Stash(spark, "tool-capture")
    linked = stash.put(extraction.discover_links(store.withColumn("body", F.col("html"))), "store")
    verdicts = fetches.robots_verdicts(store, robots) if robots is not None else None
    config = WalkConfig(url, max_depth, include, exclude, subdomains, robots is not None, max_pages)
    result = walk(spark, linked.select("url", "status", "body", "location", "targets"), config, verdicts)
    found = stash.put(result.pages, "pages")
    # increasing in the order of the sorted rows; written, so that it stays
    ordered = stash.put(found.orderBy("depth", "url").withColumn("ord", F.monotonically_increasing_id()), "ordered")
    rows = ordered.join(store.select("url", "html"), "url", "left").select(
        "ord", "url", F.coalesce("html", F.lit("")).alias("html"), F.col("status").alias("status_code"), "depth", "is_duplicate"
    )
    captured, ignored = found.count(), result.ignored.count()
    snapshot = extraction.extract_records(rows)
    return {
        "seed_url": url, "pages_captured": captured, "pages_ignored": ignored, "ignored_breakdown": result.summary(), "buried": result.buried,
        "stopped_reason": stop_reason(False, captured < max_pages), "snapshot": snapshot, "pages": search.project_pages(snapshot),
    }


def need(snapshot: DataFrame, record: str) -> DataFrame:
    """The snapshot, or an error if none of its pages has the record."""
    if record not in snapshot.columns or snapshot.where(F.col(record).isNotNull()).isEmpty():
        raise ValueError(f"no {record} data in the snapshot")
    return snapshot


def more_than(shown: int, total: int) -> str | None:
    """The note under a list that was cut."""
    return f"{total - shown} more" if total > shown else None


def read_page(pages: DataFrame, max_chars: int = 3000, raw_html: bool = False) -> DataFrame:
    """Articles of captured pages, flattened, with a note where a page looks blocked or needs scripts."""
    read = extraction.read_articles(pages, max_chars, raw_html)
    from webloom.functions.columns import needs_scripts

    return read.withColumn("gated", needs_scripts("url")).select("*", "article.*").drop("article")


@checked
def read_api(responses: DataFrame, page_size: int = 20, max_pages: int = 10, max_items: int | None = None, results_path: str = "", total_path: str = "") -> dict:
    items, summary = api_pages.collect_items(responses, page_size, results_path, total_path, max_items, max_pages)
    return {"summary": summary, "results": items}


@checked
def read_sitemap(root: DataFrame, files: DataFrame, max_urls: int = 5000) -> dict:
    entries = sitemaps.expand_index(root, files, max_urls)
    return {"url_count": entries.count(), "entries": entries}


@checked
def search_manifest(rows: DataFrame, limit: int = 20, offset: int = 0, fields: tuple[str, ...] = search.PAGE_FIELDS, table: bool = False, **conditions) -> dict:
    """A page of matching snapshot pages or of sitemap entries; tables of other kinds are refused."""
    if "status_code" not in rows.columns and "lastmod" not in rows.columns:
        raise ValueError("neither a capture nor a sitemap")
    if "status_code" in rows.columns:
        found, total = search.search_pages(rows, limit, offset, fields, **conditions)
    else:
        kept = search.filter_sitemap(rows, **conditions)
        named = [c for c in (search.ENTRY_FIELDS if fields == search.PAGE_FIELDS else fields) if c in rows.columns]
        found, total = search.page_of(kept, limit, offset).select(*named), kept.agg(F.count("*"))
    return {"total_matched": total.first()[0], "offset": offset, "limit": limit, "results": search.pipe_table(found, limit) if table else found}


def summarise_capture(snapshot: DataFrame) -> dict:
    return {
        "total_pages": snapshot.count(), "status_codes": summaries.distribution(snapshot, "status_code"), "depths": summaries.distribution(snapshot, "depth"),
        "article_words": summaries.word_statistics(snapshot, "article_word_count"), "raw_words": summaries.word_statistics(snapshot, "word_count"),
        "article_word_buckets": summaries.word_buckets(snapshot), "flags": summaries.flag_totals(snapshot), "top_linked": summaries.top_linked(snapshot),
        "top_external_hosts": summaries.top_external_hosts(snapshot),
    }


def summarise_sitemap(entries: DataFrame) -> dict:
    return {
        "totals": summaries.sitemap_totals(entries), "priorities": summaries.priority_histogram(entries), "changefreqs": summaries.changefreq_histogram(entries),
        "url_depths": summaries.url_depth_histogram(entries),
    }


def analyse_links(snapshot: DataFrame, seed_url: str, top: int = 25) -> dict:
    from webloom.functions.urls import graph_key

    graph = link_graph.link_graph(need(snapshot, "links"))
    loose, ends = link_graph.orphans(graph, graph_key(seed_url)), link_graph.sinks(graph)
    sink_count = ends.count()
    return {
        "totals": graph.totals(), "orphans": link_graph.by_depth_and_url(loose), "single_path": link_graph.single_path(graph).orderBy(F.collate("url", "UNICODE")),
        "broken": link_graph.broken_links(graph), "sink_count": sink_count, "sinks_note": more_than(top, sink_count), "sinks": link_graph.by_depth_and_url(ends).limit(top),
        "top_in": link_graph.top_pages(graph, "in_links", top), "top_out": link_graph.top_pages(graph, "out_links", top),
    }


def analyse_meta(snapshot: DataFrame) -> dict:
    need(snapshot, "meta")
    return {"summary": audits.meta_summary(snapshot)} | {check: audits.meta_pages(snapshot, check) for check in audits.META_CHECKS}


def analyse_headings(snapshot: DataFrame) -> dict:
    need(snapshot, "headings")
    found = {f"{level}_distribution": audits.heading_distribution(snapshot, level).orderBy(f"{level}_count") for level in ("h1", "h2")}
    return {"summary": audits.heading_summary(snapshot)} | found | {check: audits.heading_pages(snapshot, check) for check in audits.HEADING_CHECKS}


@checked
def analyse_images(snapshot: DataFrame, top: int = 25) -> dict:
    failures = audits.image_pages(need(snapshot, "images")).where("missing = total").orderBy(F.desc("total"), "ord")
    return {"summary": audits.image_summary(snapshot), "worst_missing_alt": audits.worst_images(snapshot, "missing", top), "complete_alt_failures": failures, "worst_cls_risk": audits.worst_images(snapshot, "missing_dims", top)}


def analyse_schema(snapshot: DataFrame, only: tuple[str, ...] = ()) -> dict:
    need(snapshot, "schema")
    return {"summary": audits.schema_summary(snapshot), "types": audits.schema_types(snapshot, only), "no_schema": audits.pages_without_schema(snapshot)}


@checked
def compare_manifests(snapshot: DataFrame, sitemap: DataFrame, seed_url: str, sitemap_url: str, limit: int = 100) -> dict:
    missing, extra = comparison.sitemap_gaps(snapshot, sitemap)
    lists = {g: extra.where(F.col("gap") == g).orderBy("depth", F.collate("url", "UNICODE")).limit(n) for g, n in (("genuine", limit), ("noindex", 50), ("error", 50))}
    return {"warning": comparison.host_warning(seed_url, sitemap_url), "counts": comparison.gap_counts(missing, extra), "in_sitemap_not_captured": missing.orderBy(F.collate("url", "UNICODE")).limit(limit)} | lists


@checked
def find_orphans(snapshot: DataFrame, discovery: DataFrame, limit: int = 100) -> dict:
    found = comparison.undiscovered(snapshot, discovery)
    return {"orphans_found": found.count(), "orphans": found.orderBy("ord").limit(limit)}


def extract_batch(pages: DataFrame) -> DataFrame:
    """Client-side records of {url, html} rows."""
    return extraction.extract_client_pages(pages)


def mark_duplicates(rows: DataFrame, body: str = "html") -> DataFrame:
    """The duplicate mark of a capture: all but the first page, by depth and order, of each body."""
    return duplicate_bodies(rows, body, ["depth", "ord"])


def search_queries(recipes: dict[str, dict], domain: str, engine: str = "google") -> dict[str, str]:
    """Search URLs of all recipes that need nothing but the domain."""
    return {name: hints.search_url(r["template"], domain, engine=engine) for name, r in recipes.items() if not r.get("variables")}
