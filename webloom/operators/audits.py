"""Audits of meta records, headings, images and structured data over a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import hostname_of


def analysed(snapshot: DataFrame) -> DataFrame:
    return snapshot.where("not is_duplicate")


def count_if(condition: Column | str, name: str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition).alias(name)


def title_of(snapshot: DataFrame) -> Column:
    """The page's title, empty without one; also in a snapshot without that record."""
    return (F.coalesce("seo.title", F.lit("")) if "seo" in snapshot.columns else F.lit("")).alias("title")


def by_depth_and_url(rows: DataFrame) -> DataFrame:
    return rows.orderBy("depth", F.collate("url", "UNICODE"))


def canonical_class(snapshot: DataFrame) -> DataFrame:
    """Adds ``canonical_class``: missing, cross_domain, cross_page or self; unreadable ones are cross_page."""
    own, other = hostname_of("url"), hostname_of("meta.canonical")
    hosts = snapshot.withColumn("own_host", own).withColumn("canonical_host", other)
    kind = (
        F.when(F.coalesce("meta.canonical", F.lit("")) == "", "missing")
        .when(F.col("own_host").isNull() | F.col("canonical_host").isNull(), "cross_page")
        .when(F.col("own_host") != F.col("canonical_host"), "cross_domain")
        .when(F.col("meta.canonical") != F.col("url"), "cross_page")
        .otherwise("self")
    )
    return hosts.withColumn("canonical_class", F.when(F.col("meta").isNotNull(), kind)).drop("own_host", "canonical_host")


def every(column: str) -> Column:
    """All values of an array column, sorted; distinct arrays, of which there are few, are gathered first."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(column))))))


META_CHECKS = {
    "noindex": "meta.robots.noindex", "nofollow": "meta.robots.nofollow", "missing_canonical": "canonical_class = 'missing'",
    "cross_page_canonical": "canonical_class = 'cross_page'", "cross_domain_canonical": "canonical_class = 'cross_domain'",
    "missing_open_graph": "meta is not null and meta.open_graph is null",
    "missing_og_title": "meta.open_graph is not null and coalesce(meta.open_graph.title, '') = ''",
    "missing_og_description": "meta.open_graph is not null and coalesce(meta.open_graph.description, '') = ''",
    "missing_og_image": "meta.open_graph is not null and coalesce(meta.open_graph.image, '') = ''",
    "missing_twitter_card": "meta is not null and meta.twitter_card is null",
    "missing_viewport": "meta is not null and coalesce(meta.viewport, '') = ''", "with_hreflang": "size(meta.hreflang) > 0",
}


def meta_summary(snapshot: DataFrame) -> DataFrame:
    """One row: pages analysed, a count per check, and the languages of alternates in code order."""
    checked = canonical_class(analysed(snapshot))
    return checked.agg(F.count("*").alias("pages_analyzed"), *(count_if(f"coalesce({c}, false)", n) for n, c in META_CHECKS.items()), every("meta.hreflang.hreflang").alias("hreflang_languages"))


def holding(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, as an array."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in checks.items())), lambda x: x.isNotNull())


def all_meta_pages(snapshot: DataFrame) -> DataFrame:
    """The pages of every check, each with the check's name; the snapshot is read once."""
    found = canonical_class(analysed(snapshot)).withColumn("check", F.explode(holding({name: F.expr(c) for name, c in META_CHECKS.items()})))
    return found.select("check", "ord", "url", F.coalesce("seo.title", F.lit("")).alias("title"), "meta.canonical")


def meta_pages(snapshot: DataFrame, check: str) -> DataFrame:
    """The pages that a check of ``META_CHECKS`` finds, in input order."""
    found = canonical_class(analysed(snapshot)).where(META_CHECKS[check])
    return found.select("ord", "url", F.coalesce("seo.title", F.lit("")).alias("title"), "meta.canonical")


HEADING_CHECKS = ("missing_h1", "multiple_h1", "h1_not_first", "skipped_levels")


def heading_summary(snapshot: DataFrame) -> DataFrame:
    """One row: pages analysed, with or without the record, and those with each issue."""
    return analysed(snapshot).agg(F.count("*").alias("pages_analyzed"), *(count_if(f"coalesce(headings.issues.{c}, false)", c) for c in HEADING_CHECKS))


def heading_distribution(snapshot: DataFrame, level: str = "h1") -> DataFrame:
    return analysed(snapshot).where("headings is not null").groupBy(F.col(f"headings.counts.{level}").alias(f"{level}_count")).agg(F.count("*").alias("pages"))


def heading_details(snapshot: DataFrame) -> list:
    """Title, depth, first headings and the first skipped level of a page."""
    h1 = F.transform(F.filter("headings.headings", lambda h: h["level"] == 1), lambda h: h["text"])
    levels = F.col("headings.headings.level")
    rest = F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0)))
    steps = F.zip_with(levels, rest, lambda a, b: F.when(b > a + 1, F.concat(F.lit("H"), a.cast("string"), F.lit(" → H"), b.cast("string"))))
    skip = F.get(F.filter(steps, lambda s: s.isNotNull()), F.lit(0))
    return [title_of(snapshot), "depth", F.size(h1).alias("h1_count"), h1.alias("h1_texts"), skip.alias("first_skip")]


def heading_rows(snapshot: DataFrame, check: str) -> DataFrame:
    """Pages with an issue, in any order, with the detail that shows it."""
    return analysed(snapshot).where(f"headings.issues.{check}").select("url", *heading_details(snapshot))


def heading_pages(snapshot: DataFrame, check: str) -> DataFrame:
    """Pages with an issue, by depth and url, with the detail that shows it."""
    return by_depth_and_url(heading_rows(snapshot, check))


def all_heading_pages(snapshot: DataFrame) -> DataFrame:
    """The pages of every issue, each with the issue's name; the snapshot is read once."""
    return analysed(snapshot).withColumn("check", F.explode(holding({c: F.col(f"headings.issues.{c}") for c in HEADING_CHECKS}))).select("check", "url", *heading_details(snapshot))


def image_pages(snapshot: DataFrame) -> DataFrame:
    """Pages with images of their own, with counts; those of source sets count where sizes are missing."""
    found = analysed(snapshot).where("images.counts.total > 0")
    bare = F.size(F.filter("images.images", lambda i: i["width"].isNull() & i["height"].isNull()))
    return found.select("ord", "url", title_of(snapshot), "images.counts.*", bare.alias("missing_dims"))


def rate(part: Column, whole: Column, empty: int) -> Column:
    return F.when(whole == 0, empty).otherwise(F.floor(part / whole * 100 + 0.5)).cast("long")


def image_summary(snapshot: DataFrame) -> DataFrame:
    """Site totals, alt coverage and lazy loading in per cent, and pages with issues (all of them, not a slice)."""
    pages = image_pages(snapshot)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "missing", "decorative", "present", "lazy_loaded", "missing_dims")]
    totals = pages.agg(
        F.count("*").alias("pages_with_images"), *sums, count_if("missing > 0", "pages_with_missing_alt"), count_if("missing = total", "pages_with_complete_failure"),
        count_if("missing_dims > 0", "pages_with_cls_risk"),
    )
    coverage = rate(F.col("present"), F.col("total") - F.col("decorative"), 100)
    return totals.withColumn("alt_coverage_rate", coverage).withColumn("lazy_load_rate", rate(F.col("lazy_loaded"), F.col("total"), 0))


def worst_images(snapshot: DataFrame, by: str = "missing", limit: int = 25) -> DataFrame:
    """Pages with most images that lack an alt text (``missing``) or sizes (``missing_dims``)."""
    order = [F.desc(by), F.desc("total"), "ord"] if by == "missing" else [F.desc(by), "ord"]
    return image_pages(snapshot).where(F.col(by) > 0).orderBy(*order).limit(limit)


def schema_types(snapshot: DataFrame, only: tuple[str, ...] = ()) -> DataFrame:
    """(type, pages), most first: pages with each type, once per page; ``only`` in any letter case."""
    each = analysed(snapshot).where("schema.has_schema").select("url", F.explode(F.array_distinct("schema.types")).alias("type"))
    if only:
        each = each.where(F.lower("type").isin([t.lower() for t in only]))
    return each.groupBy("type").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "type")


def schema_summary(snapshot: DataFrame) -> DataFrame:
    pages = analysed(snapshot)
    has = F.coalesce(F.col("schema.has_schema"), F.lit(False))
    counts = pages.agg(F.count("*").alias("pages_analyzed"), count_if(has, "pages_with_schema"), F.size(every("schema.types")).cast("long").alias("unique_types"))
    counts = counts.withColumn("pages_without_schema", F.col("pages_analyzed") - F.col("pages_with_schema"))
    return counts.withColumn("adoption_rate", rate(F.col("pages_with_schema"), F.col("pages_analyzed"), 0))


def rows_without_schema(snapshot: DataFrame) -> DataFrame:
    return analysed(snapshot).where("not coalesce(schema.has_schema, false)").select("url", title_of(snapshot), "depth")


def pages_without_schema(snapshot: DataFrame) -> DataFrame:
    return by_depth_and_url(rows_without_schema(snapshot))


def schema_properties(snapshot: DataFrame, path: str, kind: str = "string") -> DataFrame:
    """(url, types, value): a JSON path's value in every block."""
    blocks = snapshot.select("url", F.explode("schema.blocks").alias("b"))
    return blocks.select("url", "b.types", F.try_variant_get(F.try_parse_json("b.raw"), path, kind).alias("value"))
