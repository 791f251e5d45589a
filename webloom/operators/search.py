"""Search over snapshots and sitemaps: flags, filters, projections, paging, pipe tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.extraction import extract_records
from webloom.plans.metrics import observed
from webloom.plans.tables import Stash

#: Words under which a page counts as thin, and the bounds of good titles and descriptions.
THIN, TITLE, DESCRIPTION = 150, (30, 60), (50, 160)
ENTRY_FIELDS = ("url", "lastmod", "changefreq", "priority")
PAGE_FIELDS = ("url", "status_code", "depth", "title", "h1", "description", "word_count", "article_word_count", "flags")


def utf16_length(text: Column) -> Column:
    """Length as scripts count it: two for a code point beyond the basic plane."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def seo_flags() -> Column:
    """The flags of a page, in fixed order; those on its texts only if it has an SEO record."""
    has = F.col("seo").isNotNull()
    title, text = utf16_length(F.coalesce("seo.title", F.lit(""))), utf16_length(F.coalesce("seo.description", F.lit("")))
    flags = [
        F.when(F.col("status_code") >= 500, "ERR_5XX").when(F.col("status_code") >= 400, "ERR_4XX"),
        F.when(F.col("is_duplicate"), "WARN_DUPLICATE"),
        F.when(has & (F.coalesce("seo.h1", F.lit("")) == ""), "ERR_MISSING_H1"),
        F.when(has & (text == 0), "ERR_MISSING_DESC"),
        F.when(has & (F.coalesce("seo.article_word_count", F.lit(0)) < THIN), "WARN_THIN_CONTENT"),
        F.when(has & (title > TITLE[1]), "WARN_TITLE_TOO_LONG").when(has & title.between(1, TITLE[0] - 1), "WARN_TITLE_TOO_SHORT"),
        F.when(has & (text > DESCRIPTION[1]), "WARN_DESC_TOO_LONG").when(has & text.between(1, DESCRIPTION[0] - 1), "WARN_DESC_TOO_SHORT"),
    ]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def project_pages(snapshot: DataFrame) -> DataFrame:
    """Flat page rows: missing texts are empty, missing counts zero."""
    blank = lambda c: F.coalesce(F.col(f"seo.{c}"), F.lit("")).alias(c)
    zero = lambda c: F.coalesce(F.col(f"seo.{c}"), F.lit(0)).alias(c)
    return snapshot.select("ord", "url", "status_code", "depth", blank("title"), blank("h1"), blank("description"), zero("word_count"), zero("article_word_count"), seo_flags().alias("flags"))


def filter_pages(
    pages: DataFrame, url_pattern: str = "", keyword: str = "", words: tuple[int | None, int | None] = (None, None),
    article_words: tuple[int | None, int | None] = (None, None), has_flag: str = "", status_code: int | None = None,
) -> DataFrame:
    """All conditions must hold; an empty one is not asked. The keyword may span title, h1 and description."""
    if url_pattern:
        pages = pages.where(F.col("url").contains(url_pattern))
    if status_code is not None:
        pages = pages.where(F.col("status_code") == status_code)
    for column, (least, most) in (("word_count", words), ("article_word_count", article_words)):
        if least is not None:
            pages = pages.where(F.col(column) >= least)
        if most is not None:
            pages = pages.where(F.col(column) <= most)
    if keyword:
        pages = pages.where(F.lower(F.concat_ws(" ", "title", "h1", "description")).contains(keyword.lower()))
    return pages.where(F.array_contains("flags", has_flag)) if has_flag else pages


def page_of(rows: DataFrame, limit: int = 20, offset: int = 0, order: str = "ord") -> DataFrame:
    """One page of results in input order; 1 to 100 rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    return rows.orderBy(order).offset(offset).limit(limit)


def search_pages(snapshot: DataFrame, limit: int = 20, offset: int = 0, fields: tuple[str, ...] = PAGE_FIELDS, **conditions) -> tuple[DataFrame, DataFrame]:
    """A page of matching rows, and a one-row frame with the number of all matches."""
    found = filter_pages(project_pages(snapshot), **conditions)
    return page_of(found, limit, offset).select(*fields), found.agg(F.count("*").alias("total_matched"))


def search_captures(pages: DataFrame, limit: int = 20, offset: int = 0, fields: tuple[str, ...] = PAGE_FIELDS, ended: bool = False, **conditions) -> tuple[DataFrame, DataFrame]:
    """:func:`search_pages` of captured pages (with html): conditions on plain columns hold before any page is read."""
    return search_pages(extract_records(prefiltered(pages, conditions), ("seo",), ended=ended), limit, offset, fields, **conditions)


def prefiltered(pages: DataFrame, conditions: dict) -> DataFrame:
    """The pages that conditions on plain columns leave."""
    if conditions.get("url_pattern"):
        pages = pages.where(F.col("url").contains(conditions["url_pattern"]))
    if conditions.get("status_code") is not None:
        pages = pages.where(F.col("status_code") == conditions["status_code"])
    flag = conditions.get("has_flag", "")
    if flag == "WARN_DUPLICATE":
        pages = pages.where("is_duplicate")
    elif flag in ("ERR_4XX", "ERR_5XX"):
        pages = pages.where(F.col("status_code").between(400, 499) if flag == "ERR_4XX" else F.col("status_code") >= 500)
    return pages


def search_once(pages: DataFrame, stash: Stash, limit: int = 20, offset: int = 0, fields: tuple[str, ...] = PAGE_FIELDS, ended: bool = False, **conditions) -> DataFrame:
    """:func:`search_captures` in one execution: the page of results, on each row with ``total_matched``, ``pages_read`` and
    ``pages_failed`` as they were observed on the way.

    Captured pages are read, extracted and counted once. No match gives no rows.
    """
    snapshot, read = observed(extract_records(prefiltered(pages, conditions), ("seo",), ended=ended), F.count(F.lit(1)).alias("pages_read"), F.count_if(F.size("errors") > 0).alias("pages_failed"))
    found, matched = observed(filter_pages(project_pages(snapshot), **conditions), F.count(F.lit(1)).alias("total_matched"))
    page = stash.put(page_of(found, limit, offset).select(*fields), "page")
    return page.select("*", *(F.lit(v).cast("long").alias(name) for name, v in (matched.get | read.get).items()))


def filter_sitemap(entries: DataFrame, url_pattern: str = "", modified_after: str = "") -> DataFrame:
    """An entry without a date passes the date test, one with an unreadable date fails it."""
    if url_pattern:
        entries = entries.where(F.col("url").contains(url_pattern))
    if modified_after:
        when = F.try_to_timestamp(F.col("lastmod"))
        bound = F.try_to_timestamp(F.lit(modified_after))
        dated = F.coalesce(F.col("lastmod"), F.lit("")) != ""
        entries = entries.where(~dated | (when.isNotNull() & F.coalesce(when >= bound, F.lit(True))))
    return entries


def json_rows(rows: DataFrame) -> DataFrame:
    """Each row as one JSON object, absent values included, under the name ``value``."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def pipe_table(rows: DataFrame, limit: int = 100) -> str:
    """A small result as text: a header and one line per row, cells parted by bars, arrays by commas."""
    found = rows.limit(limit).collect()
    if not found:
        return "(no results)"
    cell = lambda v: "" if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v)
    return "\n".join([" | ".join(rows.columns), *(" | ".join(cell(v) for v in r) for r in found)])
