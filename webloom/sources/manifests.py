"""Capture, sitemap and discovery manifests: JSON files to typed tables and back, within allowed folders."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom import model
from webloom.plans.metrics import observed

# Names in manifest files that differ from ours.
RENAMED = {
    "word_count": "wordCount", "article_word_count": "articleWordCount", "missing_h1": "missingH1", "multiple_h1": "multipleH1", "h1_not_first": "h1NotFirst",
    "skipped_levels": "skippedLevels", "open_graph": "openGraph", "twitter_card": "twitterCard", "alt_status": "altStatus", "from_srcset": "fromSrcset",
    "lazy_loaded": "lazyLoaded", "has_schema": "hasSchema",
}


def inside(path: str, roots: list[str]) -> Path:
    """The path, resolved against the first root; an error if it lies in none of them."""
    for root in roots:
        Path(root).mkdir(parents=True, exist_ok=True)
    found = (Path(path) if Path(path).is_absolute() else Path(roots[0]) / path).resolve()
    if not any(found.is_relative_to(Path(r).resolve()) for r in roots):
        raise PermissionError(f"{path} lies outside the allowed folders")
    return found


def file_type(kind: T.DataType) -> T.DataType:
    """Our type with the field names of manifest files; raw objects are read as variants."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(RENAMED.get(f.name, f.name), T.VariantType() if f.name == "raw" and len(kind) == 2 else file_type(f.dataType)) for f in kind])
    return T.ArrayType(file_type(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def read_source(spark: SparkSession, path: str) -> str:
    """sitemap or discovery, as the file's meta says, or capture if it has pages."""
    schema = "meta struct<source:string>, pages array<struct<depth:int>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select("meta.source", F.col("pages").isNotNull()).first()
    if found is None or found[0] is None:
        raise ValueError("no meta.source in the manifest")
    return "capture" if found[1] else found[0]


def _records(records: dict[str, T.DataType], of) -> list:
    """The record columns of file pages in our types; ``of`` gives a record's column by its name."""
    columns = []
    for name, kind in records.items():
        column = of(name)
        if name == "schema":
            blocks = F.transform(column["blocks"], lambda b: F.struct(b["types"].alias("types"), F.to_json(b["raw"]).alias("raw")))
            column = F.when(column.isNotNull(), F.struct(blocks.alias("blocks"), column["types"].alias("types"), column["hasSchema"].alias("has_schema")))
        columns.append(column.cast(kind).alias(name))
    return columns


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A capture manifest's pages as a snapshot, in file order."""
    records = {name: T._parse_datatype_string(ddl) for name, ddl in model.RECORDS.items()}
    page = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in (("url", "string"), ("statusCode", "int"), ("depth", "int"), ("isDuplicate", "boolean"))] + [T.StructField(f"mcp.{n}", file_type(k)) for n, k in records.items()])
    read = spark.read.schema(T.StructType([T.StructField("pages", T.ArrayType(page))])).option("multiLine", True).json(path)
    p = read.select(F.posexplode("pages").alias("ord", "p"))
    columns = [F.col("ord").cast("long"), F.col("p.url"), F.col("p.statusCode").alias("status_code"), F.col("p.depth"), F.coalesce("p.isDuplicate", F.lit(False)).alias("is_duplicate")]
    return p.select(*columns, *_records(records, lambda n: F.col(f"p.`mcp.{n}`")))


def read_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(ord, ...) entries of a sitemap or discovery manifest."""
    name, entry = ("urls", model.SITEMAP) if kind == "sitemap" else ("results", model.DISCOVERY)
    read = spark.read.schema(f"{name} array<{entry}>").option("multiLine", True).json(path)
    return read.select(F.posexplode(name).alias("ord", "e")).select(F.col("ord").cast("long"), "e.*")


def load(spark: SparkSession, path: str, roots: list[str]) -> tuple[str, DataFrame]:
    """(source, rows) of a manifest within the allowed folders."""
    found = str(inside(path, roots))
    kind = read_source(spark, found)
    if kind == "capture":
        return kind, read_capture(spark, found)
    if kind in ("sitemap", "discovery"):
        return kind, read_list(spark, found, kind)
    raise ValueError(f"unknown manifest source {kind}")


def save_snapshot(snapshot: DataFrame, path: str) -> None:
    """Snapshots are kept as Parquet; nested columns can then be read one by one."""
    snapshot.write.mode("overwrite").parquet(path)


def save_sitemap(entries: DataFrame, path: str, sitemap_url: str, created_at: str, roots: list[str]) -> None:
    """A sitemap manifest as one JSON file, for tools that read such files; rows stream through the driver."""
    target = inside(path, roots)
    with target.open("w") as out:
        head = {"source": "sitemap", "sitemapUrl": sitemap_url, "createdAt": created_at, "urlCount": entries.count()}
        out.write('{"meta": ' + json.dumps(head) + ', "urls": [')
        for k, row in enumerate(entries.orderBy("ord").select(F.to_json(F.struct("url", "lastmod", "changefreq", "priority"))).toLocalIterator()):
            out.write(("," if k else "") + "\n" + row[0])
        out.write("\n]}\n")


def _write(head: DataFrame, rows: DataFrame, path: str) -> None:
    """A manifest as a folder of JSON lines: ``meta`` holds one row, ``rows`` the records, written where they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows")
    head.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/meta")


def _write_counted(head: dict[str, str], counted: str, rows: DataFrame, path: str) -> None:
    """:func:`_write` with a head that tells how many rows there are, counted as they are written: rows are made once."""
    passing, seen = observed(rows, F.count(F.lit(1)).alias(counted))
    passing.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/rows")
    told = rows.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in head.items()), F.lit(seen.get[counted]).cast("long").alias(counted))
    told.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/meta")


def save_capture(snapshot: DataFrame, path: str, seed_url: str, created_at: str) -> None:
    """A snapshot's pages under the field names of manifest files, with ``ord``, in JSON lines."""
    records = [n for n in model.RECORDS if n in snapshot.columns]
    columns = ["ord", "url", F.col("status_code").alias("statusCode"), "depth", F.col("is_duplicate").alias("isDuplicate")]
    for name in records:
        column = F.col(name)
        if name == "schema":
            blocks = F.transform(column["blocks"], lambda b: F.struct(b["types"].alias("types"), F.try_parse_json(b["raw"]).alias("raw")))
            column = F.when(column.isNotNull(), F.struct(blocks.alias("blocks"), column["types"].alias("types"), column["has_schema"].alias("hasSchema")))
            columns.append(column.alias(f"mcp.{name}"))
        else:
            columns.append(column.cast(file_type(T._parse_datatype_string(model.RECORDS[name]))).alias(f"mcp.{name}"))
    _write_counted({"source": "capture", "seedUrl": seed_url, "createdAt": created_at}, "pagesCaptured", snapshot.select(*columns), path)


def save_entries(entries: DataFrame, path: str, sitemap_url: str, created_at: str) -> None:
    """A sitemap's entries (ord, url, lastmod, changefreq, priority) in JSON lines."""
    _write_counted({"source": "sitemap", "sitemapUrl": sitemap_url, "createdAt": created_at}, "urlCount", entries.select("ord", "url", "lastmod", "changefreq", "priority"), path)


def save_results(items: DataFrame, summary: DataFrame, path: str, created_at: str) -> None:
    """Items of paginated responses (api, page_no, pos, item) in JSON lines, the items as objects, with each API's summary."""
    head = summary.select(F.lit("api").alias("source"), F.lit(created_at).alias("createdAt"), *summary.columns)
    _write(head, items.select("api", "page_no", "pos", F.try_parse_json("item").alias("item")), path)


def save_articles(articles: DataFrame, path: str, created_at: str) -> None:
    """Articles of :func:`webloom.operators.extraction.read_articles` in JSON lines, one a page."""
    _write_counted({"source": "article", "createdAt": created_at}, "articleCount", articles.select(*[c for c in articles.columns if c != "article"], "article.*"), path)


def read_saved(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(source, rows) of a folder that one of the writers left; captures come back as snapshots."""
    head = spark.read.schema("source string").json(f"{path}/meta").first()
    source = head["source"] if head is not None else "capture"
    if source == "capture":
        records = {name: T._parse_datatype_string(ddl) for name, ddl in model.RECORDS.items()}
        plain = (("ord", "bigint"), ("url", "string"), ("statusCode", "int"), ("depth", "int"), ("isDuplicate", "boolean"))
        schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in plain] + [T.StructField(f"mcp.{n}", file_type(k)) for n, k in records.items()])
        rows = spark.read.schema(schema).json(f"{path}/rows")
        return source, rows.select("ord", "url", F.col("statusCode").alias("status_code"), "depth", F.coalesce("isDuplicate", F.lit(False)).alias("is_duplicate"), *_records(records, lambda n: F.col(f"`mcp.{n}`")))
    entry = T.StructType([T.StructField("ord", T.LongType()), *T._parse_datatype_string(model.SITEMAP)])
    kinds = {"sitemap": entry, "api": "api string, page_no bigint, pos int, item variant"}  # articles bring their own columns
    return source, (spark.read.schema(kinds[source]) if source in kinds else spark.read).json(f"{path}/rows")
