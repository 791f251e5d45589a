"""Extraction over page tables: one Arrow pass per page, whatever the number of extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom import model
from webloom.functions import extract
from webloom.functions.page_tree import ended_only


#: Rows whose records are held as Python objects at a time.
PIECE = 200


def per_page(pages: DataFrame, columns: dict[str, str], compute: Callable[[str, str], dict], url: str = "url", html: str = "html") -> DataFrame:
    """Replaces the html column by computed columns (name to DDL type), row by row of Arrow batches, a piece of a batch at a time."""
    kept = [c for c in pages.columns if c != html and c not in columns]
    fields = [pages.schema[c] for c in kept] + [T.StructField(name, T._parse_datatype_string(ddl)) for name, ddl in columns.items()]
    schema = T.StructType(fields)
    added = to_arrow_schema(T.StructType(fields[len(kept) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            rows = [compute(u, h) for u, h in zip(batch[url].to_pylist(), batch[html].to_pylist(), strict=True)]
            made = pa.RecordBatch.from_pylist(rows, schema=added)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *made.columns], names=[*kept, *columns])

    return pages.select(*dict.fromkeys([*kept, url, html])).mapInArrow(run, schema)


def decoder(ended: bool) -> Callable[[str], str]:
    return ended_only if ended else unescape


def extract_records(
    pages: DataFrame, records: tuple[str, ...] = tuple(extract.EXTRACTORS), more: dict[str, tuple[str, extract.Extractor]] | None = None, url: str = "url", html: str = "html", ended: bool = False
) -> DataFrame:
    """Adds a struct column per record, and ``errors``: the names of extractors that raised on the page.

    ``more`` registers extractors of one's own: name to (DDL type, function). A null page has null records.
    With ``ended``, references count only with their semicolon, so that what is cut off stays as it is written, and paragraphs are
    measured as they are written; else as in browsers.
    """
    chosen = {name: (model.RECORDS[name], extract.EXTRACTORS[name]) for name in records} | (more or {})

    def compute(u: str | None, h: str | None) -> dict:
        out: dict = {"errors": []}
        if h is None:
            return out
        page = extract.Page(u or "", h, decoder(ended), ended)
        for name, (_, f) in chosen.items():
            try:
                out[name] = f(page)
            except Exception:  # one extractor's failure on one page leaves the others' records
                out["errors"].append(name)
        return out

    return per_page(pages, {name: ddl for name, (ddl, _) in chosen.items()} | {"errors": "array<string>"}, compute, url, html)


def extract_client_pages(pages: DataFrame, url: str = "url", html: str = "html", ended: bool = False) -> DataFrame:
    """The client-side record set of {url, html} rows."""
    return per_page(pages, model.CLIENT, lambda u, h: extract.client_snapshot(extract.Page(u or "", h or "", decoder(ended), ended)), url, html)


def read_articles(pages: DataFrame, max_chars: int = 3000, raw_html: bool = False, url: str = "url", html: str = "html", ended: bool = False) -> DataFrame:
    """Adds ``article``: the readable text of each page and what describes it."""
    return per_page(pages, {"article": model.ARTICLE}, lambda u, h: {"article": extract.article(extract.Page(u or "", h or "", decoder(ended), ended), max_chars, raw_html)}, url, html)


def discover_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds ``targets``: followable link targets in normal form."""
    return per_page(pages, {"targets": "array<string>"}, lambda u, h: {"targets": extract.discovered_links(extract.Page(u or "", h or ""))}, url, html)


def explode_links(snapshot: DataFrame, side: str = "internal") -> DataFrame:
    """(ord, url, pos, href, anchor, rel) of all links of one side."""
    return snapshot.select("ord", "url", F.posexplode(f"links.{side}").alias("pos", "l")).select("ord", "url", "pos", "l.href", "l.anchor", "l.rel")
