"""Stored fetches as a data source, and files of raw page bytes.

``stored_fetches`` reads folders of JSON lines, one fetch each: url, status, content_type, headers, location, and
the body in base64. A partition is a file or a range of its bytes, so that a large file is read by many tasks. A fetch
backend must never fail: what cannot be read becomes a row of status 0 with the error in it, and the rest is read on.
Filters on url and status are applied to each record before its body is decoded.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

FETCHES = "url string, status int, content_type string, headers map<string,string>, location string, body binary, error string, file string"
#: Bytes of a file that one task reads, and bytes of bodies in one batch.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
ARROW = pa.schema([
    ("url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("location", pa.string()), ("body", pa.binary()),
    ("error", pa.string()), ("file", pa.string()),
])


def save_fetches(fetches: DataFrame, path: str) -> None:
    """Writes fetches (url, status, content_type, headers, location, body) as JSON lines; absent columns stay out."""
    named = [c for c in ("url", "status", "content_type", "headers", "location") if c in fetches.columns]
    fetches.select(F.to_json(F.struct(*named, F.base64("body").alias("body")))).write.text(path)


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at bytes start..stop-1."""

    file: str
    start: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lines(file: str, start: int, stop: int, block: int = 1 << 20) -> Iterator[bytes]:
    """The lines that begin inside the range, whole; a line over its end is read on, one begun before it left out."""
    store, path = opened(file)
    with store.open_input_file(path) as handle:
        at = max(0, start - 1)  # a line begins at start if the byte before is a line's end
        handle.seek(at)
        held, skipping = b"", start > 0
        while True:
            read = handle.read(block)
            held += read
            *whole, held = held.split(b"\n") if read else (held, b"") if held else (b"",)
            for line in whole:
                if skipping:
                    skipping = False
                elif at >= stop:
                    return
                else:
                    yield line
                at += len(line) + 1
            if not read or (at >= stop and not skipping):
                return


def plain(value: object) -> str | None:
    """A value as text that can be stored, null as null."""
    return None if value is None else str(value).encode("utf-8", "replace").decode()


def record_of(line: bytes, wanted: Callable[[str | None, int], bool]) -> dict | None:
    """A line's row, None if the filters leave it out; an unreadable line or body has status 0 and the error."""
    try:
        found = json.loads(line)
        if not isinstance(found, dict) or not isinstance(found.get("url"), str):
            raise ValueError("no fetch")
        url, status = plain(found["url"]), int(found.get("status") or 0)
        if not 0 <= status < 1000:
            raise ValueError("no status")
    except (ValueError, TypeError, OverflowError, RecursionError) as error:
        return {"status": 0, "error": f"unreadable record: {type(error).__name__}"} if wanted(None, 0) else None
    # the body counts where the row is wanted, or would be if its body were unreadable
    as_it_is, as_error = wanted(url, status), wanted(url, 0)
    body = readable(found) if as_it_is or as_error else None
    if body is None:
        return {"url": url, "status": 0, "error": "unreadable body"} if as_error else None
    if not as_it_is:
        return None
    headers = found.get("headers")
    return {
        "url": url, "status": status, "content_type": plain(found.get("content_type")), "location": plain(found.get("location")), "body": body, "error": plain(found.get("error")),
        "headers": [(plain(k).lower(), plain(v)) for k, v in headers.items()] if isinstance(headers, dict) else None,
    }


def readable(found: dict) -> bytes | None:
    try:
        return base64.b64decode("".join((found.get("body") or "").split()), validate=True)  # lines may be broken
    except (binascii.Error, ValueError, AttributeError):
        return None


class StoredFetches(DataSource):
    """``spark.read.format("stored_fetches").load(path)``; option ``range_bytes``: bytes of a file that one task reads.

    A folder that is not there is an error, as for other sources; files in it that cannot be read are rows.
    """

    @classmethod
    def name(cls) -> str:
        return "stored_fetches"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema) -> FetchReader:
        return FetchReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


#: How each pushed filter tests a value that is not null.
TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x),
}


class FetchReader(DataSourceReader):
    """Never raises for a record or a file; every call of :meth:`read` opens and closes a handle of its own, so that any
    number of tasks, and repeated ones, may read at once."""

    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, max(1, range_bytes)
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes filters on url and status; yields the others, which Spark then applies."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) is IsNotNull and column == ("status",):
                continue  # no row lacks it
            if type(f) in TESTS and column in (("url",), ("status",)):
                self.pushed.append((column[0], type(f), f.value))
            else:
                yield f

    def wanted(self, url: str | None, status: int) -> bool:
        values = {"url": url, "status": status}
        return all(values[c] is not None and TESTS[kind](values[c], x) for c, kind, x in self.pushed)

    def partitions(self) -> list[Stretch]:
        store, path = opened(self.path)
        listed = store.get_file_info(fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == fs.FileType.Directory else [store.get_file_info(path)]
        if any(f.type == fs.FileType.NotFound for f in listed):
            raise FileNotFoundError(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else "file://"
        files = sorted((f for f in listed if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        return [Stretch(prefix + f.path, at, min(at + self.range_bytes, f.size)) for f in files for at in range(0, f.size, self.range_bytes)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for row in self.rows(partition):
            held.append(row | {"file": partition.file})
            size += len(row.get("body") or b"") + 256
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)

    def rows(self, partition: Stretch) -> Iterator[dict]:
        try:
            for line in lines(partition.file, partition.start, partition.stop):
                if line.strip():
                    row = record_of(line, self.wanted)
                    if row is not None:
                        yield row
        except OSError as error:
            if self.wanted(None, 0):
                yield {"status": 0, "error": f"unreadable file: {type(error).__name__}"}


def read_fetches(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The fetches stored under a path, with filters pushed down (a setting of the session, which is switched on)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredFetches)
    read = spark.read.format("stored_fetches").option("range_bytes", range_bytes).load(path)
    # Spark asks a source anew only where it has a filter to push; else it would read as for the last filters of another plan
    return read.where(F.col("status").isNotNull())


# Names of charsets as pages give them, and the codec that reads them.
CODECS = {
    "ascii": "cp1252", "big5": "big5hkscs", "cp1252": "cp1252", "euc-jp": "euc_jp", "euc-kr": "cp949", "gb18030": "gb18030", "gb2312": "gb18030", "gbk": "gb18030",
    "iso-8859-1": "cp1252", "iso-8859-2": "iso8859_2", "iso-8859-5": "iso8859_5", "iso-8859-15": "iso8859_15", "koi8-r": "koi8_r", "latin1": "cp1252", "shift_jis": "cp932", "us-ascii": "cp1252",
    "utf-16": "utf_16_le", "utf-16be": "utf_16_be", "utf-16le": "utf_16_le", "windows-1250": "cp1250", "windows-1251": "cp1251", "windows-1252": "cp1252",
}
#: Bytes at the start of a page in which a tag may name its charset.
TAG_BYTES = 1024


def charset_of(body: Column, content_type: Column | None = None) -> Column:
    """The charset of a page's bytes: by its byte-order mark, else its header, else its first meta tags, else utf-8."""
    start = F.hex(F.substring(body, 1, 3))
    mark = F.when(start.startswith("EFBBBF"), "utf-8").when(start.startswith("FFFE"), "utf-16le").when(start.startswith("FEFF"), "utf-16be")
    # ISO-8859-1 has a character for every byte, so that tags can be looked for in any ASCII-like charset
    head = F.decode(F.substring(body, 1, TAG_BYTES), "ISO-8859-1")
    tag = F.regexp_extract(head, r"(?is)<meta[^>]*?charset\s*=\s*[\"']?\s*([^\s;\"'/>]+)", 1)
    named = F.lit("") if content_type is None else F.coalesce(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit(""))
    return F.coalesce(mark, F.when(named != "", F.lower(named)), F.when(tag != "", F.lower(tag)), F.lit("utf-8"))


def body_text(body: Column, charset: Column) -> Column:
    """The text of bytes, without a byte-order mark; bytes that make no character become U+FFFD.

    UTF-8, and every charset that is not known, is read by Spark's own functions; only bodies of other charsets go
    through Python.
    """

    def read(batch: pa.Array, names: pa.Array) -> pa.Array:
        out = [None if b is None else b.decode(CODECS[c], "replace") for b, c in zip(batch.to_pylist(), names.to_pylist(), strict=True)]
        return pa.array(out, pa.string())

    other = F.lower(charset).isin(*CODECS)
    foreign = F.arrow_udf(read, "string")(F.when(other, body), F.lower(charset))
    text = F.when(other, foreign).otherwise(F.make_valid_utf8(body.cast("string")))
    return F.regexp_replace(text, "^\\ufeff", "")


def save_page_files(pages: DataFrame, folder: str, name: str = "name", body: str = "body") -> DataFrame:
    """Writes each row's bytes as a file of its own; one row (path, bytes) for each. A repeated task writes them anew.

    Names must differ and stay inside the folder. A row without a body has no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for n, b in zip(batch[name].to_pylist(), batch[body].to_pylist(), strict=True):
                if n is None or b is None:
                    continue
                if "/" in n or n in ("", ".", ".."):
                    raise ValueError(f"no file name: {n}")
                with store.open_output_stream(f"{root}/{n}") as out:
                    out.write(b)
                done.append({"path": f"{folder}/{n}", "bytes": len(b)})
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return pages.select(name, body).mapInArrow(run, "path string, bytes long")


def read_page_files(spark: SparkSession, folder: str, content_types: DataFrame | None = None) -> DataFrame:
    """(name, charset, html) of a folder of raw pages; ``content_types`` (name, content_type) has headers of some.

    Spark's file scan leaves out files without a byte.
    """
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    typed = files.withColumn("content_type", F.lit(None).cast("string")) if content_types is None else files.join(content_types.select("name", "content_type"), "name", "left")
    return typed.withColumn("charset", charset_of(F.col("content"), F.col("content_type"))).select("name", "charset", body_text(F.col("content"), F.col("charset")).alias("html"))
