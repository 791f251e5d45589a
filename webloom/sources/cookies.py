"""Cookies of captured responses: parsing, and which of them a request would carry."""

from __future__ import annotations

from datetime import timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import url_parts


def parse_set_cookie(header: str, now_ms: int) -> dict | None:
    """name, value, path and expiry of one header; a maximal age counts before an expiry date."""
    first, *rest = header.split(";")
    name, mark, value = first.partition("=")
    if not mark or not name.strip():
        return None
    attributes = {k.strip().lower(): v.strip() for k, _, v in (r.partition("=") for r in rest)}
    expires = None
    if attributes.get("max-age", "").lstrip("-").isdigit():
        expires = now_ms + 1000 * int(attributes["max-age"])
    elif "expires" in attributes:
        try:
            when = parsedate_to_datetime(attributes["expires"])
            expires = int((when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000)
        except ValueError:
            expires = None
    return {"name": name.strip(), "value": value.strip(), "path": attributes.get("path") or None, "expires_ms": expires}


def cookies_of(responses: DataFrame) -> DataFrame:
    """(host, name, value, path, expires_ms): the last cookie of each host and name.

    ``responses`` has (url, fetched_ms, set_cookie array<string>).
    """
    kind = "name string, value string, path string, expires_ms long"

    def parse(header: pd.Series, now: pd.Series) -> pd.DataFrame:
        rows = [parse_set_cookie(h, n) or {} for h, n in zip(header, now, strict=True)]
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int64" if c == "expires_ms" else object) for c in ("name", "value", "path", "expires_ms")})

    each = responses.select(url_parts("url")["host"].alias("host"), "fetched_ms", F.posexplode("set_cookie").alias("pos", "header"))
    parsed = each.select("host", "fetched_ms", "pos", F.pandas_udf(parse, kind)("header", "fetched_ms").alias("c")).where("c.name is not null")
    last = parsed.groupBy("host", F.col("c.name").alias("name")).agg(F.max_by("c", F.struct("fetched_ms", "pos")).alias("c"))
    return last.select("host", "name", "c.value", "c.path", "c.expires_ms")


def cookies_for(requests: DataFrame, cookies: DataFrame) -> DataFrame:
    """(url, cookie): the header each request (url, at_ms) would carry, by host, path prefix and expiry."""
    asked = requests.withColumn("p", url_parts("url")).select("url", "at_ms", F.col("p.host").alias("host"), F.col("p.path").alias("at_path"))
    joined = asked.join(cookies, "host").where("(path is null or startswith(at_path, path)) and (expires_ms is null or expires_ms > at_ms)")
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return joined.groupBy("url").agg(F.array_join(F.transform(pairs, lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ").alias("cookie"))


def retry_delay_ms(attempt: Column, base_ms: int = 1000, most_ms: int = 60_000) -> Column:
    """Exponential back-off before the attempt with this number, from 1 on."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt - 1), F.lit(most_ms)).cast("long")
