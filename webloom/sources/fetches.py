"""Captured fetches: body caps, content types, result classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.columns import url_parts
from webloom.functions.hints import robots_pattern, robots_rules


def cap_body(fetches: DataFrame, limit: int = 5 * 1024 * 1024) -> DataFrame:
    """Cuts bodies to ``limit`` bytes; ``truncated`` only if something was cut off."""
    return fetches.withColumn("truncated", F.coalesce(F.octet_length("body") > limit, F.lit(False))).withColumn("body", F.substring("body", 1, limit))


def content_type(raw: Column) -> Column:
    """struct<media, charset>: lower-cased media type; charset utf-8 if none is named."""
    media = F.lower(F.trim(F.split_part(raw, F.lit(";"), F.lit(1))))
    named = F.regexp_extract(raw, r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", 1)
    return F.struct(media.alias("media"), F.when(F.coalesce(named, F.lit("")) == "", "utf-8").otherwise(F.lower(named)).alias("charset"))


def classify(fetches: DataFrame) -> DataFrame:
    """Adds is_ok (2xx), is_redirect (3xx), is_broken (0 or from 400), is_html and is_blocked."""
    s = F.col("status")
    media = content_type(F.coalesce("content_type", F.lit("")))["media"]
    wall = s.isin(403, 503) & F.element_at("headers", "cf-ray").isNotNull()
    return fetches.withColumns({
        "is_ok": s.between(200, 299), "is_redirect": s.between(300, 399), "is_broken": (s == 0) | (s >= 400), "is_html": media == "text/html",
        "is_blocked": F.coalesce(wall, F.lit(False)),
    })


def robots_verdicts(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """(url, allowed): each URL against its host's robots file (host, status, text); no usable file allows all.

    Files are parsed once a host; their rules, as patterns with their lengths, are matched by column functions. Of the
    longest matching rules one that allows wins.
    """
    rule = "array<struct<pattern:string,length:int,allowed:boolean>>"

    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"pattern": robots_pattern(p), "length": len(p), "allowed": ok} for ok, p in robots_rules(t, agent)] for t in texts])

    good = robots.where("status between 200 and 299 and text is not null").groupBy("host").agg(F.min("text").alias("text"))
    rules = good.select("host", F.pandas_udf(parsed, rule)("text").alias("rules"))
    at = url_parts("url")
    asked = urls.select("url", at.alias("at")).select("url", F.col("at.host").alias("host"), F.concat(F.col("at.path"), F.coalesce(F.concat(F.lit("?"), "at.query"), F.lit(""))).alias("path"))
    matching = F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(matching, lambda r: F.struct(r["length"], r["allowed"])))["allowed"]
    return asked.join(rules, "host", "left").select("url", F.coalesce(best, F.lit(True)).alias("allowed"))
