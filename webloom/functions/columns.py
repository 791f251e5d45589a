"""Arrow-batched column functions over URLs and numbers."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import hints, urls
from webloom.functions.addresses import is_private_address  # noqa: F401


def mapped(function: Callable, kind: str) -> Callable[[Column | str], Column]:
    """A pandas UDF that applies a function to every distinct non-null value of a batch."""

    def run(values: pd.Series) -> pd.Series:
        known = {v: function(v) for v in values.dropna().unique()}
        return pd.Series([known.get(v) if v is not None else None for v in values], index=values.index, dtype=object)

    # made at the call: a UDF's type is parsed by the session, which may not exist at import
    return lambda column: F.pandas_udf(run, kind)(F.col(column) if isinstance(column, str) else column)


def _parts(text: str) -> dict | None:
    url = urls.parse(text)
    return url and {"scheme": url.scheme, "host": url.host, "port": url.port, "path": url.path, "query": url.query, "fragment": url.fragment, "origin": url.origin}


def _depth(text: str) -> int | None:
    url = urls.parse(text)
    return len([s for s in url.path.split("/") if s]) if url else None


#: A url that is in its normal form as it stands: a host of plain names, no port, no user, no dots or escapes in the path.
PLAIN_HOST, PLAIN_PATH = urls.PLAIN_HOST, urls.PLAIN_PATH
PLAIN_PAGE = rf"\A(https?)://({PLAIN_HOST})({PLAIN_PATH})(?:#[A-Za-z0-9_-]*)?\z"
PLAIN_URL = rf"\A(https?)://({PLAIN_HOST})({PLAIN_PATH})(?:\?([A-Za-z0-9_=&.~-]*))?(?:#([A-Za-z0-9_-]*))?\z"


def column_of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def without_end(url: Column) -> Column:
    """A plain page's url without fragment and without one slash at the end of its path."""
    return F.regexp_replace(F.substring_index(url, "#", 1), r"\A(https?://[^/]+/.+)/\z", "$1")


def graph_key_of(column: Column | str) -> Column:
    """:func:`webloom.functions.urls.graph_key`; plain pages take Spark's own functions, only others are parsed."""
    url = column_of(column)
    plain = url.rlike(PLAIN_PAGE)
    return F.when(plain, without_end(url)).otherwise(_graph_key(F.when(~plain, url)))


def hostname_of(column: Column | str) -> Column:
    """:func:`webloom.functions.urls.hostname`, plain urls by pattern."""
    url = column_of(column)
    plain = url.rlike(PLAIN_URL)
    return F.when(plain, F.regexp_extract(url, PLAIN_URL, 2)).otherwise(_hostname(F.when(~plain, url)))


_graph_key = mapped(urls.graph_key, "string")
_hostname = mapped(urls.hostname, "string")
path_depth = mapped(_depth, "int")
vault_path_of = mapped(urls.vault_path, "string")
to_fixed_1 = mapped(lambda v: str(Decimal(float(v)).quantize(Decimal("0.1"), ROUND_HALF_UP)), "string")


def link_normal_of(base: Column | str, href: Column | str) -> Column:
    """The normal form for following links of each href, seen from its base."""

    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        known: dict[tuple, str | None] = {}
        for pair in zip(bases, hrefs, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else urls.link_normal(*pair)
        return pd.Series([known[pair] for pair in zip(bases, hrefs, strict=True)], dtype=object)

    base, href = column_of(base), column_of(href)
    plain = F.coalesce(href.rlike(PLAIN_PAGE) & base.rlike(PLAIN_URL), F.lit(False))
    return F.when(plain, without_end(href)).otherwise(F.pandas_udf(run, "string")(F.when(~plain, base), F.when(~plain, href)))


def fetch_site_of(request: Column | str, referrer: Column | str) -> Column:
    """none, same-origin, same-site or cross-site, of each request and its referrer; an empty referrer counts as none."""

    def run(requests: pd.Series, referrers: pd.Series) -> pd.Series:
        known: dict[tuple, str] = {}
        for pair in zip(requests, referrers, strict=True):
            if pair not in known:
                known[pair] = urls.fetch_site(*pair) if pair[0] is not None else None
        return pd.Series([known[pair] for pair in zip(requests, referrers, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(request, referrer)


def is_fetchable(column: Column | str) -> Column:
    """Whether a url's scheme is http or https; plain ones are told by their beginning, and only others are parsed."""
    text = F.col(column) if isinstance(column, str) else column
    plain = text.rlike(r"\A(?i:https?)://[a-z]+(\.[a-z]+)*([/?#][!-~]*)?\z")
    return F.when(plain, True).otherwise(F.coalesce(url_parts(F.when(~plain, text))["scheme"].isin("http", "https"), F.lit(False)))


def url_parts(column: Column | str) -> Column:
    """struct<scheme, host, port, path, query, fragment, origin>; plain urls by pattern, others parsed, once for each row."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = [_parts(v) if v is not None else None for v in values]
        names = ("scheme", "host", "port", "path", "query", "fragment", "origin")
        return pd.DataFrame({n: pd.Series([r and r[n] for r in rows], dtype="Int32" if n == "port" else object) for n in names})

    url = column_of(column)
    plain = url.rlike(PLAIN_URL)
    part = lambda k: F.regexp_extract(url, PLAIN_URL, k)
    after = lambda mark, k: F.when(url.contains(mark), part(k))
    found = F.struct(
        part(1).alias("scheme"), part(2).alias("host"), F.lit(None).cast("int").alias("port"), part(3).alias("path"), F.when(F.substring_index(url, "#", 1).contains("?"), part(4)).alias("query"),
        after("#", 5).alias("fragment"), F.concat(part(1), F.lit("://"), part(2)).alias("origin"),
    )
    return F.when(plain, found).otherwise(F.pandas_udf(run, "scheme string, host string, port int, path string, query string, fragment string, origin string")(F.when(~plain, url)))


def belongs_to(host: Column, domains: tuple[str, ...], subdomains: bool = True) -> Column:
    """Whether a host, one www. aside, is one of the domains or, if asked, below one; false for none."""
    bare = F.regexp_replace(host, r"^www\.", "")
    found = F.lit(False)
    for domain in domains:
        found = found | (bare == domain) | (bare.endswith("." + domain) if subdomains else F.lit(False))
    return F.coalesce(found, F.lit(False))


def is_search_engine(url: Column | str) -> Column:
    return belongs_to(hostname_of(url), hints.SEARCH_ENGINES)


def needs_scripts(url: Column | str) -> Column:
    return belongs_to(hostname_of(url), hints.SCRIPTED_SITES)


def in_scope_of(url: Column | str, domain: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), subdomains: bool = False) -> Column:
    """Substring patterns on the text, then the domain of its host, which is all that is parsed."""
    text = F.col(url) if isinstance(url, str) else url
    ok = belongs_to(hostname_of(text), (urls.without_www(domain),), subdomains)
    for pattern in exclude:
        ok = ok & ~text.contains(pattern)
    if include:
        any_of = F.lit(False)
        for pattern in include:
            any_of = any_of | text.contains(pattern)
        ok = ok & any_of
    return F.coalesce(ok, F.lit(False))


def seen_key(column: Column | str) -> Column:
    return F.substring_index(column, "#", 1)
