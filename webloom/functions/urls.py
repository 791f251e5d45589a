"""URLs by the WHATWG rules, and the two normal forms that site audits use.

A parser for http-like and opaque URLs after the URL Standard: base resolution, dot segments, default ports,
IPv4 numbers, lower-cased hosts and percent-encoding. International host names are encoded by Python's IDNA
2003 codec where it accepts them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import parse_qsl, quote_plus

# Default ports, and names of query parameters that carry sessions or campaigns.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
SESSION_NAMES = frozenset(("jsessionid", "phpsessid", "aspsessionid", "sessionid", "sid", "cfid", "cftoken"))
TRACKING_NAMES = frozenset(("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_eid", "msclkid", "dclid", "yclid"))

#: A host of plain names, and a path without dots or escapes: both in their normal form as they stand.
PLAIN_HOST = r"[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*)*"
PLAIN_PATH = r"/(?:[A-Za-z0-9_~][A-Za-z0-9_.~-]*(?:/[A-Za-z0-9_~][A-Za-z0-9_.~-]*)*/?)?"
PLAIN_LINK = re.compile(rf"(https?://{PLAIN_HOST})?{PLAIN_PATH}")
SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")
FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
QUERY_SAFE = "!$&()*+,-./:;=?@[\\]^_`{|}~%"
PATH_SAFE = "!$&'()*+,-./:;=@[\\]^_|~%"
FRAGMENT_SAFE = "!#$%&'()*+,-./:;=?@[\\]^_{|}~"
#: What does not count at the ends of a url, nor inside it.
CONTROLS = "".join(map(chr, range(33)))
BREAKS = dict.fromkeys(map(ord, "\t\n\r"))


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None
    user: str = ""

    @property
    def origin(self) -> str:
        if self.scheme not in DEFAULT_PORTS:
            return "null"
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    def text(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.user + "@" if self.user else "") + self.host + (f":{self.port}" if self.port is not None else "")
        out += self.path
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if self.fragment is not None else "")


def encode(text: str, safe: str) -> str:
    """Percent-encodes what the set does not allow; existing escapes stay as they are."""
    return unsafe(safe).sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text)


@lru_cache(maxsize=64)
def unsafe(safe: str) -> re.Pattern[str]:
    return re.compile(f"[^A-Za-z0-9{re.escape(safe)}]")


def parse_number(part: str) -> int | None:
    try:
        if part[:2] in ("0x", "0X"):
            return int(part[2:] or "0", 16)
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part, 10)
    except ValueError:
        return None


def parse_host(text: str, special: bool) -> str | None:
    """The serialised host, or None if it is none."""
    if text.startswith("["):
        inner = text[1:-1].lower()
        return f"[{compress_ipv6(inner)}]" if text.endswith("]") and compress_ipv6(inner) is not None else None
    if not special:
        return None if re.search(r"[\x00 #/<>?@\[\\\]^|]", text) else encode(text, "!$%&'()*+,-./:;=_~\"`{}")
    text = re.sub(r"%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)
    if not text.isascii():
        try:
            text = ".".join(label.encode("idna").decode() if not label.isascii() else label for label in re.split("[.。．｡]", text))
        except (UnicodeError, ValueError):
            return None
    text = text.lower()
    if not text or FORBIDDEN_HOST.search(text):
        return None
    parts = text.rstrip(".").split(".") if text.endswith(".") and text != "." else text.split(".")
    if parts[-1] and (parts[-1].isdigit() or re.fullmatch(r"0x[0-9a-f]*", parts[-1])):
        numbers = [parse_number(p) if p else None for p in parts]
        if len(numbers) > 4 or any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(n << (8 * (3 - k)) for k, n in enumerate(numbers[:-1]))
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return text


def compress_ipv6(text: str) -> str | None:
    import ipaddress

    try:
        return ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None


def clean_path(segments: list[str]) -> str:
    """Resolves dot segments; a path that ends in one ends in a slash."""
    out: list[str] = []
    for k, segment in enumerate(segments):
        low = segment.lower().replace("%2e", ".")
        last = k == len(segments) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(segment)
    return "/" + "/".join(out)


@lru_cache(maxsize=4096)
def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL that ``text`` names, seen from ``base``; None where the standard fails."""
    text = text.strip(CONTROLS).translate(BREAKS)
    found = SCHEME.match(text)
    scheme = found[1].lower() if found else None
    rest = text[found.end() :] if found else text
    if scheme is None and base is None:
        return None
    fragment = None
    if "#" in rest:
        rest, _, raw = rest.partition("#")
        fragment = encode(raw, FRAGMENT_SAFE)
    if scheme is None or (scheme == base.scheme if base else False) and scheme in DEFAULT_PORTS and not rest.startswith(("/", "\\")):
        if base is None:
            scheme_only = None
        else:
            scheme_only = base.scheme
        if scheme_only is not None:
            scheme = scheme_only
            if base.host is None and not base.path.startswith("/"):
                return replace(base, fragment=fragment) if not rest and fragment is not None else None
            return relative(rest, base, fragment)
    special = scheme in DEFAULT_PORTS
    if special:
        return authority(scheme, rest.lstrip("/\\"), fragment, True)
    if rest.startswith("//"):
        return authority(scheme, rest[2:], fragment, False)
    path, mark, query = rest.partition("?")
    path = clean_path(path[1:].split("/")) if path.startswith("/") else encode(path, PATH_SAFE + " \"<>`{}^#?")
    return Url(scheme, None, None, encode(path, PATH_SAFE + " \"<>`{}"), encode(query, QUERY_SAFE + "'") if mark else None, fragment)


def relative(rest: str, base: Url, fragment: str | None) -> Url | None:
    special = base.scheme in DEFAULT_PORTS
    if special:
        head, mark, query = rest.partition("?")
        rest = head.replace("\\", "/") + mark + query
    if rest.startswith("//"):
        return authority(base.scheme, rest.lstrip("/") if special else rest[2:], fragment, special)
    path, mark, query = rest.partition("?")
    encoded = encode(query, QUERY_SAFE if special else QUERY_SAFE + "'") if mark else None
    if not path:
        return replace(base, query=encoded if mark else base.query, fragment=fragment)
    segments = path[1:].split("/") if path.startswith("/") else base.path[1:].split("/")[:-1] + path.split("/")
    return replace(base, path=clean_path([encode(s, PATH_SAFE) for s in segments]), query=encoded, fragment=fragment)


def authority(scheme: str, rest: str, fragment: str | None, special: bool) -> Url | None:
    cut = re.search(r"[/\\?]" if special else r"[/?]", rest)
    place, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    user, at, place = place.rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    if not found or (special and not found[1]):
        return None
    host = parse_host(found[1], special)
    if host is None and found[1]:
        return None
    port = int(found[2]) if found[2] else None
    if port is not None and port > 65535:
        return None
    if port == DEFAULT_PORTS.get(scheme):
        port = None
    path, mark, query = tail.partition("?")
    if special:
        path = path.replace("\\", "/")
    path = clean_path([encode(s, PATH_SAFE) for s in path[1:].split("/")]) if path or special else ""
    return Url(scheme, host or "", port, path, encode(query, QUERY_SAFE if special else QUERY_SAFE + "'") if mark else None, fragment, encode(user, "!$&'()*+,-.:_~%") if at else "")


def resolve(href: str, base: str | None = None) -> Url | None:
    root = parse(base) if base is not None else None
    return parse(href, root) if base is None or root is not None else None


def plain_link(href: str, base: Url) -> tuple[str, str] | None:
    """(text, origin) of what a plain href names, seen from ``base``, as :func:`parse` finds it; None if it must be parsed."""
    found = PLAIN_LINK.fullmatch(href)
    if found and found[1]:
        return href, found[1]
    return (base.origin + href, base.origin) if found and base.scheme in DEFAULT_PORTS and base.host and not base.user else None


def form_pairs(query: str) -> list[tuple[str, str]]:
    return parse_qsl(query, keep_blank_values=True, encoding="utf-8", errors="replace")


def form_text(pairs: list[tuple[str, str]]) -> str:
    return "&".join(f"{quote_plus(k, safe='*-._').replace('~', '%7E')}={quote_plus(v, safe='*-._').replace('~', '%7E')}" for k, v in pairs)


def link_normal(base: str, href: str | None) -> str | None:
    """The form under which a link is followed, or None if it is not to be followed.

    Resolves, keeps http(s) only, drops fragment, session and campaign parameters, sorts the others by name,
    collapses repeated slashes and drops one trailing slash.
    """
    href = (href or "").strip()
    if not href or href.startswith(("#", "javascript:", "mailto:", "data:", "tel:")):
        return None
    url = resolve(href, base)
    if url is None or url.scheme not in ("http", "https"):
        return None
    query = url.query
    if query is not None:
        kept = [(k, v) for k, v in form_pairs(query) if k.lower() not in SESSION_NAMES | TRACKING_NAMES and not k.lower().startswith("utm_")]
        query = form_text(sorted(kept, key=lambda kv: kv[0].encode("utf-16-be"))) or None
    path = re.sub("/+", "/", url.path)
    return replace(url, path=path[:-1] if len(path) > 1 and path.endswith("/") else path, query=query, fragment=None).text()


def graph_key(text: str | None) -> str | None:
    """The key under which pages and links meet: one trailing slash, fragment and session parameters dropped."""
    if text is None:
        return None
    url = parse(text)
    if url is None:
        return text
    path = url.path[:-1] if url.path != "/" and url.path.endswith("/") else url.path
    query = url.query
    if query:
        pairs = form_pairs(query)
        kept = [(k, v) for k, v in pairs if k.lower() not in SESSION_NAMES]
        if len(kept) < len(pairs):
            query = form_text(kept) or None
    return replace(url, path=path, query=query, fragment=None).text()


def hostname(text: str | None) -> str | None:
    url = parse(text) if text is not None else None
    return url.host if url else None


def without_www(host: str) -> str:
    return host.removeprefix("www.")


def in_domain(text: str, domain: str, subdomains: bool = False) -> bool:
    host, domain = hostname(text), without_www(domain)
    if host is None:
        return False
    host = without_www(host)
    return host == domain or (subdomains and host.endswith("." + domain))


def in_scope(text: str | None, domain: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), subdomains: bool = False) -> bool:
    """Substring patterns: any exclusion loses, an inclusion is needed if there are some, then the domain."""
    if not text or any(p in text for p in exclude) or (include and not any(p in text for p in include)):
        return False
    return in_domain(text, domain, subdomains)


def vault_path(text: str) -> str:
    url = parse(text)
    if url is None:
        return "unknown.md"
    path = url.path[:-1] if url.path != "/" and url.path.endswith("/") else url.path
    return "index.md" if path == "/" else path[1:] + ".md"


def fetch_site(request: str, referrer: str | None) -> str:
    """none, same-origin, same-site (the last two labels agree) or cross-site."""
    if not referrer:
        return "none"
    one, two = parse(request), parse(referrer)
    if one is None or two is None:
        return "cross-site"
    if one.origin == two.origin:
        return "same-origin"
    same = (one.host or "").split(".")[-2:] == (two.host or "").split(".")[-2:]
    return "same-site" if same else "cross-site"
