"""Predicates on hosts and addresses, search templates, and robots rules."""

from __future__ import annotations

import json
import re
from pathlib import Path
from urllib.parse import quote

from webloom.functions.urls import hostname, parse, without_www

# Search engines, and other sites that show little without scripts.
SEARCH_ENGINES = ("google.com", "bing.com", "duckduckgo.com", "yahoo.com", "baidu.com", "yandex.com")
SCRIPTED_SITES = (*SEARCH_ENGINES, "twitter.com", "x.com", "linkedin.com", "facebook.com", "instagram.com", "reddit.com")
# Private and reserved IPv4 networks, and starts of such IPv6 addresses.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "100.64.0.0/10", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
PRIVATE_STARTS = ("fc", "fd", "fe80", "ff", "2002:", "2001:0", "2001::")


def _value(ip: str) -> int | None:
    parts = ip.split(".")
    if len(parts) != 4 or not all(re.fullmatch(r"\d{1,3}", p) and int(p) < 256 for p in parts):
        return None
    return sum(int(p) << 8 * (3 - k) for k, p in enumerate(parts))


def is_private_address(ip: str) -> bool:
    """Private, loopback, link-local or reserved; what is no address counts as private."""
    low = ip.lower()
    if ":" in low:
        mapped = low.removeprefix("::ffff:")
        if mapped != low:
            pair = re.fullmatch(r"([0-9a-f]{1,4}):([0-9a-f]{1,4})", mapped)
            if "." in mapped:
                return is_private_address(mapped)
            if pair:
                number = int(pair[1], 16) << 16 | int(pair[2], 16)
                return is_private_address(".".join(str(number >> s & 255) for s in (24, 16, 8, 0)))
        return low in ("::", "::1") or low.startswith(PRIVATE_STARTS)
    value = _value(ip)
    if value is None:
        return True
    for network in PRIVATE_NETWORKS:
        start, bits = network.split("/")
        if value >> (32 - int(bits)) == _value(start) >> (32 - int(bits)):
            return True
    return False


def _belongs(url: str, domains: tuple[str, ...]) -> bool:
    host = without_www(hostname(url) or "")
    return bool(host) and any(host == d or host.endswith("." + d) for d in domains)


def is_search_engine(url: str) -> bool:
    return _belongs(url, SEARCH_ENGINES)


def needs_scripts(url: str) -> bool:
    return _belongs(url, SCRIPTED_SITES)


def fetchable(url: str) -> bool:
    """Whether the scheme is http or https."""
    found = parse(url)
    return found is not None and found.scheme in ("http", "https")


def search_url(template: str, domain: str, variables: dict[str, str] | None = None, engine: str = "google", results: int = 10) -> str:
    """Fills a search template and makes the engine's URL; a placeholder without a value is an error."""
    query = template.replace("{domain}", domain)
    for name, value in (variables or {}).items():
        query = query.replace("{" + name + "}", value)
    open_names = re.findall(r"\{[a-z_]+\}", query)
    if open_names:
        raise ValueError(f"no value for {', '.join(open_names)}")
    words = quote(query, safe="!'()*-._~")
    return f"https://www.google.com/search?q={words}&num={results}" if engine == "google" else f"https://www.bing.com/search?q={words}&count={results}"


def load_recipes(path: str | Path) -> dict[str, dict]:
    """Named search templates of a JSON file."""
    return json.loads(Path(path).read_text())["recipes"]


def list_recipes(recipes: dict[str, dict]) -> list[dict]:
    return [{"name": n, "description": r.get("description"), "output_signal": r.get("output_signal"), "has_variables": bool(r.get("variables"))} for n, r in recipes.items()]


def robots_rules(text: str, agent: str = "*") -> list[tuple[bool, str]]:
    """(allowed, pattern) of the group for the agent, else of the group for all (RFC 9309)."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    in_rules = True
    for line in text.splitlines():
        key, mark, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not mark:
            continue
        if key == "user-agent":
            names = [value.lower()] if in_rules else [*names, value.lower()]
            in_rules = False
            for n in names:
                groups.setdefault(n, [])
        elif key in ("allow", "disallow"):
            in_rules = True
            if value:
                for n in names:
                    groups[n].append((key == "allow", value))
    product = agent.lower().split("/")[0]
    return groups.get(product, groups.get("*", []))


def robots_pattern(rule: str) -> str:
    """A rule's path, with its wildcards, as a regular expression from the path's start."""
    return "^" + "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")


def robots_allow(rules: list[tuple[bool, str]], path: str) -> bool:
    """The longest matching pattern decides; of equally long ones an allowing one."""
    best = (-1, True)
    for allowed, pattern in rules:
        if re.match(robots_pattern(pattern), path):
            best = max(best, (len(pattern), allowed))
    return best[1]
