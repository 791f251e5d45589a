"""HTML as a flat tree: nodes in page order, each with its parent; text pieces in page order."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import cached_property
from html.entities import html5

# HTML element classes, in natural order.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DECODED_RAW = frozenset("textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Blocks whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
#: Start of the first ends open ones of the second, up to an element of the third.
ENDS_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}

TAG = re.compile(r"<(?:!--(?:.*?-->|>)|!--.*|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))", re.S)
#: A text and the plain tag after it, as most are; if the tag's element holds a text only, that and its end too.
PLAIN = re.compile(r"([^<]*+)<(/?)([a-z][a-z0-9]*+)>(?:([^<]*+)</\3>)?+")
#: Elements whose start does more than open them.
SPECIAL = BLOCK | VOID | RAW | frozenset(ENDS_SAME)
#: Elements that a flat reading keeps, and what it passes over: texts and tags that do not begin with such a name.
FLAT = RAW | {"meta"}
PASSED = re.compile(
    rf"[^<]*+(?:</?(?:[a-hj-lo-ru-wyzA-HJ-LO-RU-WYZ]|(?!(?i:{'|'.join(sorted(FLAT))}))[a-zA-Z])(?:[^\s/>\"']*+>|[^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>)[^<]*+)*+"
)
NAME = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?")
#: The piece that stands for the edge of a block or a line break.
EDGE = None


#: A reference to a character, with its semicolon.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def ended_only(text: str) -> str:
    """Decodes references that end with a semicolon; browsers decode some old ones without it too, as ``html.unescape``."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def attributes(raw: str, decode: Callable[[str], str] = html.unescape) -> dict[str, str]:
    """Names in lower case, values decoded; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, value in NAME.findall(raw):
        if value[:1] in "\"'" and len(value) > 1:
            value = value[1:-1]
        out.setdefault(name.lower(), decode(value))
    return out


class PageTree:
    """For node i: ``tag[i]``, ``attrs[i]``, ``parent[i]``; its descendants are i+1..end[i]-1 and its text
    is ``pieces[first[i]:last[i]]``, where ``owner`` names each piece's node and EDGE marks block edges.

    A ``flat`` reading finds the same elements of ``FLAT``, all right below the root, and no others: those nodes and their
    texts do not depend on what is open around them. ``decode`` decodes references in texts and values; ``written`` has the
    pieces that it changed as they stand in the source.
    """

    def __init__(self, source: str, flat: bool = False, decode: Callable[[str], str] = html.unescape) -> None:
        self.decode = decode
        self.tag, self.attrs, self.parent = ["#root"], [{}], [-1]
        self.first, self.last, self.end = [0], [0], [0]
        self.pieces: list[str | None] = []
        self.owner: list[int] = []
        self.written: dict[int, str] = {}
        # where in open_nodes elements of each name stand, and blocks: no look-up walks a deep page's ancestors
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        open_nodes = [0]
        at = 0
        while at < len(source):
            if not flat and (plain := PLAIN.match(source, at)):
                text, end, name, inner = plain.groups()
                if text:
                    self.add_decoded(text, open_nodes[-1])
                if inner is not None and not end and name not in SPECIAL:
                    node = self.make(name, "", open_nodes[-1])
                    if inner:
                        self.add_decoded(inner, node)
                    self.finish(node)
                    at = plain.end()
                    continue
                at = plain.end(3) + 1
                if not end:
                    at = self.open(name, "", open_nodes, source, at)
                elif self.tag[open_nodes[-1]] == name:
                    self.pop_to(len(open_nodes) - 1, open_nodes)
                else:
                    self.close(name, open_nodes)
                continue
            if flat:
                at = PASSED.match(source, at).end()  # type: ignore[union-attr]
            start = source.find("<", at)
            if start < 0:
                start = len(source)
            if start > at:
                self.add_decoded(source[at:start], open_nodes[-1])
            if start == len(source):
                break
            found = TAG.match(source, start)
            if not found:
                self.add("<", open_nodes[-1])
                at = start + 1
                continue
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self.close(name, open_nodes)
            elif not flat or name in FLAT:
                at = self.open(name, found[3] or found[6] or "", open_nodes, source, at)
        while open_nodes:
            self.finish(open_nodes.pop())

    def add(self, text: str | None, node: int) -> None:
        self.pieces.append(text)
        self.owner.append(node)

    def add_decoded(self, source: str, node: int) -> None:
        text = self.decode(source) if "&" in source else source
        if text != source:
            self.written[len(self.pieces)] = source
        self.add(text, node)

    def finish(self, node: int) -> None:
        self.last[node] = len(self.pieces)
        self.end[node] = len(self.tag)

    def pop_to(self, depth: int, open_nodes: list[int]) -> None:
        while len(open_nodes) > depth:
            node = open_nodes.pop()
            self.finish(node)
            self.places[self.tag[node]].pop()
            if self.tag[node] in BLOCK:
                self.blocks.pop()
                self.add(EDGE, open_nodes[-1])

    def innermost(self, *names: str) -> int:
        """The place of the innermost open element of these names; 0 if none is open."""
        return max((self.places[name][-1] for name in names if self.places[name]), default=0)

    def close(self, name: str, open_nodes: list[int]) -> None:
        depth = self.innermost(name)
        if depth and (name in BLOCK or depth > self.innermost("td", "th", "table")):
            self.pop_to(depth, open_nodes)
            return
        if name in ("p", "br"):
            self.add(EDGE, open_nodes[-1])

    def open(self, name: str, raw: str, open_nodes: list[int], source: str, at: int) -> int:
        """Opens a node, after the ends it implies; gives where reading goes on."""
        if name not in SPECIAL:
            self.push(name, raw, open_nodes)
            return at
        if name in ENDS_P and self.blocks and self.tag[open_nodes[self.blocks[-1]]] == "p":
            self.pop_to(self.blocks[-1], open_nodes)
        if name in ENDS_SAME:
            same, within = ENDS_SAME[name]
            edge = self.innermost(*within)
            inner = [places[k] for places in (self.places[tag] for tag in same) if (k := bisect_right(places, edge)) < len(places)]
            if inner:
                self.pop_to(min(inner), open_nodes)
        if name == "body" and self.places["head"]:
            self.close("head", open_nodes)
        if name in BLOCK or name == "br":
            self.add(EDGE, open_nodes[-1])
        if name in VOID:
            self.make(name, raw, open_nodes[-1])
            return at
        if name in RAW:
            node = self.make(name, raw, open_nodes[-1])
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            raw_text = source[at : stop.start() if stop else len(source)]
            (self.add_decoded if name in DECODED_RAW else self.add)(raw_text, node)
            self.finish(node)
            return stop.end() if stop else len(source)
        if name in BLOCK:
            self.blocks.append(len(open_nodes))
        self.push(name, raw, open_nodes)
        return at

    def make(self, name: str, raw: str, parent: int) -> int:
        node, piece = len(self.tag), len(self.pieces)
        self.tag.append(name)
        self.attrs.append(attributes(raw, self.decode) if raw and raw.strip(" \t\n/") else self.attrs[0])  # the root's, which has none
        self.parent.append(parent)
        self.first.append(piece)
        self.last.append(piece)
        self.end.append(node + 1)
        return node

    def push(self, name: str, raw: str, open_nodes: list[int]) -> None:
        self.places[name].append(len(open_nodes))
        open_nodes.append(self.make(name, raw, open_nodes[-1]))

    @cached_property
    def by_tag(self) -> dict[str, list[int]]:
        found: defaultdict[str, list[int]] = defaultdict(list)
        for i, tag in enumerate(self.tag):
            found[tag].append(i)
        return found

    def named(self, *tags: str) -> list[int]:
        if len(tags) == 1:
            return self.by_tag.get(tags[0], [])
        return sorted(i for tag in set(tags) for i in self.by_tag.get(tag, []))

    def text(self, node: int, left_out: frozenset[int] | set[int] = frozenset()) -> str:
        """The text under a node, pieces joined as they are, without that of nodes left out."""
        span = range(self.first[node], self.last[node])
        return "".join(self.pieces[k] for k in span if self.pieces[k] is not EDGE and self.owner[k] not in left_out)

    def below(self, chosen: list[int]) -> set[int]:
        """The nodes chosen and everything under them."""
        found: set[int] = set()
        reach = 0
        for i in sorted(chosen):
            if i >= reach:  # else it is under one before
                reach = self.end[i]
                found.update(range(i, reach))
        return found
