"""Main-text extraction by tree scoring.

A page becomes a flat tree (nodes in page order, each with its parent). Elements that are boilerplate by what
they are (navigation, scripts, hidden parts) are struck out. Every paragraph passes points for its length and
commas to its ancestors, the full sum to the parent, half to the grandparent, and ever less above; a container's
points are discounted by the share of its text that stands in links. Names of classes and ids only weigh: below a
name like that of boilerplate, paragraphs pass on a part of their points. The container with the most points,
together with those siblings that score or read like text, or the article element around it, is the main text; and so is,
on every level above, what holds paragraphs of like points: other rows, columns, sections or articles of the same text.
Only then do elements with such names go, and none that holds the best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.page_tree import EDGE, PageTree

# Elements, roles and words of class names, in natural order.
STRUCK_TAGS = frozenset((
    "head", "script", "style", "noscript", "template", "svg", "nav", "aside", "footer", "button", "input", "select", "textarea", "title", "iframe", "object",
    "embed", "canvas", "audio", "video", "map", "dialog", "menu", "noembed", "noframes", "datalist", "search",
))
STRUCK_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist"))
#: Words that name what stands beside the text ...
BESIDE_WORDS = frozenset((
    "ad", "ads", "adbox", "adsense", "adslot", "advert", "advertisement", "advertising", "adverts", "adunit", "comment", "comments", "commentlist", "commenting",
    "consent", "cookie", "cookies", "discussion", "disqus", "gdpr", "modal", "notification", "notifications", "overlay", "popup", "popular", "promo", "promoted",
    "promotion", "recommend", "recommended", "recommendations", "related", "replies", "reply", "respond", "responses", "shoutbox", "sponsor", "sponsored", "tagcloud",
    "teaser", "trending",
))
#: ... and what may also name a part of its frame.
FRAME_WORDS = frozenset((
    "alert", "banner", "banners", "breadcrumb", "breadcrumbs", "byline", "copyright", "feedback", "footer", "header", "hidden", "masthead", "menu", "menus", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pager", "pagination", "paywall", "rail", "share", "sharing", "sidebar", "signup", "skip", "social", "subscribe",
    "subscription", "tags", "toolbar", "topbar", "widget", "widgets",
))
#: Words of these that, after a word of the text itself, may as well name the text.
LOOSE_WORDS = frozenset(("popular", "promo", "promoted", "recommended", "related", "teaser", "trending"))
#: Words of a compound name that say nothing of what it holds.
FILLER_WORDS = frozenset((
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "column", "container", "form", "group", "holder", "inner", "item", "items", "left", "link", "links", "list",
    "outer", "panel", "posts", "primary", "right", "row", "secondary", "section", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper",
))
#: First words that tell of a state of the element, not of the element.
STATE_WORDS = frozenset(("has", "is", "js", "no", "not", "show", "with", "without"))
GOOD_WORDS = frozenset(("article", "body", "content", "entry", "main", "page", "post", "story", "text", "blog", "column"))
#: A header of one of these is the head of the text.
HEADED_WORDS = frozenset(("article", "content", "entry", "post", "story"))
#: What part of their points paragraphs pass on below an element with such a name, or in a form.
BESIDE_WEIGHT, FRAME_WEIGHT = 0.02, 0.25
#: The part of the text's points that makes a neighbour on a level above part of the text.
LIKE = 0.25
KEPT_TAGS = frozenset(("html", "body", "main"))
BASE_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "address": -3}
INLINE = frozenset(("p", "span", "b", "i", "em", "strong", "a"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd", "h2", "h3", "h4"))

NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def names_of(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each whole class name and of the id."""
    return [[w.lower() for w in NAME_WORD.findall(name)] for key in ("class", "id") if key in attrs for name in attrs[key].split()]


def name_weight(names: list[list[str]], in_article: bool) -> float:
    """1 for a name that says nothing against an element, less for one of boilerplate: the last word that is no filler decides."""
    weight = 1.0
    for words in names:
        telling = [w for w in words if w not in FILLER_WORDS] or words
        if not telling or telling[0] in STATE_WORDS:
            continue
        last = telling[-1]
        if last in LOOSE_WORDS and telling[0] in GOOD_WORDS:
            weight = min(weight, FRAME_WEIGHT)
        elif last in BESIDE_WORDS or (telling[0] in BESIDE_WORDS and all(w in GOOD_WORDS or w in BESIDE_WORDS for w in telling[1:])):
            weight = min(weight, BESIDE_WEIGHT)
        elif last in FRAME_WORDS and not (last in ("header", "masthead") and (in_article or not HEADED_WORDS.isdisjoint(telling))):
            weight = min(weight, FRAME_WEIGHT)
    return weight


def judge(page: PageTree) -> tuple[list[bool], list[float]]:
    """Which nodes stand in what is boilerplate by element, role or style; and each node's own weight by its name.

    A header around an article or main element stays.
    """
    n = len(page.tag)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i] or page.tag[i] in ("article", "main"):
            holds[page.parent[i]] = True
    inside, out, weight = [False] * n, [False] * n, [1.0] * n
    for i in range(1, n):
        up, tag, attrs = page.parent[i], page.tag[i], page.attrs[i]
        inside[i] = inside[up] or tag in ("article", "main")
        gone = tag in STRUCK_TAGS or (tag == "header" and not (inside[up] or holds[i]))
        if attrs:
            role = attrs.get("role", "").lower()
            inside[i] = inside[i] or role in ("main", "article")
            gone = gone or role in STRUCK_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))
            if tag not in KEPT_TAGS:
                weight[i] = FRAME_WEIGHT if role == "form" else name_weight(names_of(attrs), inside[up])
        if tag == "form":
            weight[i] = min(weight[i], FRAME_WEIGHT)
        out[i] = out[up] or (gone and tag not in KEPT_TAGS)
    return out, weight


def clean(text: str) -> str:
    return " ".join(text.split())


def choose(page: PageTree, out: list[bool], weight: list[float]) -> tuple[list[int], int]:
    """The nodes whose text is the main text, in page order, and the best container."""
    n = len(page.tag)
    size, linked, commas = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    holder = [0] * n  # the nearest element, itself included, that takes points
    passed = [1.0] * n  # the part of its points that a paragraph here passes on
    for i in range(1, n):
        passed[i] = min(passed[page.parent[i]], weight[i])
        holder[i] = holder[page.parent[i]] if page.tag[i] in INLINE else i
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
    for text, i in zip(page.pieces, page.owner, strict=True):
        if text is not EDGE and not out[i]:
            length = len(text.strip())
            size[i] += length
            linked[i] += length if in_link[i] else 0
            commas[i] += text.count(",") + text.count("،") + text.count("、")
    direct = list(size)
    titled = [tag == "h1" and size[i] > 0 for i, tag in enumerate(page.tag)]
    for i in range(n - 1, 0, -1):
        for total in (size, linked, commas):
            total[page.parent[i]] += total[i]
        titled[page.parent[i]] |= titled[i]
    points: dict[int, float] = {}
    raw = [0.0] * n  # points of the paragraphs inside
    for i in range(1, n):
        tag = page.tag[i]
        if out[i] or not size[i] or not (tag in PARAGRAPHS or (tag in ("div", "section", "article", "main") and direct[i] > 0)):
            continue
        own = ((1 + commas[i] if size[i] >= 25 else 0.0) + min(size[i] / 100, 3) * (1 - linked[i] / size[i])) * passed[i]
        raw[i] += own
        up, level = holder[i if tag not in PARAGRAPHS else page.parent[i]], 0
        while up > 0 and level < 6:
            if up not in points:
                good = any(not GOOD_WORDS.isdisjoint(words) for words in names_of(page.attrs[up]))
                points[up] = (BASE_POINTS.get(page.tag[up], 0) + 25 * good) * passed[up] if size[up] else 0
            points[up] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level += 1
            up = holder[page.parent[up]]
    for i in range(n - 1, 0, -1):
        raw[page.parent[i]] += raw[i]
    scores = {i: p * (1 - linked[i] / max(1, size[i])) for i, p in points.items() if page.tag[i] not in ("html",) and not out[i]}
    if not scores:
        return [0], 0
    best = max(scores, key=lambda i: (scores[i], -i))
    up = best
    while up > 0:  # the article around the best container is the unit that authors mark
        if page.tag[up] == "article" or page.attrs[up].get("itemprop") == "articleBody" or page.attrs[up].get("role") == "article":
            return [up, *like_above(page, out, weight, up, size, linked, raw)], best
        up = page.parent[up]
    if page.tag[best] in ("main", "body"):
        return [best], best
    chosen = []
    least = max(10.0, 0.2 * scores[best])
    up = page.parent[best]
    i = up + 1
    while i < page.end[up]:
        reads = page.tag[i] in ("h1", "h2", "h3", "p", "pre", "blockquote") or (titled[i] and i < best)
        like = scores.get(i, 0.0) >= least or (reads and size[i] and linked[i] / size[i] < 0.25)
        if i == best or (not out[i] and weight[i] >= weight[best] and like):
            chosen.append(i)
        i = page.end[i]
    return [*chosen, *like_above(page, out, weight, page.parent[best], size, linked, raw)], best


def like_above(page: PageTree, out: list[bool], weight: list[float], path: int, size: list[int], linked: list[int], raw: list[float]) -> list[int]:
    """On each level above a node that holds the text, the neighbours that hold like text, and what reads like it beside them.

    A neighbour is like the text if its paragraphs have a good part of the text's points, or if it is an element of the
    same kind with the same names.
    """
    found: list[int] = []
    base, own = raw[path], weight[path]
    while path > 0 and page.tag[path] not in KEPT_TAGS:
        up = page.parent[path]
        like, reads = [], []
        i = up + 1
        while i < page.end[up]:
            if i != path and not out[i] and weight[i] >= own and size[i] and linked[i] / size[i] < 0.25:
                same = page.tag[i] == page.tag[path] and page.attrs[path].get("class") and page.attrs[i].get("class") == page.attrs[path]["class"]
                if raw[i] >= LIKE * base or (same and raw[i] > 0):
                    like.append(i)
                elif page.tag[i] in ("h1", "h2", "h3", "p", "pre", "blockquote"):
                    reads.append(i)
            i = page.end[i]
        if like:
            found += like + reads
            base = max(base, *(raw[i] for i in like))
        path, own = up, min(own, weight[up])
    return found


def without_named(page: PageTree, out: list[bool], weight: list[float], held: set[int], limit: float) -> list[bool]:
    """What is struck at last: with the rest, elements whose name weighs less than ``limit``, but none of ``held``."""
    gone = list(out)
    for i in range(1, len(gone)):
        # an article goes only where its name says comment, advert or the like
        named = weight[i] < min(limit, FRAME_WEIGHT if page.tag[i] == "article" else 1.0)
        gone[i] = gone[i] or gone[page.parent[i]] or (named and i not in held)
    return gone


def main_text(source: str | None) -> str:
    """The main text of one page; null, empty and textless pages give empty text."""
    if not source:
        return ""
    page = PageTree(source)
    out, weight = judge(page)
    chosen, best = choose(page, out, weight)
    held, own, up = set(chosen), 1.0, best
    while up > 0:
        held.add(up)
        own = min(own, weight[up])
        up = page.parent[up]

    def text_within(limit: float) -> str:
        gone = without_named(page, out, weight, held, limit)
        texts = []
        for i in sorted(chosen):
            span = range(page.first[i], page.last[i])
            texts.append("".join(" " if page.pieces[k] is EDGE else page.pieces[k] for k in span if page.pieces[k] is EDGE or not gone[page.owner[k]]))
        return clean(" ".join(texts))

    found = text_within(1.0)
    if own < 1:  # the text itself stands below such a name: if most of it would go, only worse names strike
        every = text_within(own)
        found = every if 2 * len(found) < len(every) else found
    return found


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Replaces the html column by the main text; all other columns pass through, whatever their names.

    A page without html has empty text. Repeated rows are extracted each.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: main_text(x if isinstance(x, str) else None)).astype(object)

    extract = F.pandas_udf(run, "string")
    others = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, out)]
    return pages.select(*others, extract(F.col(html_col)).alias(out))
