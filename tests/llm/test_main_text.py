"""Main text of a labelled set of pages: whole articles, and nothing of what stands around them."""

from collections import Counter

import pytest

from webloom.llm.main_text import main_text


def prose(name: str, sentences: int) -> list[str]:
    """Paragraphs of three sentences, every word marked by ``name``."""
    one = lambda k: " ".join(f"{name}{(k * 7 + j * j) % 50}" for j in range(12)).capitalize() + ", " + " ".join(f"{name}{j + k}" for j in range(5)) + "."
    return [" ".join(one(k + d) for d in range(3)) for k in range(0, sentences, 3)]


def paragraphs(name: str, sentences: int) -> str:
    return "".join(f"<p>{p}</p>" for p in prose(name, sentences))


HEAD = "<h1>Word0 title of it</h1>"
TEXT = HEAD + paragraphs("word", 15)
WANT = " ".join(["Word0 title of it", *prose("word", 15)])
NAV = "<nav><ul>" + "".join(f"<li><a href=/{k}>navigate{k}</a></li>" for k in range(9)) + "</ul></nav>"
FOOT = "<footer><p>footing, all of it reserved, here and there.</p></footer>"
SIDE = f"<div class='sidebar'>{paragraphs('siding', 6)}<ul><li><a href=/a>siding link</a></li></ul></div>"
COMMENTS = f"<div id='comments' class='comments-area'><h3>Remarks</h3>{''.join(f'<div class=comment><p>{p}</p></div>' for p in prose('remark', 24))}</div>"
ADVERT = f"<div class='ad-slot'><p>{prose('buying', 3)[0]}</p></div>"
COOKIES = "<div class='cookie-banner'><p>We use cookies, many of them, as you will see, and you agree to it.</p></div>"
FORM = "<form action=/s><p>Search, or sign up, for our letters, as you like it here.</p><input name=q></form>"


def page(*parts: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


PAGES = {
    "article element": page(NAV, SIDE, f"<article>{TEXT}</article>", COMMENTS, FOOT),
    "main element": page(NAV, f"<main>{TEXT}</main>", SIDE, FOOT),
    "plain container": page(NAV, ADVERT, f"<div id=content>{TEXT}</div>", SIDE, COMMENTS, FOOT),
    "nameless container": page(NAV, f"<div>{TEXT}</div>", SIDE, FOOT),
    "sidebar to the left": page(NAV, f"<div class=wrap>{SIDE}<div class=col>{TEXT}</div></div>", FOOT),
    "sidebar inside the article": page(f"<article>{HEAD}{ADVERT}{paragraphs('word', 15)}{SIDE}</article>"),
    "comments inside the article": page(f"<article class='post comments-open'>{TEXT}{COMMENTS}</article>", FOOT),
    "more comments than text": page(f"<div class=entry>{TEXT}</div>", f"<section class=post-comments>{paragraphs('remark', 90)}</section>"),
    "cookies and forms": page(COOKIES, FORM, f"<div class='page-body'>{TEXT}</div>", FORM, FOOT),
    "page in a form": page(f"<form id=aspnet>{NAV}<div id=x>{TEXT}</div>{SIDE}</form>"),
    "article in a form": page(f"<form id=aspnet>{NAV}<article>{TEXT}</article>{FOOT}</form>"),
    "role article": page(NAV, f"<div role=article>{TEXT}</div>", SIDE),
    "header of the entry": page(NAV, f"<div class=post><div class='entry-header'>{HEAD}</div><div class='entry-body'>{paragraphs('word', 15)}</div></div>", FOOT),
    "deep": page(NAV, "<div>" * 1000, f"<div class=comments>{paragraphs('remark', 6)}</div>", f"<div>{TEXT}</div>", "</div>" * 1000),
    "related and social": page(f"<div class=story>{TEXT}<div class='related-posts'>{paragraphs('relate', 6)}</div><div class='social-share'><p>Sharing this, by letter.</p></div></div>"),
    "hidden parts": page(f"<div style='display: none'>{paragraphs('siding', 6)}</div><div hidden>{paragraphs('siding', 3)}</div><div id=t>{TEXT}</div>"),
}
for name in ("content-sidebar-wrap", "content with-sidebar", "has-header content", "entry social-news", "post tags-open", "page-related", "site with-header", "content has-sidebar", "sidebar-layout", "hidden", "modal"):
    PAGES[f"wrapper {name}"] = page(NAV, f"<div class='{name}'>{TEXT}</div>", FOOT)
    PAGES[f"wrapper {name} and sidebar"] = page(NAV, f"<div class='{name}'><div>{TEXT}</div>{SIDE}</div>", FOOT)


@pytest.mark.parametrize("name", PAGES)
def test_labelled_page(name):
    found, want = Counter(main_text(PAGES[name]).split()), Counter(WANT.split())
    assert found, "an article was lost whole"
    shared = (found & want).total()
    assert shared / want.total() == 1, f"recall of words {shared / want.total():.2f}"
    assert shared / found.total() >= 0.98, f"precision of words {shared / found.total():.2f}: {found - want}"


def test_only_what_is_there():
    assert main_text(page(COMMENTS)).startswith("Remarks Remark")
    assert main_text(page("<div class=hidden><p>One small thing, only, but here.</p></div>")) == "One small thing, only, but here."
    assert main_text(page(NAV, FOOT)) == "" and main_text(None) == "" and main_text("") == ""
