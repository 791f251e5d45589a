"""Links, deep and wrapped pages: what an operator must not leave out."""

import os
import re
from collections import Counter

import duckdb
import pytest

from webloom.functions.page_tree import PageTree
from webloom.llm import catalog
from webloom.llm.main_text import main_text
from webloom.llm.ngram_join import count_links, similar_links

DATA = "/root/testdata/sf0.001"


def test_links_inside_components(spark):
    base = [f"w{k}" for k in range(200)]
    # a chain, a triangle, a group large enough for several blocks, and copies of equal sets
    texts = [" ".join(base[k * 15 : k * 15 + 100]) for k in range(3)]
    texts += [" ".join([*(f"t{k}" for k in range(90)), f"end{j}"]) for j in range(3)]
    texts += [" ".join([f"s{j}" if k == j else f"g{k}" for k in range(150)]) for j in range(0, 150, 2)]
    texts += [texts[0], texts[3].upper(), "", "alone", None]
    sets = [{tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := (t or "").lower().split()) else set() for t in texts]
    percent = 70
    linked = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if sets[a] != sets[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = count_links(docs, size=2, percent=percent).collect()
    want = {a: len({frozenset(sets[b]) for x, b in linked if x == a}) for a in range(len(sets))}
    assert {r["doc_id"]: r["n_links"] for r in got} == want
    assert (want[0], want[1], want[3], want[4]) == (1, 2, 2, 2)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component_id"], {})[frozenset(sets[r["doc_id"]])] = r["n_links"]
    assert {r["component_id"]: r["component_links"] for r in got} == {c: sum(v.values()) // 2 for c, v in by_component.items()}
    least = {frozenset(s): min(k for k, u in enumerate(sets) if u == s) for s in sets}
    pairs = {tuple(sorted((least[frozenset(sets[a])], least[frozenset(sets[b])]))) for a, b in linked}
    assert Counter(tuple(r) for r in similar_links(docs, size=2, percent=percent).collect()) == Counter(pairs)
    assert count_links(docs.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_join_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(catalog.oracle_sql()["op1_join_similar"]).fetchall()
    assert sorted(map(tuple, catalog.op1_join_similar(spark, DATA).collect())) == sorted(want)


@pytest.mark.parametrize("tag", ["font", "b", "span", "div"])
def test_deep_pages(tag):
    deep = f"<{tag}>" * 3000
    page = PageTree(f"<body>{deep}<script>var x = 1;</script><nav>Menu</nav><h2>Head</h2><a href=/x>link</a><p>Words of text</p>")
    assert (len(page.named(tag)), len(page.named("script")), len(page.named("nav")), len(page.named("h2")), len(page.named("a"))) == (3000, 1, 1, 1, 1)
    text = main_text(f"<body>{deep}<script>var x = 1;</script><nav>Menu</nav><p>Words of text, of some length, to be kept</p>")
    assert "Words of text" in text and "var x" not in text and "Menu" not in text
    # an end tag ends the inner element, not an outer one of the same name
    page = PageTree(f"<form id=outer>{deep}<form id=inner>one</form>two")
    outer, inner = page.named("form")
    assert "two" in page.text(outer) and page.text(inner) == "one"


def test_wrapped_pages():
    article = "<h1>Title</h1><p>First, this is a paragraph of some length.</p><p>Second, this is a longer paragraph, with commas.</p>"
    want = "Title First, this is a paragraph of some length. Second, this is a longer paragraph, with commas."
    around = "<nav><a href=/>Home</a></nav>{}<footer>f</footer>"
    for start, end in (("<form>", "</form>"), ("<form><article>", "</article></form>"), ("<div role=form>", "</div>"), ("<div class='content has-sidebar'>", "</div>"), ("<div class='site with-header'>", "</div>")):
        assert main_text(f"<body>{start}{around.format(f'<div id=x>{article}</div>')}{end}</body>") == want
    # a small form and comments still go, even long ones
    comments = "<div class=comments>" + "<p>Nice, very nice, truly nice post.</p>" * 9 + "</div>"
    assert main_text(f"<body><div id=content>{article}</div><form><p>Your mail, please, for our news.</p></form>{comments}</body>") == want
    # nothing else is there
    assert main_text("<body><div class=comments><p>Nice, very nice, truly nice post.</p></div></body>") == "Nice, very nice, truly nice post."


def marked(k, n=30):
    return "<p>" + " ".join(f"w{k}x{j}" for j in range(n)) + ".</p>"


SPLIT_PAGES = {
    "rows": "".join(f"<div class=row><div class=col>{marked(k)}</div></div>" for k in range(4)),
    "short row": "".join(f"<div class=row><div class=col>{marked(k, n)}</div></div>" for k, n in ((0, 80), (1, 5), (2, 60))),
    "no names": "".join(f"<div><div>{marked(k)}</div></div>" for k in range(5)),
    "layout table": "<table>" + "".join(f"<tr><td>{marked(k)}</td></tr>" for k in range(2)) + "</table>",
    "articles": "<main>" + "".join(f"<article>{marked(k)}</article>" for k in range(3)) + "</main>",
    "sections": "<div>" + "".join(f"<section><h2>w{k}head</h2>{marked(k, 30 + 10 * k)}{marked(k + 10, 40)}</section>" for k in range(3)) + "</div>",
    "tabs": "<div class=tabs>" + "".join(f"<div class=tab-pane><div>{marked(k)}</div></div>" for k in range(3)) + "</div>",
    "deep": "<div><div>" + "".join(f"<div><div><div>{marked(k)}{marked(k + 5, 20)}</div></div></div>" for k in range(3)) + "</div></div>",
    "formula": "<div><p>w0x0 <math><mi>w0x1</mi></math> w0x2 <code>w0x3</code> " + " ".join(f"w0x{k}" for k in range(4, 30)) + "</p></div>",
}


@pytest.mark.parametrize("name", SPLIT_PAGES)
@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><div>{}</div></body>", "<body><div id=wrap><div>{}</div></div></body>"])
def test_split_articles(name, around):
    beside = "<nav><a href=/>Home</a> <a href=/b>About us</a></nav>{}<div class=sidebar><p>Beside the text, some words, of course.</p></div><div class=comments><p>Nice, very nice, truly nice post.</p></div><footer><p>All rights</p></footer>"
    html = around.format(beside.format(SPLIT_PAGES[name]))
    text = main_text(html)
    assert set(re.findall(r"w\d+(?:x\d+|head)", text)) == set(re.findall(r"w\d+(?:x\d+|head)", html))
    places = [int(m) for m in re.findall(r"w(\d+)x0\b", text)]
    assert places == [int(m) for m in re.findall(r"w(\d+)x0\b", html)]
    assert not re.search("Home|About|Beside|Nice|rights", text)


def test_unlike_neighbours():
    """A short closing line, and teasers of other texts, are no part of it."""
    text = main_text(f"<body><div><div>{marked(0, 80)}{marked(1, 80)}</div></div><div><p>Copyright all of us here.</p></div><div><article><a href=/x>Another story of the day</a></article></div></body>")
    assert "w1x79" in text and "Copyright" not in text and "Another" not in text
