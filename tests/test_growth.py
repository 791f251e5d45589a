"""Steps whose cost must not outgrow the input."""

from __future__ import annotations

import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from webloom.functions import extract, urls
from webloom.functions.addresses import match_networks
from webloom.functions.page_tree import PageTree
from webloom.operators import audits, comparison, extraction, link_graph
from webloom.sources import manifests
from webloom.streaming import marks


def test_networks_under_many_starts_are_not_broadcast(spark):
    asked = spark.createDataFrame([(1, "10.1.2.3"), (2, "2a00:1::5")], "id long, ip string")
    nets = spark.createDataFrame([("0.0.0.0/0",), ("10.1.0.0/16",), ("2a00::/12",)], "network string")
    found = match_networks(asked, nets).select("id", "network")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "0.0.0.0/0"), (1, "10.1.0.0/16"), (2, "2a00::/12")]


def test_long_pages_are_read_without_their_whole_tree(monkeypatch):
    """Title and tags of a page beyond the limit are those of the whole tree, which is not built for them."""
    body = "<p title='<meta name=author content=no>'>word, <b>big </b> ﻿<br/></p>" * 6
    html = "<!-- <title>no</title> --><META property='og:site_name' content='S &amp; T'><Title>Long&amp;</Title><script>'<title>x'</script>" + body + "<meta name=author content=me>"
    page = extract.Page("https://site.example/", html)
    tree, flat = PageTree(html), PageTree(html, flat=True)
    for tag in ("meta", "title", "script"):
        assert [(tree.attrs[i], tree.text(i)) for i in tree.named(tag)] == [(flat.attrs[i], flat.text(i)) for i in flat.named(tag)]
    expected = extract.collapse(re.sub(r"<[^>]+>", " ", html))
    monkeypatch.setattr(extract, "ARTICLE_LIMIT", 100)
    monkeypatch.setattr(extract.Page, "tree", property(lambda self: pytest.fail("the whole tree of a long page")))
    found = extract.article(page, 50)
    assert (found["title"], found["byline"], found["site_name"], found["length"], found["content"]) == ("Long&", "me", "S & T", len(expected), expected[:50])


def test_long_pages_are_read_whole():
    """A page beyond 3 MiB has the records of a short one: its article, without what stands around it."""
    for n in (7, 700_000):
        html = "<title>T</title><body><nav>menu</nav><article><p>" + "word, " * n + "</p></article><footer>foot</footer></body>"
        page = extract.Page("https://site.example/", html)
        text = ("word, " * n).strip()
        found, seo = extract.article(page, 20), extract.seo(page)
        assert (found["title"], found["length"], found["content"], found["excerpt"]) == ("T", len(text), text[:20], text[:300])
        assert (seo["article_word_count"], seo["word_count"], seo["excerpt"]) == (n, n, text[:300])


def test_paragraphs_within_paragraphs_are_measured_in_one_pass(monkeypatch):
    """No text is joined for each of the elements that it stands in; lengths are those of the joined texts."""
    rnd = random.Random(4)
    for _ in range(200):
        pieces = [rnd.choice(("", " ", "\n ", "a", " b c ", "\xa0", "\t,")) for _ in range(rnd.randrange(8))]
        for blank in (None, " \n\t"):
            spans = extract.Spans(pieces, blank)
            for first in range(len(pieces) + 1):
                for last in range(first, len(pieces) + 1):
                    joined = "".join(pieces[first:last])
                    assert (spans.at[last] - spans.at[first], spans.stripped(first, last)) == (len(joined), len(joined.strip(blank)))
    tree = PageTree("<body>" + "<blockquote>\n" * 2000 + "a text that is long enough, <a>link</a>" + "</blockquote>" * 2000)
    monkeypatch.setattr(PageTree, "text", lambda *a: pytest.fail("a text is joined"))
    assert extract.article_nodes(tree) == (1, set())


class Record(dict):
    """A record that can be counted while it lives."""

    live = 0

    def __init__(self):
        Record.live += 1

    def __del__(self):
        Record.live -= 1


def test_records_of_a_batch_are_made_piece_by_piece(spark):
    """Of 1000 rows in one batch no more than two pieces are held as Python objects."""
    seen = []

    def compute(url, html):
        made = Record()
        made["n"] = html
        seen.append(Record.live)
        return made

    class Pages:
        columns, schema = ["url", "html"], {"url": T.StructField("url", T.StringType())}

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = extraction.per_page(Pages(), {"n": "string"}, compute)
    batch = pa.RecordBatch.from_pydict({"url": ["u"] * 1000, "html": [str(k) for k in range(1000)]})
    assert [n for b in run(iter([batch])) for n in b["n"].to_pylist()] == [str(k) for k in range(1000)]
    assert max(seen) <= 2 * extraction.PIECE


def test_manifests_make_their_rows_once(spark, tmp_path):
    """The count in a manifest's head is taken as the rows are written."""
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    articles = spark.range(0, 20, 1, 2).selectExpr("id as page_id", "named_struct('title', 'T') as article").mapInArrow(counting, "page_id long, article struct<title:string>")
    manifests.save_articles(articles, str(tmp_path / "articles"), "2024-01-01T00:00:00Z")
    assert made.value == 20
    assert spark.read.json(str(tmp_path / "articles" / "meta")).first().asDict() == {"articleCount": 20, "createdAt": "2024-01-01T00:00:00Z", "source": "article"}
    source, rows = manifests.read_saved(spark, str(tmp_path / "articles"))
    assert source == "article" and rows.count() == 20


def test_empty_bodies_share_few_keys():
    """A row with an empty body is no group of its own; the earliest row of several orders is found as by sorting."""
    assert marks.EMPTY_KEYS <= 1024
    rows = pd.DataFrame({"a": [3, 1, 1], "b": ["x", None, "y"]})
    assert (marks.earliest(rows, ["a"]), marks.earliest(rows, ["a", "b"]), marks.earliest(rows, ["b", "a"])) == (1, 2, 0)


def test_references_that_are_cut_off_stay_if_asked(spark):
    """A title cut off inside a reference: as written with ``ended``, else as browsers read it."""
    pages = spark.createDataFrame([(1, "https://site.example/", "<title>a&amp;&lt;b &notin;&ampx; c&#38;&amp</title><h1>d&amp</h1><a href='/x?a&amp=1'>y</a>")], "page_id long, url string, html string")
    for ended, title, h1 in ((True, "a&<b ∉&ampx; c&&amp", "d&amp"), (False, "a&<b ∉&x; c&&", "d&")):
        seo = extraction.extract_records(pages, ("seo",), ended=ended).select("seo.*").first()
        assert (seo["title"], seo["h1"]) == (title, h1)
        assert extraction.read_articles(pages, ended=ended).select("article.title").first()[0] == title
        assert extraction.extract_client_pages(pages, ended=ended).select("seo.title").first()[0] == title


def test_paragraphs_are_measured_as_written_if_asked(spark):
    """A paragraph of 24 characters, 36 with its references as written, is an article with ``ended`` only; white space at its ends never counts."""
    for text, words in (("Von.*** Keitkeitkeit.&amp;&amp;&amp;", (2, 0)), ("Keitkeit kei.&amp; &amp;", (0, 0)), (" \n" * 9 + "Keit&amp;", (0, 0)), ("Von den Keitkeitkeiten, <b>a</b>", (4, 4))):
        pages = spark.createDataFrame([(1, "https://site.example/", f"<body><nav>n</nav><p>b</p><article><p>{text}<br></article></body>")], "page_id long, url string, html string")
        for ended, found in zip((True, False), words, strict=True):
            assert extraction.extract_records(pages, ("seo",), ended=ended).select("seo.article_word_count").first()[0] == found
            content = extract.collapse(("" if found else "b") + text.replace("&amp;", "&").replace("<b>", "").replace("</b>", ""))
            assert extraction.read_articles(pages, ended=ended).select("article.content").first()[0] == content


def test_rows_for_ranks_are_not_sorted_and_need_no_seo(spark):
    """Lists that are ranked afterwards come unsorted, from a snapshot without the record that only gives titles."""
    rows = [(1, "https://e.com/1", "<h1>a</h1><h3>b</h3>", 200, 0, False), (2, "https://e.com/2", "<h1>a</h1>", 200, 1, False)]
    pages = spark.createDataFrame(rows, "ord long, url string, html string, status_code int, depth int, is_duplicate boolean")
    snap = extraction.extract_records(pages, ("headings", "meta", "schema"))
    for made, urls_found in ((audits.heading_rows(snap, "skipped_levels"), ["https://e.com/1"]), (audits.rows_without_schema(snap), ["https://e.com/1", "https://e.com/2"])):
        assert "Sort" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["url"] for r in made.collect()) == urls_found and {r["title"] for r in made.collect()} == {""}
    missing, extra = comparison.sitemap_gaps(snap, snap.where("ord = 1").select("ord", "url"))
    assert missing.count() == 0 and [(r["url"], r["title"]) for r in extra.collect()] == [("https://e.com/2", None)]


def test_plain_links_are_not_parsed(spark, monkeypatch):
    """Plain links of a page are told by pattern, as the parser finds them; the graph needs no title."""
    hrefs = ("/p/2", "/a.b/c-d/", "/", "https://e.com/p/3", "http://h7.example.org/x/1", "/p/2")
    html = "".join(f"<a href='{h}'> x﻿　y </a>" for h in hrefs)
    page = extract.Page("https://e.com/p/1", html)
    expected = [urls.parse(h, page.base) for h in dict.fromkeys(hrefs)]
    monkeypatch.setattr(extract, "parse", lambda *a: pytest.fail("a plain link is parsed"))
    found = extract.links(page)
    assert [x["href"] for x in found["internal"]] == [u.text() for u in expected if u.host == "e.com"] and found["internal"][0]["anchor"] == "x y"
    assert [x["href"] for x in found["external"]] == [u.text() for u in expected if u.host != "e.com"]
    monkeypatch.undo()
    for base in ("https://u@e.com/1", "https://e.com:8443/1", "mailto:x"):
        for h in ("/a/../b", "/a%20b", "//x.y/z", "https://e.com:443/q", "/p/2?a#b", "/p/2", "https://e.com"):
            root = urls.parse(base)
            plain, target = urls.plain_link(h, root), urls.parse(h, root)
            assert plain is None or plain == (target.text(), target.origin), (base, h)
    rows = [(1, "https://e.com/p/1", html, 0, False)]
    pages = spark.createDataFrame(rows, "ord long, url string, html string, depth int, is_duplicate boolean")
    node = link_graph.link_graph(extraction.extract_records(pages, ("links",))).nodes.first()
    assert (node["url"], node["title"], node["out_links"]) == ("https://e.com/p/1", "", 0)
