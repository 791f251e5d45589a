import ipaddress

import pytest
from hypothesis import given
from hypothesis import strategies as st

from webloom.functions import extract, hints, urls


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://shop.example/wool/", "socks?size=7", "https://shop.example/wool/socks?size=7"),
        ("https://shop.example/wool/socks", "/silk#top", "https://shop.example/silk"),
        ("https://shop.example/", "//yarn.example/blue", "https://yarn.example/blue"),
        ("https://shop.example/", "cart?SID=9f&item=4&sid=2", "https://shop.example/cart?item=4"),
        ("https://shop.example/", "?z=1&utm_term=knit&fbclid=7&c=3&utm_content=x", "https://shop.example/?c=3&z=1"),
        ("https://shop.example/", "tel:+4912345", None),
        ("https://shop.example/", "  ", None),
        ("https://e.com/a/b/", "../../c/./d//e/", "https://e.com/c/d/e"),
        ("http://E.com:80", "HTTPS://Wool.Example:443/a b?x=ä", "https://wool.example/a%20b?x=%C3%A4"),
        ("https://e.com/x?z=1", "?", "https://e.com/x"),
        ("https://e.com", "//h.com\\p", "https://h.com/p"),
        ("https://e.com/", "http://0x7f.1/", "http://127.0.0.1/"),
        ("https://e.com/", "ftp://e.com/x", None),
        ("https://e.com/", "http://a b/", None),
    ],
)
def test_link_normal(base, href, want):
    assert urls.link_normal(base, href) == want


@given(st.text(alphabet="abz/.?&=#%+ é_-:@\\", max_size=30))
def test_link_normal_is_idempotent(href):
    once = urls.link_normal("https://e.com/d/", href)
    assert once is None or urls.link_normal("https://e.com/", once) == once


@given(st.permutations(["a=1", "b=2", "c=3"]))
def test_parameter_order_does_not_matter(pairs):
    assert urls.link_normal("https://e.com/", "/p?" + "&".join(pairs)) == "https://e.com/p?a=1&b=2&c=3"


def test_graph_key_differs_from_link_form():
    assert urls.graph_key("https://e.com/a/?sid=1&b=2#x") == "https://e.com/a?b=2"
    assert urls.graph_key("https://e.com/a?utm_source=z") == "https://e.com/a?utm_source=z"
    assert urls.graph_key("no url") == "no url" and urls.graph_key(None) is None


def test_scope():
    assert urls.in_scope("https://www.e.com/a", "e.com") and not urls.in_scope("https://s.e.com/", "e.com")
    assert urls.in_scope("https://s.e.com/", "e.com", subdomains=True) and not urls.in_scope("https://notes.com/", "e.com", subdomains=True)
    assert not urls.in_scope("https://e.com/a", "e.com", include=("/b",)) and not urls.in_scope("https://e.com/b/x", "e.com", ("/b",), ("/x",))
    assert not urls.in_scope("", "e.com") and not urls.in_scope("junk", "e.com") and not urls.in_scope("https://o.com/b", "e.com", ("/b",))


def test_site_relations():
    assert urls.fetch_site("https://a.e.com/", None) == "none"
    assert urls.fetch_site("https://a.e.com/x", "https://a.e.com/") == "same-origin"
    assert urls.fetch_site("https://a.e.com/", "https://b.e.com/") == "same-site"
    assert urls.fetch_site("https://a.com/", "https://b.net/") == "cross-site"
    assert [urls.vault_path(u) for u in ("https://e.com/", "https://e.com/p/", "https://e.com/b/1", "x")] == ["index.md", "p.md", "b/1.md", "unknown.md"]


def test_private_addresses():
    """The ends of every network that is named, their neighbours outside, and addresses of the other kind."""
    nets = [ipaddress.ip_network(n) for n in hints.PRIVATE_NETWORKS]
    for net in nets:
        assert hints.is_private_address(str(net[0])) and hints.is_private_address(str(net[-1])) and hints.is_private_address(f"::FFFF:{net[0]}")
        for near in (int(net[0]) - 1, int(net[-1]) + 1):
            if 0 <= near < 1 << 32 and not any(ipaddress.ip_address(near) in n for n in nets):
                assert not hints.is_private_address(str(ipaddress.ip_address(near))) and not hints.is_private_address(f"::ffff:{near >> 16:x}:{near & 65535:x}")
    for text in ("::", "::1", "fc12::5", "fdab::", "fe80::9", "ff05::2", "2002:7f00::", "2001:0:1::", "::ffff:a00:1", "no address", "9.9.9", "300.1.1.1"):
        assert hints.is_private_address(text), text
    assert not hints.is_private_address("2a00:1450:4001::1")


def test_hints_and_templates():
    assert hints.is_search_engine("https://www.google.com/search") and not hints.is_search_engine("https://notgoogle.com")
    assert hints.needs_scripts("https://m.x.com/a") and not hints.needs_scripts("junk")
    assert hints.fetchable("http://e.com") and not hints.fetchable("ftp://e.com")
    assert hints.search_url("site:{domain} {phrase}", "e.com", {"phrase": "a b"}) == "https://www.google.com/search?q=site%3Ae.com%20a%20b&num=10"
    assert hints.search_url("{domain}", "e.com", engine="bing", results=5) == "https://www.bing.com/search?q=e.com&count=5"
    with pytest.raises(ValueError, match="phrase"):
        hints.search_url("{phrase}", "e.com")


def test_robots():
    rules = hints.robots_rules("User-agent: *\nDisallow: /secret/\nAllow: /secret/open$\nDisallow: /*.pdf\n\nUser-agent: bot\nUser-agent: other\nDisallow: /")
    assert not hints.robots_allow(rules, "/secret/page") and hints.robots_allow(rules, "/public") and hints.robots_allow(rules, "/secret/open")
    assert not hints.robots_allow(rules, "/a/b.pdf?x") and not hints.robots_allow(hints.robots_rules("User-agent: bot\nUser-agent: other\nDisallow: /", "Other/1.0"), "/x")
    assert hints.robots_allow(hints.robots_rules(""), "/")


def page(html, url="https://e.com/"):
    return extract.Page(url, html)


def test_extract_page():
    p = page(
        '<html lang=en><head><title> Wool and silk </title><meta content="All of it, by weight" name="description"><meta property="og:title" content="Wool"></head>'
        '<body><h2>Before</h2><h1>Yarns</h1><a href="blue?b=1">Blue <b>yarn</b></a><a rel="ugc" href="https://dye.example/red">Red</a><a href="#top">Top</a></body></html>',
        "https://shop.example/wool/",
    )
    assert extract.headings(p)["counts"] == {"h1": 1, "h2": 1, "h3": 0, "h4": 0, "h5": 0, "h6": 0} and extract.headings(p)["issues"]["h1_not_first"]
    found = extract.links(p)
    assert found["internal"] == [{"href": "https://shop.example/wool/blue?b=1", "anchor": "Blue yarn", "rel": None}] and found["external"][0]["rel"] == "ugc"
    assert extract.meta(p)["open_graph"]["title"] == "Wool"
    assert (extract.seo(p)["title"], extract.seo(p)["h1"], extract.seo(p)["description"]) == ("Wool and silk", "Yarns", "All of it, by weight")


@pytest.mark.parametrize(
    ("levels", "want"),
    [((1, 2, 3), "ffff"), ((2, 1), "fftf"), ((1, 3), "ffft"), ((4,), "tfff"), ((1, 2, 1, 4), "ftft"), ((), "tfff")],
)
def test_heading_issues(levels, want):
    issues = extract.headings(page("".join(f"<h{k}>x</h{k}>" for k in levels)))["issues"]
    assert "".join("ft"[v] for v in issues.values()) == want


def test_words_join_without_separator():
    assert extract.seo(page("<body><nav>menu</nav><ul><li>a</li><li>b</li></ul> c</body>"))["word_count"] == 2
    assert extract.seo(page("<body><p>" + "word, " * 40 + "</p></body>"))["article_word_count"] == 40


def test_links_details():
    html = '<a href="#x">n</a><a href="/p#a" rel="nofollow UGC">  One\n two </a><a href="/p#b">again</a><a href="http://e.com/q">scheme</a><a href="foo:bar">odd</a><a href=" MAILTO:x">m</a>'
    found = extract.links(page(html))
    assert found["internal"] == [{"href": "https://e.com/p", "anchor": "One two", "rel": "ugc"}]
    assert [x["href"] for x in found["external"]] == ["http://e.com/q", "foo:bar"]
    assert extract.links(page("", "https://e.com/")) is None and extract.links(page("<a href=/>x</a>", "junk")) is None


def test_images():
    html = (
        '<img src="/a.png" alt="x" width="100%" height="0" loading="lazy"><img src="/b.png"><img src="/b.png" alt="">'
        '<img srcset="/c.png 1x, /d.png 2x" loading="lazy"><img src="data:image/png;base64,AA">'
    )
    found = extract.images(page(html))
    assert found["counts"] == {"total": 2, "missing": 1, "decorative": 0, "present": 1, "lazy_loaded": 2}
    assert [(x["src"], x["alt_status"], x["width"], x["height"], x["from_srcset"]) for x in found["images"]] == [
        ("https://e.com/a.png", "present", 100, None, False), ("https://e.com/b.png", "missing", None, None, False), ("https://e.com/c.png", "missing", None, None, True)
    ]
    more = extract.images(page('<picture><source srcset="/w.webp 1x"><img data-src="/w.png" alt=" "></picture><source srcset="/no.png">'))
    assert [(x["src"], x["alt_status"]) for x in more["images"]] == [("https://e.com/w.png", "decorative"), ("https://e.com/w.webp", "decorative")]


def test_schema():
    script = '<script type="application/ld+json">{}</script>'
    found = extract.schema(page(script.format('{"@type":"Org","@graph":[{"@type":["A","B"]},{"x":1},[1]]}') + script.format("{bad")))
    assert [b["types"] for b in found["blocks"]] == [["A", "B"], []] and found["types"] == ["A", "B"] and found["has_schema"]
    assert [b["types"] for b in extract.schema(page(script.format('[{"@type":"A"},5,null]')))["blocks"]] == [["A"]]
    assert extract.schema(page("<p>x")) == {"blocks": [], "types": [], "has_schema": False}


def test_meta():
    html = (
        '<link rel="canonical" href="/c?x#y"><meta name="googlebot" content="None, NOARCHIVE"><meta property="og:site_name" content="S"><meta name="og:image" content="i">'
        '<meta name="og:site_name" content="T"><meta property="og:__proto__" content="z"><meta property="og:locale" content="de"><meta name="twitter:card" content="summary">'
        '<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="" href="/x"><meta name="viewport" content="w">'
    )
    m = extract.meta(page(html))
    assert m["canonical"] == "https://e.com/c?x#y" and m["viewport"] == "w"
    assert m["robots"] == {"noindex": True, "nofollow": True, "noarchive": True, "nosnippet": False, "raw": "None, NOARCHIVE"}
    assert m["open_graph"]["siteName"] == "S" and m["open_graph"]["image"] == "i" and m["open_graph"]["extra"] == {"locale": "de"}
    assert m["twitter_card"]["card"] == "summary" and m["hreflang"] == [{"hreflang": "de", "href": "https://e.com/de"}]
    empty = extract.meta(page("<p>x"))
    assert (empty["canonical"], empty["robots"], empty["open_graph"], empty["twitter_card"], empty["hreflang"]) == (None, None, None, None, [])


def test_client_snapshot_and_article():
    html = '<title>T</title><link rel="canonical" href=" /c "><meta property="og:title" content=" O "><meta name="twitter:x" content=""><script type="application/ld+json">{"@type":["A"]}</script><a href="https://e.com/l">l</a>'
    got = extract.client_snapshot(page(html, "junk"))
    assert got["seo"]["canonical"] == "/c" and got["open_graph"] == {"og:title": "O"} and got["schema"][0]["type"] == '["A"]'
    assert got["links"]["internal"] == [] and len(got["links"]["external"]) == 1
    art = extract.article(page('<title>T</title><meta name="author" content="A"><body><article><p>' + "text, " * 50 + "</p></article><noscript>captcha</noscript>"), max_chars=100)
    assert (art["title"], art["byline"], art["truncated"], len(art["content"]), art["length"]) == ("T", "A", True, 100, 299)
    assert art["notes"] == ["captcha", "needs scripts"]


def test_discovered_links_keep_nofollow():
    assert extract.discovered_links(page('<base href="/z/"><a rel=nofollow href="a?utm_x=1">x</a><a href="data:x">d</a><a href="a">y</a>')) == ["https://e.com/a"]


def test_plain_urls_by_pattern(spark):
    """Urls that Spark's functions take, and odd ones beside them, come out as the parser has them."""
    import random
    from itertools import product

    from webloom.functions import columns, urls

    made = ["".join(x) for x in product(("http://", "https://", "HTTP://", "ftp://"), ("a.example", "b.c.d", "1.2.3.4", "a-b.example", "A.example", "a.example:80", "u@a.example", "xn--a.b", "a..b"), ("", "/", "/p", "/p/", "/p//q", "/./p", "/p/../q", "/%41", "/p.html", "/.p"), ("", "?", "?a=1&sid=2", "?b=2"), ("", "#", "#f"))]
    odd = ["", " ", "x", "/p", "https:/a.example/p", "https://a.example/p q", "https://a.example\\p", "https://é.example/", " https://a.example/ ", "https://a.example/p\n", None]
    rnd = random.Random(1)
    cases = [*rnd.sample(made, 600), *odd]
    rows = spark.createDataFrame([(k, u, cases[-k]) for k, u in enumerate(cases)], "k int, u string, b string")
    parts = columns.url_parts("u")
    got = rows.select("u", "b", columns.graph_key_of("u").alias("key"), columns.hostname_of("u").alias("host"), columns.link_normal_of("b", "u").alias("link"), parts.alias("parts"), columns.is_fetchable("u").alias("ok")).collect()
    for r in got:
        url = urls.parse(r["u"]) if r["u"] is not None else None
        assert r["key"] == urls.graph_key(r["u"]) and r["host"] == urls.hostname(r["u"]), r["u"]
        assert r["link"] == (None if r["u"] is None or r["b"] is None else urls.link_normal(r["b"], r["u"])), (r["b"], r["u"])
        want = {} if url is None else {n: getattr(url, n) for n in ("scheme", "host", "port", "path", "query", "fragment", "origin")}
        assert {k: v for k, v in (r["parts"].asDict() if r["parts"] else {}).items() if v is not None} == {k: v for k, v in want.items() if v is not None}, r["u"]
        assert r["ok"] == (url is not None and url.scheme in ("http", "https")), r["u"]
