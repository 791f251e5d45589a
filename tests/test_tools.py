from pyspark.sql import functions as F

from webloom import tools
from webloom.operators import search
from webloom.sources import cookies


def test_walk_then_audit(spark):
    e = "https://example.com"
    rows = [
        (e + "/", 200, "text/html", '<title>Home</title><h1>H</h1><a href="/a">a</a><a href="/old">o</a><a href="/secret">s</a><img src="/i.png">', None),
        (e + "/a", 200, "text/html", '<title>A</title><a href="/">home</a><a href="/nowhere">x</a>', None), (e + "/old", 301, "", "", e + "/new"),
        (e + "/new", 200, "text/html", "<title>New</title>", None), (e + "/secret", 200, "text/html", "<title>S</title>", None),
    ]
    store = spark.createDataFrame(rows, "url string, status int, content_type string, html string, location string")
    robots = spark.createDataFrame([("example.com", 200, "User-agent: *\nDisallow: /secret")], "host string, status int, text string")
    got = tools.capture(spark, store, e + "/", robots=robots)
    assert (got["pages_captured"], got["pages_ignored"], got["stopped_reason"]) == (4, 2, "drained")
    assert {tuple(r) for r in got["ignored_breakdown"].collect()} == {("ROBOTS", 1), ("REDIRECT", 1)}
    snap = got["snapshot"].cache()
    assert [(r["url"], r["title"]) for r in got["pages"].orderBy("ord").collect()] == [(e + "/", "Home"), (e + "/a", "A"), (e + "/new", "New"), (e + "/nowhere", "")]
    assert search.json_rows(got["pages"].where("title = 'A'").select("url", "description")).first()[0] == '{"url":"https://example.com/a","description":""}'
    links = tools.analyse_links(snap, e + "/")
    assert links["totals"].first().asDict() == {"page_count": 4, "total_internal_links": 3}
    assert [r["url"] for r in links["orphans"].collect()] == [e + "/new"] and links["sink_count"] == 2
    assert sorted(r["href"] for r in links["broken"].collect()) == [e + "/old", e + "/secret"]
    assert tools.search_manifest(snap, keyword="home", fields=("url", "title"), table=True)["results"] == f"url | title\n{e}/ | Home"
    assert tools.summarise_capture(snap)["total_pages"] == 4
    assert tools.analyse_images(snap)["summary"].first()["total"] == 1
    assert tools.analyse_meta(snap)["summary"].first()["missing_canonical"] == 4
    assert tools.analyse_headings(snap)["missing_h1"].count() == 3 and tools.analyse_schema(snap)["no_schema"].count() == 4
    listed = spark.createDataFrame([(0, e + "/"), (1, e + "/gone")], "ord long, url string")
    gaps = tools.compare_manifests(snap, listed, e, "https://other.com/s.xml")
    assert gaps["warning"] and [r["url"] for r in gaps["in_sitemap_not_captured"].collect()] == [e + "/gone"] and gaps["error"].count() == 1
    assert tools.find_orphans(snap, listed)["orphans_found"] == 1
    seen, counts = tools.observed(snap)
    seen.write.format("noop").mode("overwrite").save()
    assert counts.get == {"rows": 4, "failed": 0}


def test_other_tools(spark):
    pages = spark.createDataFrame([("https://x.com/a", "<title>T</title><article><p>" + "word, " * 20 + "</p></article>")], "url string, html string")
    one = tools.read_page(pages, max_chars=10).first()
    assert (one["title"], one["truncated"], one["content"], one["gated"]) == ("T", True, "word, word", True)
    assert tools.extract_batch(pages).first()["seo"]["title"] == "T"
    assert tools.read_api(spark.createDataFrame([("a", 0, 200, "[1]")], "api string, page_no int, status int, body string"))["results"].count() == 1
    assert tools.read_sitemap(spark.createDataFrame([("<url><loc>a</loc></url>",)], "xml string"), spark.createDataFrame([], "url string, xml string"))["url_count"] == 1
    assert tools.search_queries({"a": {"template": "site:{domain}"}, "b": {"template": "{q}", "variables": ["q"]}}, "e.com") == {"a": "https://www.google.com/search?q=site%3Ae.com&num=10"}
    entries = spark.createDataFrame([(0, "https://e.com/x", "2024-01-01", None, 0.5)], "ord long, url string, lastmod string, changefreq string, priority double")
    assert tools.search_manifest(entries, url_pattern="x")["total_matched"] == 1 and tools.summarise_sitemap(entries)["totals"].first()["total_urls"] == 1


def test_cookies(spark):
    headers = ["a=1; Path=/p; Max-Age=10", "b=2; Expires=Wed, 01 Jan 2020 00:00:00 GMT", "c=3; Max-Age=5; Expires=Wed, 01 Jan 2020 00:00:00 GMT", "junk", "d=x=y"]
    responses = spark.createDataFrame([("https://e.com/", 1_700_000_000_000, headers), ("https://e.com/", 1_700_000_001_000, ["d=new"])], "url string, fetched_ms long, set_cookie array<string>")
    jar = cookies.cookies_of(responses)
    assert {(r["name"], r["value"]) for r in jar.collect()} == {("a", "1"), ("b", "2"), ("c", "3"), ("d", "new")}
    asked = spark.createDataFrame([("https://e.com/p/x", 1_700_000_003_000), ("https://e.com/q", 1_700_000_009_000)], "url string, at_ms long")
    assert {r["url"]: r["cookie"] for r in cookies.cookies_for(asked, jar).collect()} == {"https://e.com/p/x": "a=1; c=3; d=new", "https://e.com/q": "d=new"}
    assert [r[0] for r in spark.range(1, 9).select(cookies.retry_delay_ms(F.col("id"))).collect()][::7] == [1000, 60_000]


def test_parameters_are_checked(spark):
    import pytest

    snap = spark.createDataFrame([(0, "u", 200)], "ord long, url string, status_code int")
    found = spark.createDataFrame([("u", "t", "s")], "url string, title string, snippet string")
    for wrong in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"words": (-1, None)}, {"limit": 5.5}, {"limit": True}, {"limit": "9"}):
        with pytest.raises(ValueError, match=next(iter(wrong))):
            tools.search_manifest(snap, **wrong)
    with pytest.raises(ValueError, match="max_depth must be between 0 and 10, not 11"):
        tools.capture(spark, snap, "https://e.com", max_depth=11)
    with pytest.raises(ValueError, match="neither a capture nor a sitemap"):
        tools.search_manifest(found)
    with pytest.raises(TypeError):
        tools.find_orphans(snap, found, most=1)
    for call in (lambda: tools.read_api(snap, max_items=50_001), lambda: tools.read_sitemap(snap, snap, max_urls=0), lambda: tools.find_orphans(snap, found, limit=501), lambda: tools.analyse_images(snap, top=0)):
        with pytest.raises(ValueError, match="must be between"):
            call()


def test_search_in_sql(spark):
    import pytest

    from webloom import table_functions

    rows = [(k, f"https://e.com/{k}", f"<title>{'t' * (k % 50)} Price{k % 3}</title><h1>h</h1><p>{'word ' * (k % 7)}</p>", 200 if k % 5 else 404, 0, False) for k in range(200)]
    pages = spark.createDataFrame(rows, "ord long, url string, html string, status_code int, depth int, is_duplicate boolean").repartition(5)
    snap = tools.extraction.extract_records(pages, ("seo",))
    search.project_pages(snap).createOrReplaceTempView("pages_of_sql")
    table_functions.register(spark)
    cases = [
        ("keyword => 'PRICE1'", {"keyword": "PRICE1"}, 10, 3), ("has_flag => 'ERR_4XX', least_words => 2", {"has_flag": "ERR_4XX", "words": (2, None)}, 100, 0),
        ("url_pattern => '/1', status_code => 200, most_words => 5", {"url_pattern": "/1", "status_code": 200, "words": (None, 5)}, 7, 30), ("keyword => 'nothing'", {"keyword": "nothing"}, 5, 0),
    ]
    for condition, same, limit, offset in cases:
        got = spark.sql(f"select * from search_page(table(select * from search_rows(table(pages_of_sql), {condition}, keep => {limit + offset})), limit => {limit}, offset => {offset})").collect()
        want, total = search.search_pages(snap, limit, offset, fields=("ord", *search.PAGE_FIELDS), **same)
        assert sorted(r["ord"] for r in got) == [r["ord"] for r in want.collect()]
        assert spark.sql(f"select count(*) from search_rows(table(pages_of_sql), {condition})").first()[0] == total.first()[0]
    for wrong in ("search_page(table(pages_of_sql), limit => 101)", "search_page(table(pages_of_sql), offset => -1)", "search_rows(table(pages_of_sql), least_words => -1)", "search_rows(table(pages_of_sql), keyword => 5)", "search_rows(table(pages_of_sql), sort => 'x')", "search_rows(table(select 1 as ord))"):
        with pytest.raises(Exception, match="limit must be|offset must be|words must be|keyword must be a text|no condition sort|the table lacks url"):
            spark.sql(f"select * from {wrong}").collect()
    spark.catalog.dropTempView("pages_of_sql")
