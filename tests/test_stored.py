"""Stored fetches, page files, streams with marks and metrics, ranks, addresses, JSON values and text functions."""

import base64
import ipaddress
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.functions import addresses, extract, hints, texts
from webloom.operators import search, variants
from webloom.plans.prefix import global_rank
from webloom.plans.tables import Stash
from webloom.sources import stored
from webloom.streaming.ingest import ingest_counted, page_stream
from webloom.streaming.marks import mark_bodies, use_rocksdb


def line(url, status=200, body=b"x", **more):
    return json.dumps({"url": url, "status": status, "body": base64.b64encode(body).decode()} | more)


@pytest.fixture
def captures(tmp_path):
    folder = tmp_path / "captures"
    (folder / "deep").mkdir(parents=True)
    records = [line(f"https://e.com/{k}", (200, 404, 503)[k % 3], b"b" * k, headers={"X-N": k}) for k in range(50)]
    (folder / "a.jsonl").write_text("\n".join(records[:30]) + "\n\n")
    broken = ["{", "[]", "null", '{"url": 5}', '{"url": "u", "status": "many"}', '{"url": "u", "status": 99999}', line("https://e.com/odd", 200).replace('"body": "', '"body": "*'), '{"url": "https://e.com/list", "body": [1]}']
    (folder / "deep" / "b.jsonl").write_text("\n".join([*records[30:], *broken]))
    (folder / "bytes.jsonl").write_bytes(b"\xff\xfe\x00" + line("https://e.com/late").encode() + b"\n" + line("https://e.com/\ud800").encode() + b"\n" + line("https://e.com/none", 0, b"", error="timeout").encode())
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.jsonl").write_text("")
    return str(folder)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_ranges_of_lines(tmp_path, size):
    for data in (b"", b"\n", b"a", b"a\n", b"\n\na\nbcd\n" + b"x" * 30 + b"\nend", b"long" * 20):
        (tmp_path / "f").write_bytes(data)
        got = [x for at in range(0, len(data), size) for x in stored.lines(str(tmp_path / "f"), at, min(at + size, len(data)), block=3)]
        assert [x for x in got if x] == [x for x in data.split(b"\n") if x]


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_stored_fetches(spark, captures, size):
    read = stored.read_fetches(spark, captures, range_bytes=size)
    rows = read.collect()
    good = {r["url"]: r for r in rows if r["error"] is None}
    assert len(good) == 51 and good["https://e.com/7"]["body"] == b"b" * 7 and good["https://e.com/7"]["headers"] == {"x-n": "7"} and good["https://e.com/7"]["status"] == 404
    assert "https://e.com/?" in good
    errors = Counter((r["url"], r["status"], r["error"].split(":")[0]) for r in rows if r["error"] is not None)
    assert errors == Counter({(None, 0, "unreadable record"): 7, ("https://e.com/odd", 0, "unreadable body"): 1, ("https://e.com/list", 0, "unreadable body"): 1, ("https://e.com/none", 0, "timeout"): 1})


def test_pushed_filters(spark, captures, capsys):
    read = stored.read_fetches(spark, captures)
    asked = read.where("status in (404, 0) and url like 'https://e.com/1%' and length(content_type) is null")
    asked.explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters"))
    assert "In(status, [" in pushed and "StringStartsWith(url,https://e.com/1)" in pushed
    assert {r["url"] for r in asked.collect()} == {f"https://e.com/{k}" for k in (1, 10, 13, 16, 19)}
    for condition in ("status = 0", "status >= 500", "url = 'https://e.com/odd'", "url is null", "status < 1 and url > 'https://e.com/l'", "status = 200 and url = 'https://e.com/odd'"):
        every = [r for r in read.collect()]
        want = Counter(r["url"] for r in spark.createDataFrame(every, read.schema).where(condition).collect())
        assert Counter(r["url"] for r in read.where(condition).collect()) == want
    with pytest.raises(Exception, match="FileNotFoundError"):
        stored.read_fetches(spark, captures + "/nowhere").count()


def test_unreadable_file(tmp_path):
    reader = stored.FetchReader(str(tmp_path), 100)
    rows = [r for batch in reader.read(stored.Stretch(str(tmp_path / "gone"), 0, 10)) for r in batch.to_pylist()]
    assert [(r["status"], r["error"], r["url"]) for r in rows] == [(0, "unreadable file: FileNotFoundError", None)]
    again = stored.FetchReader(str(tmp_path), 100)
    again.pushed = [("status", stored.EqualTo, 200)]
    assert list(again.read(stored.Stretch(str(tmp_path / "gone"), 0, 10))) == []


def test_saved_fetches(spark, tmp_path):
    rows = [("https://e.com/é", 200, bytearray(range(256)) * 3), ("https://e.com/n", 0, None)]
    stored.save_fetches(spark.createDataFrame(rows, "url string, status int, body binary"), f"{tmp_path}/out")
    got = {r["url"]: (r["status"], bytes(r["body"])) for r in stored.read_fetches(spark, f"{tmp_path}/out").collect()}
    assert got == {"https://e.com/é": (200, bytes(range(256)) * 3), "https://e.com/n": (0, b"")}


def test_page_files(spark, tmp_path):
    text = "<p>Grüße, “naïve” café</p>"
    cases = {
        "plain": (text.encode(), None, "utf-8", text), "mark": (b"\xef\xbb\xbf" + text.encode(), "text/html; charset=koi8-r", "utf-8", text),
        "wide": (b"\xff\xfe" + text.encode("utf-16-le"), None, "utf-16le", text), "header": (text.encode("cp1252"), "text/html; charset='ISO-8859-1'", "iso-8859-1", text),
        "tag": (b"<meta http-equiv=Content-Type content='text/html; charset=windows-1251'>" + "Привет".encode("cp1251"), None, "windows-1251", "<meta http-equiv=Content-Type content='text/html; charset=windows-1251'>Привет"),
        "unknown": (text.encode(), "text/html; charset=klingon", "klingon", text), "broken": (b"a\xffb\xe2\x82", None, "utf-8", "a�b�"), "jis": ("日本".encode("cp932") + b"\x81", "x; charset=Shift_JIS", "shift_jis", "日本�"),
        "empty": (b"", None, "utf-8", ""),
    }
    rows = spark.createDataFrame([(n, bytearray(b), t) for n, (b, t, _, _) in cases.items()] + [("none", None, None)], "name string, body binary, content_type string")
    for _ in range(2):  # written again, the same files
        written = stored.save_page_files(rows, f"{tmp_path}/pages").collect()
    assert {r["path"].rsplit("/", 1)[1]: r["bytes"] for r in written} == {n: len(b) for n, (b, *_) in cases.items()}
    got = {r["name"]: (r["charset"], r["html"]) for r in stored.read_page_files(spark, f"{tmp_path}/pages", rows).collect()}
    assert got == {n: (c, t) for n, (b, _, c, t) in cases.items() if b}
    with pytest.raises(Exception, match="no file name"):
        stored.save_page_files(spark.createDataFrame([("../x", bytearray(b"y"))], "name string, body binary"), f"{tmp_path}/pages").count()


def test_marks_after_restart(spark, tmp_path):
    use_rocksdb(spark)
    schema = "ord long, html string, captured_at timestamp"
    batches = [[(2, "a", 0), (1, "a", 0), (3, "", 0), (4, None, 0), (5, "b", 0)], [(6, "a", 1), (7, "c", 1), (8, "", 1)], [(9, "c", 2), (10, "b", 2), (11, "d", 2)]]

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        marked = mark_bodies(stream, ["ord"], ["ord"])
        query = marked.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for rows in batches:  # the query ends after each batch and begins again from its checkpoint
        spark.createDataFrame([(i, h, t) for i, h, t in rows], "ord long, html string, t long").select("ord", "html", F.timestamp_seconds("t").alias("captured_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = {r["ord"]: r["is_duplicate"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: False, 9: True, 10: True, 11: False}


def test_marks_forget(spark, tmp_path):
    use_rocksdb(spark)
    for n, second in enumerate((10_000, 10_005, 11_000, 12_000, 12_001)):
        spark.createDataFrame([(n, "a", second)], "ord long, html string, t long").select("ord", "html", F.timestamp_seconds("t").alias("captured_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ord long, html string, captured_at timestamp").parquet(f"{tmp_path}/in")
        marked = mark_bodies(stream, ["ord"], ["ord"], late="1 second", keep_ms=100_000)
        marked.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r["ord"]: r["is_duplicate"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[0] is False and got[1] is True and False in (got[2], got[3]) and got[4] is True


def test_counts_of_one_execution(spark, tmp_path):
    rows = [(k, f"https://e.com/{k}", f"<title>t{k % 3}</title><h1>h</h1>", 200, 0, False) for k in range(30)]
    pages = spark.createDataFrame(rows, "ord long, url string, html string, status_code int, depth int, is_duplicate boolean").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    found = search.search_once(pages.mapInArrow(counted, pages.schema), Stash(spark, "once"), limit=4, offset=2, keyword="t1").collect()
    assert [r["url"] for r in found] == [f"https://e.com/{k}" for k in (7, 10, 13, 16)]
    assert {(r["total_matched"], r["pages_read"], r["pages_failed"]) for r in found} == {(10, 30, 0)}
    assert reads.value == 30


def test_stream_counts(spark, tmp_path):
    def fragile(page):
        raise ValueError("no")

    spark.createDataFrame([(f"u{k}", "<p>x</p>") for k in range(9)], "url string, html string").withColumn("captured_at", F.current_timestamp()).repartition(3).write.parquet(f"{tmp_path}/in")
    got = ingest_counted(page_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/state", ("seo",), {"mine": ("string", fragile)})
    assert got == {"rows": 9, "failed": 9, "failed_seo": 0, "failed_mine": 9}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_global_rank(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.randrange(50), k) for k in range(2000)]
    table = spark.createDataFrame(rows, "a int, b int, piece long").repartition(7)
    got = global_rank(Stash(spark, "rank").put(table), Stash(spark, "rank"), [F.asc_nulls_first("a"), F.desc("b"), F.asc("piece")], "rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(2000))
    assert global_rank(table.where("false"), Stash(spark, "rank"), [F.asc("b")], "rank").count() == 0


ADDRESSES = [
    "10.0.0.1", "9.255.255.255", "11.0.0.0", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.168.1.1", "192.0.2.7", "198.51.100.0", "198.51.101.0", "203.0.113.9", "223.255.255.255", "224.0.0.0",
    "255.255.255.255", "100.63.255.255", "100.64.0.0", "100.127.255.255", "100.128.0.0", "8.8.8.8", "127.0.0.1", "169.254.9.9", "0.0.0.0", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", "localhost", "::", "::1", "fe80::1", "FC00::1",
    "fd12::9", "ff02::1", "2001:db8::1", "2001:0:1::2", "2001::5", "2002:a00:1::", "2606:4700::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::FFFF:0a00:0001", "::ffff:808:808", "::ffff:1:2:3", "::ffff:300.1.1.1", "1::2::3", " 10.0.0.1",
]


def test_private_addresses(spark):
    got = spark.createDataFrame([(a,) for a in ADDRESSES] + [(None,)], "ip string").select("ip", addresses.is_private_address("ip").alias("p")).collect()
    assert {r["ip"]: r["p"] for r in got} == {a: hints.is_private_address(a) for a in ADDRESSES} | {None: None}


def test_address_digits(spark):
    rnd = random.Random(2)
    made = [str(ipaddress.IPv6Address(rnd.choice([rnd.getrandbits(128), rnd.getrandbits(16), rnd.getrandbits(64) << 64, rnd.getrandbits(8) << 60]))) for _ in range(200)]
    odd = ["1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3.4", "64:ff9b::255.255.255.255", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.999", ":::", "1::2::3", "12345::", "g::", "::", ":1", "1:", "1:2:3:4:5:6:7::8"]
    got = {r["ip"]: r["d"] for r in spark.createDataFrame([(a,) for a in made + odd], "ip string").select("ip", addresses.v6_digits(F.col("ip")).alias("d")).collect()}

    def want(ip):
        try:
            return f"{int(ipaddress.IPv6Address(ip)):032x}"
        except ValueError:
            return None

    assert {ip: d for ip, d in got.items()} == {ip: want(ip) for ip in made + odd}


def test_networks(spark):
    rnd = random.Random(3)
    nets = {str(ipaddress.ip_network((rnd.getrandbits(32), bits), strict=False)) for bits in range(0, 33) for _ in range(2)} | {str(ipaddress.ip_network((0x2A << 120 | rnd.getrandbits(40) << 80, bits), strict=False)) for bits in range(8, 129, 3)}
    ips = [str(ipaddress.IPv4Address(rnd.getrandbits(32))) for _ in range(100)] + [str(ipaddress.ip_network(n)[-1]) for n in nets] + [str(ipaddress.ip_network(n)[0]) for n in nets] + ["x", None, "::"]
    got = addresses.match_networks(spark.createDataFrame([(k, ip) for k, ip in enumerate(ips)], "k int, ip string"), spark.createDataFrame([(n,) for n in nets] + [("no/8",)], "network string"))
    want = {(k, ip, n) for k, ip in enumerate(ips) if ip and ip != "x" for n in nets if ipaddress.ip_address(ip) in ipaddress.ip_network(n)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_references(spark):
    cases = {
        "a&#38;b": "a&b", "&#x2F;": "/", "&amp;lt;": "&lt;", "&lt;&gt;&quot;&apos;&amp;": "<>\"'&", "&nbsp;": "&nbsp;", "&": "&", "&&amp;": "&&", "&#0;&#xD800;&#1114112;": "&#0;&#xD800;&#1114112;", "&#x1F600;&#65": "😀&#65",
        "&#99999999;": "&#99999999;", "": "", "no": "no", "&#x10FFFF;": "\U0010ffff", "&;": "&;", "x&amp": "x&amp",
    }
    got = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", texts.decoded(F.col("t")).alias("d")).collect()}
    assert got == cases | {None: None}


def test_text_functions(spark):
    cases = ["", " ", "a", " a  b\n", " a﻿ b ", "x​y", "a b 　c", "tab\tvt\x0bff\x0c", "one two  three "]
    rows = {r["t"]: r for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", texts.collapsed(F.col("t")).alias("c"), texts.trimmed(F.col("t")).alias("s"), texts.word_count(F.col("t")).alias("n")).collect()}
    for t in cases:
        assert rows[t]["c"] == extract.collapse(t) and rows[t]["s"] == extract.trim(t)
        assert rows[t]["n"] == len([w for w in extract.SPACE.split(t) if w])
    assert spark.range(1).select(texts.collapsed(F.lit("\x85 nel"))).first()[0] == "\x85 nel"  # not white space in scripts
    maps = spark.createDataFrame([({"og:title": "a", "og:x": "b"},), ({},), (None,)], "m map<string,string>").select(texts.other_keys(F.col("m"), ("og:title",)).alias("o")).collect()
    assert [r["o"] for r in maps] == [{"og:x": "b"}, {}, None]
    assert "Python" not in spark.range(1).select(texts.decoded(F.lit("a")), texts.collapsed(F.lit("a")))._jdf.queryExecution().executedPlan().toString()


def test_json_values(spark):
    documents = ['{"a": [1, {"b": null}, [], {}], "c": "x", "d.e": 1.5, "f": true}', '"root"', "[[[7]]]", "not json", None, "{}", '{"a": "1"}']

    def leaves(value, path):
        if isinstance(value, dict) and value:
            return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}" if path else k)]
        if isinstance(value, list) and value:
            return [x for k, v in enumerate(value) for x in leaves(v, f"{path}.{k}" if path else str(k))]
        return [(path, value if isinstance(value, str) else None if value is None else json.dumps(value))]

    want = Counter((k, *x) for k, d in enumerate(documents) if d not in (None, "not json") for x in leaves(json.loads(d), ""))
    table = spark.createDataFrame(list(enumerate(documents)), "k int, json string")
    got = variants.flatten_json(table, ["k"], "json")
    assert Counter((r["k"], r["path"], r["value"]) for r in got.collect()) == want
    assert {(r["path"], r["type"]) for r in got.where("k = 0").collect()} >= {("a.0", "BIGINT"), ("a.1.b", "VOID"), ("a.2", "ARRAY"), ("a.3", "OBJECT"), ("f", "BOOLEAN")}
    assert variants.flatten_json(table.where("false"), ["k"], "json").count() == 0
