"""Each operator on a table of awkward rows and on an empty one, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.llm import language, quality
from webloom.llm.decontaminate import find_contamination
from webloom.llm.exact_dedup import exact_duplicates, rice_decode, rice_encode
from webloom.llm.main_text import extract_main_text, main_text
from webloom.llm.mixing import mix_sources
from webloom.llm.ngram_join import join_similar
from webloom.llm.private_data import base_spans, find_private_data, spans_text
from webloom.llm.sharding import assign_shards, shard_documents
from webloom.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, h string, th long, row int, place int, value string, size string, shard int, score string"
PROSE = " ".join(f"w{k % 97}x{k % 31}" for k in range(400))
OTHER = " ".join(f"q{k * k % 83}" for k in range(300))


def awkward():
    texts = [
        (1, PROSE), (2, PROSE + " end"), (3, PROSE.upper()), (4, OTHER), (5, " " + PROSE.replace(" ", "\n", 3)), (6, ""), (7, None), (8, " \t\n "), (9, "one"), (10, "one two"),
        (11, "one two"), (12, "One  two"), (13, OTHER + " " + PROSE), (14, "é" * 50 + " ß 日本"), (15, "x " * 60_000), (15, "x " * 60_000), (16, "word\x00zero \x0b\x0c vt"),
        (17, "mail a.b@c.example.com 10.0.0.256 10.0.0.1 +1 (234) 567-890, 4111 1111 1111 1111"), (18, "😀 a@b.co 😀"), (None, "null id"), (19, "y" * 100_000), (20, PROSE), (21, PROSE[:200]),
    ]
    return [(i, t, None if k % 5 == 0 else "en", (None, "b", "a", "Z")[(i or 0) % 4], 0, "x", 1, "h", 5, 6, 7, "v", "s", 1, "z") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rows_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_exact(docs, none):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in awkward()]
    want = Counter()
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        ids = [j for j in same if j is not None]
        least = min(ids) if ids else None
        want[(i, least, len(same), i == least, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got, *got.columns) == want
    assert exact_duplicates(none).count() == 0


def test_rice_round_trip():
    import numpy as np

    for n in (1, 2, 1000):
        values = np.unique(np.random.default_rng(n).integers(0, 1 << 60, n, dtype=np.uint64))
        assert (rice_decode(len(values), *rice_encode(values, 60)) == values).all()


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_similar(docs, none, size, percent):
    rows = [(i, t) for i, t, *_ in awkward()]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if (w := words(lower(t or ""))) else set() for _, t in rows]
    big = 1 << 63
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                component = [component[b] if c == component[a] else c for c in component]
    want = Counter()
    for k, (i, _) in enumerate(rows):
        least = min((rows[j][0] if rows[j][0] is not None else big) for j in range(len(rows)) if component[j] == component[k])
        want[(i, len(sets[k]), None if least == big else least)] += 1
    got = join_similar(docs, size=size, percent=percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert join_similar(none).count() == 0


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2)])
def test_repeats(docs, none, batches, fanout):
    rows = [(i if i is not None else 1 << 63, words(t)) for i, t, *_ in awkward()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(None if i == 1 << 63 else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = remove_repeats(docs, batches=batches, fanout=fanout)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    if batches == 1:
        assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination(spark, docs, none, block_words):
    items = [(1, " ".join(PROSE.split()[50:90]), "x"), (2, "One, two", "y"), (3, "", "z"), (4, None, "w"), (None, OTHER[:150], "v"), (5, "日本", "u"), (1, "zero vt", "t")]
    bench = spark.createDataFrame(items, "item_id long, text string, id string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for name, text, _ in items:
        w = re.findall(pattern, lower(text or ""))
        for k in range(max(1, len(w) - 12)):
            if w:
                windows.setdefault(tuple(w[k : k + 13]), set()).add("null" if name is None else str(name))
    want = Counter()
    for i, t, *_ in awkward():
        w = re.findall(pattern, lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= names
        want[(i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = find_contamination(docs, bench, block_words=block_words)
    assert rows_of(got, "doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated") == want
    spans = {r["doc_id"]: r["spans"] for r in got.where("doc_id in (10, 14)").collect()}
    assert [tuple(s) for s in spans[10]] == [(0, 7)] and [tuple(s) for s in spans[14]] == [(53, 55)]
    assert find_contamination(none, bench).count() == 0
    assert find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_mix(docs, none):
    got = mix_sources(docs).collect()
    sizes = Counter()
    for _, t, _, s, *_ in awkward():
        sizes[s] += len(words(t))
    assert len(got) == len(awkward())
    left, names = dict(sizes), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, rest = {}, 1.5 * sum(sizes.values())
    while left:
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 2 * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        for s in over:
            del left[s]
    by_id = {i: s for i, _, _, s, *_ in awkward()}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - target[by_id[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[by_id[r["doc_id"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.5
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    assert mix_sources(none).count() == 0


def test_mix_of_unequal_sources(spark):
    """Sources far smaller than a slot, beside one that holds nearly all words."""
    rows = [(k, "big " * 20_000, "a") for k in range(20)] + [(100 + k, "one two three", f"s{k:02}") for k in range(20)] + [(200, None, "z"), (201, "x", None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=1 << 10).collect()
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items()) and taken["s00"] == 6 and taken["z"] == 0
    # the schedule spreads the large source over all of itself
    first = sorted(r["first_slot"] for r in got if source[r["doc_id"]] == "a" and r["taken"])
    assert first[0] < 10 and first[-1] > 400


def test_shards(spark, docs, none):
    got = shard_documents(docs).collect()
    assert len(got) == len(awkward())
    by_shard = {}
    for r in got:
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in awkward())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert shard_documents(none).count() == 0


def test_shard_weights(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    even = assign_shards(rows, [1.0] * 40)
    counts = [r["count"] for r in even.groupBy("shard").count().collect()]
    assert len(counts) == 40 and 350 < min(counts) and max(counts) < 660
    heavy = assign_shards(even, [1.0] * 39 + [3.0], out="later")
    moved = heavy.where("shard <> later").select(F.expr("later div 20").alias("region"), "shard", "later").collect()
    # a changed weight moves rows into its own region only, or within it
    assert moved and all(r["region"] == 1 for r in moved)
    grown = assign_shards(even, [1.0] * 41, out="later").where("shard <> later")
    assert {r["later"] for r in grown.collect()} == {40}


@pytest.mark.parametrize(("laid_out", "last"), [(1, 9), (7, 15), (23, 30), (40, 46)])
def test_added_shards(spark, laid_out, last):
    """Every shard that is added takes rows into itself alone, and about its share of them."""
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    for n in range(laid_out, last + 1):
        rows = assign_shards(rows, [1.0] * n, out=f"s{n}", laid_out=laid_out)
    found = rows.collect()
    for n in range(laid_out + 1, last + 1):
        moved = [r[f"s{n}"] for r in found if r[f"s{n}"] != r[f"s{n - 1}"]]
        assert set(moved) == {n - 1} and 0.5 * 4000 / n < len(moved) < 1.7 * 4000 / n


def test_private(docs, none):
    got = {(r["doc_id"]): r for r in find_private_data(docs).collect()}
    assert len(got) == len({i for i, *_ in awkward()})
    assert spans_text([tuple(s) for s in got[17]["spans"] if s["kind"] < 4]) == spans_text(base_spans(awkward()[17][1])) == "email:5:22,ip:34:42,phone:43:59,card:61:80"
    assert got[7]["spans"] == [] and got[18]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert find_private_data(none).count() == 0


def test_main_text(spark):
    html = (
        "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='ad-box'>Buy, buy</div>"
        "<div id=content><h1>Title</h1><p>First &amp; foremost, this is&nbsp;text of some length.<p>Second, longer paragraph with <b>bo</b>ld words, and commas.</div>"
        "<div class=comments><p>Nice, very nice, truly nice post.</p></div><footer>f</footer></body></html>"
    )
    want = "Title First & foremost, this is text of some length. Second, longer paragraph with bold words, and commas."
    assert main_text(html) == want
    rows = [(1, html, "u"), (1, html, "u"), (2, None, None), (3, "", "e"), (4, "just text < here", "p"), (5, "<div>" * 3000 + "deep", "d"), (6, "<p>" + "a, " * 50_000, "l")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in extract_main_text(pages).collect())
    assert got[:5] == [(1, want), (1, want), (2, ""), (3, ""), (4, "just text < here")]
    assert got[5] == (5, "deep") and len(got[6][1]) == 149_999
    assert extract_main_text(pages.where("false")).count() == 0


def test_language(spark, docs, none):
    train = [(k, " ".join(("the and of house green" if k % 2 else "der und das grünes haus").split()[k % 3 :] * 3), "en" if k % 2 else "de") for k in range(60)]
    table = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(True))
    got = {r["text"]: r for r in language.predict(spark.createDataFrame([("the green house",), ("das grüne haus",), ("123 !",), ("",), (None,)], "text string").withColumn("t2", F.col("text")), model).withColumnRenamed("t2", "text").collect()}
    assert got["the green house"]["lang_pred"] == "en" and got["das grüne haus"]["lang_pred"] == "de"
    for odd in ("123 !", "", None):
        assert (got[odd]["lang_pred"], got[odd]["score"], got[odd]["rejected"]) == ("und", 0.0, True)
    found = language.predict(docs, language.fit(docs, F.lit(True)))
    assert found.count() == len(awkward()) and "n" in found.columns
    nothing = language.fit(none, F.lit(True))
    assert language.predict(none, nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, nothing).select("lang_pred").collect()} == {"und"}


def test_quality(spark, docs, none):
    train = [(k, ("Plain prose, with words. And more of them here." if k % 2 else "BUY!! NOW!! BUY!! NOW!! BUY!!"), k % 2) for k in range(60)]
    table = spark.createDataFrame(train, "doc_id long, text string, quality int")
    model = quality.fit(table.drop("quality"), table.select("doc_id", "quality"), F.lit(True))
    new = spark.createDataFrame([(1, "More prose, here. With some words of them."), (2, "NOW!! BUY!! BUY!!"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(new, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] and 0 <= got[3] <= 1
    assert quality.score(docs, model).count() == len(awkward())
    assert quality.score(none, model).count() == 0
    empty = quality.fit(none, table.select("doc_id", "quality"), F.lit(True))
    assert {r["score"] for r in quality.score(new, empty).collect()} == {0.5}
