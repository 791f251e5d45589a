"""Words and runs that a sum of powers would confuse, and an index that a later session goes on with."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webloom.llm.ngram_join import count_links, counters_for
from webloom.llm.substring_dedup import FingerprintIndex, remove_repeats
from webloom.llm.wordhash import BLOCK_BYTES, Runs, pieces, word_blocks


def thue_morse(n, a="a", b="b"):
    return [b if bin(k).count("1") % 2 else a for k in range(n)], [a if bin(k).count("1") % 2 else b for k in range(n)]


def twins():
    """Pairs of different one-word texts, and of texts of two words, that mirror each other."""
    out = []
    for size in (512, 1024, 2048, 4096, 8192):
        one, two = thue_morse(size)
        out += ["".join(one), "".join(two), "".join(one[:-1]) + "x", " ".join(one), " ".join(two)]
    return out


def test_lanes_tell_words_apart():
    texts = twins()
    found = {}
    for block in word_blocks(pa.array(texts)):
        at, lanes, begins = block.at, block.lanes, block.begins
        for k in range(len(begins) - 1):
            assert begins[k + 1] - begins[k] == len(texts[at + k].split())
            for lane in (0, 1):
                run = Runs(lanes[lane][begins[k] : begins[k + 1]])
                n = int(begins[k + 1] - begins[k])
                found.setdefault((lane, int(run.hashes(np.array([0]), n)[0])), set()).add(texts[at + k])
    assert all(len(v) == 1 for v in found.values()) and len(found) == 2 * len(set(texts))


def test_long_texts_are_cut_between_words():
    text = b"ab \n" * (BLOCK_BYTES // 3) + b"y" * (2 * BLOCK_BYTES) + b" " * (BLOCK_BYTES + 7) + b"end"
    assert [w for p in pieces(text) for w in p.split()] == text.split()
    assert [w for p in pieces(b"y" * (3 * BLOCK_BYTES)) for w in p.split()] == [b"y" * (3 * BLOCK_BYTES)]
    blocks = list(word_blocks(pa.array([b"one two", text, None, b"three"], pa.binary())))
    assert [(b.at, b.begins.tolist()) for b in blocks] == [(0, [0, 2]), (1, [0, len(text.split())]), (2, [0, 0, 1])]
    assert blocks[1].words.bytes(0, len(text.split())) == b" ".join(text.split())
    same = list(word_blocks(pa.array([text.decode()[:BLOCK_BYTES], "x " + text.decode()[:3000]])))
    assert (same[0].lanes[:, :500] == blocks[1].lanes[:, :500]).all() and (same[1].lanes[:, 1:501] == blocks[1].lanes[:, :500]).all()
    runs = next(iter(word_blocks(pa.array([" ".join("z" * k for k in range(1, 200))])))).lanes
    assert all(len(set(lane)) == 199 for lane in runs.tolist())


def test_similar_tells_words_apart(spark):
    docs = spark.createDataFrame(list(enumerate(twins())), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} for t in twins()]
    want = {}
    for k, s in enumerate(sets):  # equal sets share a component; none of the others are alike
        want[k] = min(j for j, other in enumerate(sets) if 100 * len(s & other) >= 90 * len(s | other))
    got = count_links(docs, size=3, percent=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and sum(r["n_links"] for r in got) == 0


def brute(rows, window=50):
    first, out = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_repeats_tell_words_apart(spark):
    # fifty words, of which one differs, and mirrored runs of two words
    rows = []
    for k, size in enumerate((512, 1024, 2048, 4096)):
        one, two = ("".join(w) for w in thue_morse(size))
        rest = " ".join(f"r{j}" for j in range(49))
        rows += [(4 * k, f"{one} {rest}"), (4 * k + 1, f"{two} {rest}"), (4 * k + 2, " ".join(thue_morse(64, f"u{k}", f"v{k}")[0])), (4 * k + 3, " ".join(thue_morse(64, f"u{k}", f"v{k}")[1]))]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got.collect()} == brute(rows)


def test_index_of_two_sessions(spark, tmp_path):
    word = lambda k: f"w{k * k % 997}"
    rows = [(i, " ".join(word(k) for k in range(37 * i % 400, 37 * i % 400 + 90 + 7 * (i % 9)))) for i in range(60)]
    rows += [(60 + i, rows[3 * i][1] + " and more " + rows[i][1]) for i in range(15)]
    texts = spark.createDataFrame(rows, "id long, text string").withColumn("th", F.xxhash64("text"))
    root = f"file://{tmp_path}/index"
    removed, before = {}, len(spark.catalog.listTables())
    for session, batches in ((spark, ((0, 20), (20, 35))), (spark.newSession(), ((35, 50), (50, 62), (62, 75)))):
        index = FingerprintIndex(session, root) if session is spark else FingerprintIndex.open(session, root)
        for low, high in batches:
            part = texts.where(f"id >= {low} and id < {high}")
            part = session.createDataFrame(part.collect(), part.schema)
            removed |= {r["id"]: (r["n_removed"], r["kept_sha"]) for r in index.add(part).collect()}
        index.close()
    want = brute(rows)
    assert {i: v for i, v in want.items() if v[0]} == {i: v for i, v in removed.items() if v[0]}
    assert len(spark.catalog.listTables()) == before
    # five batches, two runs to a level: one run of level 2 and one of level 0 are left
    again = FingerprintIndex.open(spark, root)
    assert sorted(level for kind, level, *_ in again.runs if kind == "spans") == [0, 2] and again.last_id == 74
    for kind, key in (("spans", "fp"), ("texts", "id")):
        assert Counter(r[key] for run in again.of(kind) for r in run.collect()).most_common(1)[0][1] == 1
    again.close()
    try:
        again.add(texts.where("id = 3"))
        raise AssertionError("an earlier id was added")
    except ValueError:
        pass


def test_counters_grow_with_the_rows():
    assert [counters_for(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 10**7, 10**12)] == [1 << 20, 1 << 20, 1 << 20, 1 << 21, 1 << 24, 1 << 26]
