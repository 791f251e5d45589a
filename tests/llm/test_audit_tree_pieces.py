"""Filter audit, Merkle manifest and piece encoding on awkward rows and empty tables, against plain loops."""

import hashlib
import os
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_corpus_operators import SCHEMA, awkward, rows_of, words
from webloom.llm import catalog, merkle, pieces
from webloom.llm.filter_audit import audit_filters

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"


def rows_with_marks():
    more = [(30, "AB cd " * 40), (31, "price $5 " + " ".join(f"n{k}" for k in range(60))), (32, " ".join(f"m{k}" for k in range(60))), (33, " ".join(f"m{k}" for k in range(60))), (33, "one two"), (None, "null id")]
    return awkward() + [(i, t, "en", "b", 0, "x", 1, "h", 5, 6, 7, "v", "s", 1, "z") for i, t in more]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_with_marks(), SCHEMA).repartition(3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_audit(spark, docs):
    labels = [(1, 1, 0, "p"), (2, 0, 1, "p"), (10, 1, 1, "q"), (10, 0, 0, "q"), (11, 1, None, "r"), (32, 1, 0, "r"), (None, 1, 1, "s")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")
    rows = [(i if i is not None else 1 << 62, t or "", s or "") for i, t, _, s, *_ in rows_with_marks()]
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        first[t] = min(first.get(t, i), i)
    failing = []
    for i, t, s in rows:
        w = words(t)
        conditions = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i > first[t]]
        failing.append((i, s, {c for c, bad in zip("ABCDE", conditions, strict=True) if bad}))
    want = Counter()
    for part in {s for _, _, s in rows}:
        here = [(i, f) for i, s, f in failing if s == part]
        gone = {order: [[i for i, f in here if c in f and not f & set(order[:k])] for k, c in enumerate(order)] for order in permutations("ABCDE")}
        shapley = {c: sum(len(gone[order][order.index(c)]) for order in gone) for c in "ABCDE"}
        for order, removed in gone.items():
            for k, c in enumerate(order):
                kept = sum(not f & set(order[: k + 1]) for _, f in here)
                redundant = sum(c in f and bool(f & set(order[:k])) for _, f in here)
                unique = sum(f == {c} for _, f in here)
                want[(part, "".join(order), k + 1, kept, len(removed[k]), redundant, unique, sum(i in good for i in removed[k]), sum(i in toxic for i in removed[k]), shapley[c])] += 1
    got = audit_filters(docs, table)
    assert rows_of(got, *got.columns) == want
    assert sum(want.values()) == 600 * len({s for _, _, s in rows})
    assert audit_filters(docs.where("false"), table).count() == 0
    assert rows_of(audit_filters(docs, table.where("false")).where("good_lost > 0 or toxic_lost > 0"), "part") == Counter()


def tree_of(digests):
    """Levels of a run, from the leaves up."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, leaf):
    """The siblings on the way up, and the root that follows from a leaf."""
    siblings = []
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        siblings += [d for k, d in enumerate(run) if k != at % 2]
        leaf = h(*(leaf if k == at % 2 else d for k, d in enumerate(run)))
        at //= 2
    return siblings, leaf


def leaf_of(i, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, text)))


def proofs_of(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, places = {}, {}
    for lang in langs:
        inside = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is None, r[0] or 0, leaf_of(*r)))
        trees[lang], places[lang] = tree_of([leaf_of(*r) for r in inside]), inside
    over = tree_of([trees[lang][-1][0] for lang in langs])
    out = Counter()
    for g, lang in enumerate(langs):
        for at, (i, source, _, n, text) in enumerate(places[lang]):
            tampered = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 0 and n is not None
            changed = leaf_of(i, source, lang, n + 1 if tampered else n, text)
            low, sub = climb(trees[lang], at, changed)
            high, root = climb(over, g, sub)
            out[(i, leaf_of(i, source, lang, n, text), trees[lang][-1][0], over[-1][0], h(*low, *high), root, root == over[-1][0])] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40])
def test_merkle(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)
    table = spark.createDataFrame(rows_with_marks()[:n] if n < 40 else rows_with_marks() * 2, SCHEMA)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in table.collect()]
    got = catalog.op13_prove_documents(spark, str(tmp_path))
    assert rows_of(got, *got.columns) == (proofs_of(rows) if rows else Counter())


def test_merkle_of_many(spark, tmp_path):
    """Parts of one row, of a whole bucket, of one more, and of three bands; ids and languages of every order."""
    counts = {None: 1, "b": 512, "a": 513, "ß": 2, "": 1500}
    rows = [(k * 7919 % 10_007 - 5000, "s", lang, k, f"t{k}") for lang, n in counts.items() for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op13_prove_documents(spark, str(tmp_path))
    assert rows_of(got, *got.columns) == proofs_of(rows)
    manifest = merkle.build_manifest(spark.createDataFrame([(k, "x", f"d{k}") for k in range(1025)], "i long, lang string, leaf string"), "lang", "i", "leaf")
    odd = spark.createDataFrame([(3, "x", "d", "a", 7, "b"), (1, None, "e", "c", 8, "d")], "n int, rank string, digest string, root string, part int, `key with space` string")
    proved = merkle.build_manifest(odd.withColumn("leaf", F.col("digest")), "part", "n", "leaf").proofs()
    assert sorted(map(tuple, proved.select("n", "rank", "part", "`key with space`", "digest", "subroot", "root").collect())) == [(1, None, 8, "d", "e", "e", h("d", "e")), (3, "x", 7, "b", "d", "d", h("d", "e"))]
    nodes = manifest.nodes().collect()
    assert len(nodes) == 513 + 257 + 129 + 65 + 33 + 17 + 9 + 5 + 3 + 2 + 1
    assert all(r["lo"] % (1 << r["level"]) == 0 and r["hi"] == min(r["lo"] + (1 << r["level"]), 1025) for r in nodes)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encoded(texts, vocabulary):
    return [ids for lists in pieces.encode_texts(texts, vocabulary, True) for ids in lists.to_pylist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab ▁\n", max_size=60), st.text("the and of́é日本😀0<>s", max_size=60))))
def test_pieces_like_library(vocabulary, library, texts):
    want = library.encode(texts, add_eos=True)
    assert encoded(texts, vocabulary) == want


def test_pieces_of_vocabulary(vocabulary, library, monkeypatch):
    rnd = random.Random(3)
    names = [library.id_to_piece(k) for k in range(259, library.vocab_size())]
    texts = ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts += [" " * 900 + "the" + " " * 33, "=" * 700, "a" * 999, "ab" * 500 + " x" * 500, "", " ", "<s></s><unk><0x0A>"]
    want = library.encode(texts, add_eos=True)
    assert encoded(texts, vocabulary) == want
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 7)
    assert encoded(texts, vocabulary) == want


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_decode_like_library(vocabulary, library, block, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_IDS", block)
    rnd = random.Random(4)
    kinds = lambda: rnd.choice([rnd.randrange(32000), rnd.randrange(262), rnd.choice([0, 1, 2, 259, 28705, 3 + 0xE6, 3 + 0x97, 3 + 0xA5])])
    lists = [[kinds() for _ in range(rnd.randint(0, 12))] for _ in range(5000)]
    table = pieces.surfaces(vocabulary)
    got = pieces.decode_array(pa.array([*lists, None], pa.list_(pa.int32())), vocabulary, table)
    assert got.to_pylist() == [*(library.decode(ids) for ids in lists), ""]
    with pytest.raises(ValueError, match="not in the vocabulary"):
        pieces.decode_array(pa.array([[32000]], pa.list_(pa.int32())), vocabulary, table)


def test_pieces_of_table(spark, docs, vocabulary, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_encode_pieces(spark, str(tmp_path))
    want = Counter()
    for i, text, *_ in rows_with_marks():
        ids = library.encode(text or "", add_eos=True)
        want[(i, len(ids), h(" ".join(map(str, ids))), h(library.decode(ids)))] += 1
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    both = pieces.decode(pieces.encode(docs, vocabulary, end=False), vocabulary)
    assert both.columns == [*docs.columns, "ids", "decoded"]
    assert rows_of(both, "doc_id", "decoded") == rows_of(docs, "doc_id", F.coalesce("text", F.lit("")).alias("decoded"))
    assert pieces.decode(pieces.encode(docs.where("false"), vocabulary), vocabulary).count() == 0
    clash = pieces.decode(pieces.encode(docs.select("doc_id", "text", F.lit(1).alias("IDS"), F.lit(2).alias("Decoded")), vocabulary), vocabulary)
    assert clash.columns == ["doc_id", "text", "ids", "decoded"] and clash.count() == len(rows_with_marks())
    nothing = spark.createDataFrame([(1, None), (2, [])], "id int, ids array<int>")
    assert rows_of(pieces.decode(nothing, vocabulary), "id", "decoded") == Counter([(1, ""), (2, "")])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op12_audit_filters", "op13_prove_documents"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(want)].values.tolist()))
