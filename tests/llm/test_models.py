"""Votes and centroids against plain loops, held-out accuracy, and what distance rejects."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import catalog, language, quality
from webloom.llm.columns import remainder

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
# The same sentence in languages that the model does not learn.
FOREIGN = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
)


def hash32(values, seed):
    """The n-gram hash, one step at a time."""
    out = seed
    for v in values:
        out = (out * 31 + v) % 2**32
        out ^= out >> 16
        out = out * 0x7FEB352D % 2**32
        out ^= out >> 15
        out = out * 0x846CA68B % 2**32
        out ^= out >> 16
    return out


def grams(text):
    """Counts of 1- to 3-grams by bin, by plain loops."""
    shown, before = [], True
    for c in text.lower() + " ":
        if c.isalpha():
            shown.append(c)
        elif before:
            shown.append(" ")
        before = c.isalpha()
    # a break is kept after a letter, and at the very start
    out = {}
    for n in (1, 2, 3):
        for k in range(len(shown) - n + 1):
            part = shown[k : k + n]
            if n > 1 or part != [" "]:
                at = hash32(map(ord, part), n) % language.DIMS
                out[at] = out.get(at, 0) + 1
    return out


def test_centroids_against_loops(spark):
    words = {"en": "the and of house green water over light morning river".split(), "de": "der und das grünes haus wasser über licht morgen fluss".split(), "fr": "le et la maison verte eau sur lumière matin fleuve".split()}
    rows = [(k, " ".join(words[lang][(k * j + j) % 10] for j in range(1, 30)), lang) for k, lang in enumerate(["en", "de", "fr"] * 25)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en", "fr"] and len(model.centroids) == 3 * language.CENTROIDS
    texts = [t for _, t, _ in rows[:6]] + ["the green house, the river", "das Haus; 12 Flüsse", "LA MAISON VERTE", "a", "xyzzy plugh"]
    got = {r["t2"]: r for r in language.predict(spark.createDataFrame([(t, t) for t in texts], "text string, t2 string"), model).collect()}
    for text in texts:
        weights = {at: math.log1p(n) * float(model.idf[at]) for at, n in grams(text).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[at]) for at, w in weights.items()) / norm for c in model.centroids]
        assert got[text]["score"] == pytest.approx(min(1, max(0, *cosines)), abs=1e-5), text
        if sorted(cosines)[-1] - max((c for c, o in zip(cosines, model.owner) if o != model.owner[int(np.argmax(cosines))]), default=0) > 1e-5:
            assert got[text]["lang_pred"] == model.languages[model.owner[int(np.argmax(cosines))]]


def test_votes_against_full_cosines(spark):
    rows = [(k, ("Plain prose, with words. " if k % 2 else "BUY!! NOW!! ") * (1 + k % 7) + f"{k * k}", k % 2) for k in range(80)]
    rows += [(100 + k, rows[0][1], k % 2) for k in range(40)]  # ties, more than there are neighbours
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.drop("quality"), table.select("doc_id", "quality"), F.lit(True))
    texts = [t for _, t, _ in rows[:20]] + ["", "Something else, entirely.", "12345"]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        row = [math.log1p(float(n)) * float(w) for n, w in zip(quality.feature_counts([text])[0], model.idf)]
        norm = math.sqrt(sum(x * x for x in row)) or 1e-12
        place = [sum(x / norm * float(b) for x, b in zip(row, axis)) for axis in model.basis.T]
        norm = math.sqrt(sum(x * x for x in place)) or 1e-12
        cosines = [sum(x / norm * float(v) for x, v in zip(place, vector)) for vector in model.vectors]
        least = sorted(cosines, reverse=True)[min(quality.NEIGHBOURS, len(cosines)) - 1] - 1e-6
        votes = [(max(c, 0) ** quality.POWER, label) for c, label in zip(cosines, model.labels) if c >= least]
        want = (sum(w * label for w, label in votes) + 1e-6 * model.prior) / (sum(w for w, _ in votes) + 1e-6)
        assert got[k] == pytest.approx(float(want), abs=1e-3), text


@needs_data
def test_held_out_accuracy(spark):
    con = duckdb.connect()
    labels = dict(con.execute(f"select doc_id, quality from '{DATA}/labels.parquet' where quality is not null").fetchall())
    scored = [r for r in catalog.op2_score_quality(spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in scored)
    assert len(scored) > 50 and right / len(scored) >= 0.95
    langs = dict(con.execute(f"select doc_id, lang from '{DATA}/documents.parquet' where lang is not null").fetchall())
    found = [r for r in catalog.op10_identify_language(spark, DATA).collect() if r["held_out"] and r["doc_id"] in langs]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in found)
    assert len(found) > 100 and right / len(found) >= 0.98


@needs_data
def test_distance_rejects_other_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs, remainder(F.col("doc_id"), 4) != 2)
    own = language.predict(docs.select("doc_id", "text").where("text is not null"), model)
    # of the corpus's own texts none goes that has letters
    assert own.where("rejected and lang_pred <> 'und'").count() == 0
    foreign = [(k, (t + " ") * n) for k, t in enumerate(FOREIGN) for n in (1, 4, 16)]
    got = language.predict(spark.createDataFrame(foreign, "doc_id long, text string"), model).collect()
    assert sum(r["rejected"] for r in got) >= 0.8 * len(got)
    # too short to tell
    short = language.predict(spark.createDataFrame([(1, "ok"), (2, "Всё")], "doc_id long, text string"), model).collect()
    assert not any(r["rejected"] for r in short)


def test_repeated_ids_keep_both_labels(spark, monkeypatch):
    """More rows than ids are drawn: each id counts once, and no label is cut off."""
    monkeypatch.setattr(quality, "LABELLED", 40)
    rows = [(k, ("Plain prose, with words. And more of them here." if k % 2 else "BUY!! NOW!! BUY!! NOW!!") + f" {j}") for k in range(60) for j in range(9)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2, "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
    assert len(model.labels) == 40 and 10 < model.labels.sum() < 30


def test_more_languages_than_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    words = {"en": "the and of house green", "de": "der und das haus grünes", "xx": "zork blip"}
    rows = [(k, " ".join(words[lang].split()[k % 3 :] * 3), lang) for k in range(60) for lang in words if lang != "xx" or k < 20]
    table = spark.createDataFrame([(n, t, lang) for n, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(True))
    assert model.languages == ["de", "en"]
    assert {r["lang_pred"] for r in language.predict(table.select("doc_id", "text"), model).select("lang_pred").distinct().collect()} <= {"de", "en", "und"}
