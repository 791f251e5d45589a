"""The pipeline on a small table, against what each stage must do by brute force."""

import re
from collections import Counter

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def word_list(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_pipeline(spark, tmp_path):
    english = "the of and house green water over under light morning river stone bridge quiet winter summer garden window letter paper".split()
    german = "der und das haus grün wasser über unter licht morgen fluss stein brücke stiller winter sommer garten fenster brief papier".split()
    rows = []
    for k in range(60):
        words = english if k % 3 else german
        rows.append((k, " ".join(words[(k * m + m * m) % 20] for m in range(1, 60)), "en" if k % 3 else "de", "s", 0))
    rows += [(100, rows[7][1] + " more", "en", "s", 0), (101, rows[7][1], "en", "s", 0), (102, "12345 !!", "en", "s", 0), (103, None, "en", "s", 0), (104, "", "en", "s", 0)]
    bench = "a question of sorts that only the benchmark has in this very order of words here".split()
    rows.append((105, " ".join(english[:5] + bench + english[:9]), "en", "s", 0))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {i: t for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    first = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r["doc_id"]: r["text"] for r in first.collect()} == kept
    named = {i: lang for i, _, lang, *_ in rows}
    assert {r["doc_id"]: r["lang"] for r in first.collect()} == {i: named[i] for i in kept}

    sets = {i: word_list(t, 5) for i, t in kept.items()}
    group = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = {i: min(group[a], group[b]) if g in (group[a], group[b]) else g for i, g in group.items()}
    unique = {i for i, g in group.items() if g == i}
    assert {100, 101}.isdisjoint(unique) and 7 in unique
    second = corpus_pipeline.drop_near_copies(spark, first, str(tmp_path))
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(unique)

    third = corpus_pipeline.decontaminate(spark, second, str(tmp_path))
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(unique - {105})

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies) == unique - {105} and set(copies.values()) <= {1, 2}
    # one source: the mix takes its words one and a half times
    assert abs(len(out) - 1.5 * len(copies)) <= 2
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_pipeline_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Rows that share an id, repeats, nulls and extra columns."""
    plain = [" ".join(f"word{(k * m + m * m) % 37}" for m in range(1, 50)) for k in range(5)]
    bench = "a question of sorts that only the benchmark has in this very order of words here"
    rows = [(1, plain[0], "en", "s", 0, "x"), (1, bench, "en", "s", 0, "x"), (2, plain[1], None, None, 0, "x"), (2, plain[1], None, None, 0, "x"), (3, plain[1] + " more", "en", "s", 0, None)]
    rows += [(4, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (None, plain[2], "en", "s", 0, "x"), (None, plain[3], "en", "s", 0, "x"), (None, plain[0], "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, COLUMNS + ", __id string").repartition(3)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert clean.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ")
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter((i, t) for i, t, *_ in rows if t != bench)
    # rows that share an id count as linked: 1 and 2 keep one text each, null ids one for all
    kept = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect())
    texts = {i: {t for j, t, *_ in rows if j == i} for i in (1, 2, 4, None)}
    assert set(kept.values()) == {1}
    assert all(t in texts[i] for i, t in kept) and Counter(i for i, _ in kept) == Counter({1: 1, 2: 1, 4: len({t or "" for t in texts[4]}), **({None: 1} if None in {i for i, _ in kept} else {})})
    mixed = corpus_pipeline.mix(spark, clean, str(tmp_path))
    assert mixed.columns == clean.columns and {r["doc_id"] for r in mixed.collect()} <= {1, 2, 3, None}
    placed = corpus_pipeline.shard(spark, clean, str(tmp_path))
    assert placed.count() == clean.count()
