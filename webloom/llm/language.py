"""Language identification by the nearest of several TF-IDF centroids per language.

A text is lower-cased, its non-letters become word breaks, and its character 1- to 3-grams (but not the bare
break) are hashed into ``DIMS`` counts; log counts times IDF, at unit length, are compared with every centroid
by cosine. Centroids come from spherical k-means over a sample of the training rows: of each language those
whose id's hash lies below the share that leaves ``PER_LANGUAGE`` of them. Languages are learned in a task each.

A text is rejected if its best cosine is too low for its length. Cosines grow with the length, so each language
has a threshold for every doubling of the number of letters: ``MARGIN`` of the 0.1 % quantile of what sample texts,
whole and cut to that length, reach with centroids of the other half of the sample, but at most ``CLOSE``: nearer
texts, such as one word again and again, are strange but not of another language. Texts of fewer than
``LEAST_LETTERS`` letters are too short to be told apart and are not rejected, unless they have no letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import hash_long
from webloom.llm.features import blocks, char_classes, code_points, count_into, dense, gram_hashes, log_tf, sparse, unit
from webloom.plans.tables import Stash, bounded, small_batches

DIMS = 4096
PER_LANGUAGE = 800
CENTROIDS = 4
#: The model, of some 64 KB a language, is broadcast: it learns the languages with most texts, as many as this.
MOST_LANGUAGES = 1000
#: Classes of length: letters are counted up to 2**11, by doublings.
CLASSES = 12
LEAST_LETTERS = 8
MARGIN, QUANTILE, CLOSE = 0.9, 0.001, 0.25
#: Held-out texts that a class must have for a threshold of its own; else that of shorter texts holds.
LEAST_TEXTS = 20
UNKNOWN = "und"
#: Rows that are turned into vectors at a time.
BLOCK = 256


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    threshold: np.ndarray


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-gram counts of each text, and how many letters it has."""
    codes, owner = code_points([t.lower() for t in texts])
    kinds = char_classes()[codes]
    letter = (kinds == 1) | (kinds == 2)
    keep = letter | np.append(True, letter[:-1])
    codes, owner, letter = np.where(letter, codes, np.uint32(32))[keep], owner[keep], letter[keep]
    counts = np.zeros((len(texts), DIMS), np.float32)
    for n in (1, 2, 3):
        hashes = gram_hashes(codes, n, n)
        inside = owner[: len(hashes)] == owner[len(owner) - len(hashes) :]
        if n == 1:
            inside &= letter
        counts += count_into(owner[: len(hashes)][inside], (hashes[inside] % DIMS).astype(np.int64), len(texts), DIMS)
    return counts, np.bincount(owner[letter], minlength=len(texts))


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(letters, 1))).astype(np.int64), CLASSES - 1)


def cut_pieces(texts: list[str]) -> list[tuple[int, str]]:
    """(text, piece): a piece of about as many letters as each class begins with, from a third of the text on."""
    out = []
    for k, text in enumerate(texts):
        at = len(text) // 3
        out += [(k, text[at : at + (1 << c)]) for c in range(LEAST_LETTERS.bit_length() - 1, CLASSES) if len(text) - at > 1 << c]
    return out


def fit(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows where ``train`` holds and neither id, language nor text is null; rows that share an id are drawn together.

    Of more than ``MOST_LANGUAGES`` values of language, those with most texts are learned, of equally many the first by
    code points; texts of the others are predicted as what they are most like, or rejected.
    """
    small_batches(docs.sparkSession)
    stash = Stash(docs.sparkSession, "language")
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), hash_long(F.concat(F.lit("fit:"), F.col(id_col).cast("string"))).alias("h"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("texts")).orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES)
    sizes = stash.put(counted.select("lang", (PER_LANGUAGE / F.col("texts") * float(1 << 52)).alias("below")), "sizes")
    sample = rows.join(bounded(sizes), "lang").where(F.col("h") < F.col("below")).select("lang", "text", (F.col("h") % 2).cast("int").alias("half"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each text, and for each piece of it."""
        for batch in batches:
            for at, texts in blocks(batch["text"].tolist()):
                pieces = cut_pieces(texts)
                own = [*range(len(texts)), *(k for k, _ in pieces)]
                for a, part in blocks([*texts, *(p for _, p in pieces)]):
                    counts, letters = gram_counts(part)
                    pairs = [sparse(row) for row in counts]
                    places = np.array(own[a : a + len(part)])
                    yield pd.DataFrame(
                        {"lang": batch["lang"].iloc[at + places], "half": batch["half"].iloc[at + places], "whole": np.arange(a, a + len(part)) < len(texts), "letters": letters, "at": [p[0] for p in pairs], "n": [p[1] for p in pairs]}
                    )

    held = stash.put(sample.mapInPandas(vectors, "lang string, half int, whole boolean, letters long, at binary, n binary"), "vectors")

    def documents_with(group: pd.DataFrame) -> pd.DataFrame:
        df = np.zeros(DIMS, np.int64)
        for at in group["at"]:  # no place is there twice
            df[np.frombuffer(at, np.uint16)] += 1
        return pd.DataFrame({"n": [len(group)], "df": [df.tobytes()]})

    n, df = 0, np.zeros(DIMS, np.int64)
    for row in held.where("whole").groupBy("lang").applyInPandas(documents_with, "n long, df binary").toLocalIterator():  # a row a language
        n, df = n + row["n"], df + np.frombuffer(row["df"], np.int64)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["letters", "at", "n"], kind="stable")
        centroids, threshold = learn(list(zip(group["at"], group["n"], strict=True)), group["half"].to_numpy(), group["whole"].to_numpy(), group["letters"].to_numpy(), idf)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "centroids": [centroids.tobytes()], "threshold": [threshold.tobytes()]})

    found = sorted(held.groupBy("lang").applyInPandas(learned, "lang string, centroids binary, threshold binary").collect())  # a row a language
    centroids = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS) for r in found]
    return Model(
        [r["lang"] for r in found],
        idf,
        np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32),
        np.repeat(np.arange(len(found)), [len(c) for c in centroids]),
        np.array([np.frombuffer(r["threshold"], np.float64) for r in found]),
    )


def learn(counts: np.ndarray | list[tuple[bytes, bytes]], half: np.ndarray, whole: np.ndarray, letters: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One language's centroids, and its thresholds by class of length, from texts (``whole``) and pieces of them.

    Of sparse ``counts`` only the texts are held as vectors, the pieces, of which there are many more, a block at a time.
    A matrix is overwritten by its vectors.
    """

    def vectors(places: np.ndarray) -> np.ndarray:
        return counts[places] if isinstance(counts, np.ndarray) else unit(log_tf(dense([counts[k] for k in places], DIMS)) * idf)

    if isinstance(counts, np.ndarray):
        for at in range(0, len(counts), BLOCK):
            counts[at : at + BLOCK] = unit(log_tf(counts[at : at + BLOCK]) * idf)
    texts = np.flatnonzero(whole)
    rows = np.empty((len(texts), DIMS), np.float32)
    for at in range(0, len(texts), BLOCK):
        rows[at : at + BLOCK] = vectors(texts[at : at + BLOCK])
    others = {k: cluster(rows[half[texts] != k], CENTROIDS) for k in (0, 1) if (half[texts] != k).any()}
    top = np.full(len(half), np.nan)
    for k, centroids in others.items():
        mine = np.flatnonzero(half == k)
        for at in range(0, len(mine), BLOCK):
            top[mine[at : at + BLOCK]] = (vectors(mine[at : at + BLOCK]) @ centroids.T).max(axis=1)
    threshold, kinds = np.zeros(CLASSES), length_class(letters)
    for c in range(LEAST_LETTERS.bit_length() - 1, CLASSES):
        reached = top[(kinds == c) & ~np.isnan(top)]
        threshold[c] = min(CLOSE, MARGIN * np.quantile(reached, QUANTILE)) if len(reached) >= LEAST_TEXTS else threshold[c - 1]
    return cluster(rows, CENTROIDS), threshold


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    found = [rows.mean(axis=0)]
    while len(found) < min(k, len(rows)):
        found.append(rows[np.argmin((rows @ np.array(found).T).max(axis=1))])
    centroids = unit(np.array(found))
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        centroids = unit(np.array([rows[nearest == j].mean(axis=0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))]))
    return centroids.astype(np.float32)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds lang_pred, score (the best cosine) and rejected; only id, text and what else ``docs`` selects pass, the text
    itself, in its place, with ``keep_text``.

    Null, empty and letterless texts are ``und`` with score 0, and rejected. With no training rows all are. Of centroids
    that are equally near, the first language's in the order of code points wins. ``BLOCK`` rows of a batch are read at a time.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    passed = [f"c{k}" for k in range(len(kept))]
    read = passed[kept.index(text_col)] if keep_text else "text"

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            langs, scores, rejected = [], [], []
            for _, texts in blocks([t if isinstance(t, str) else "" for t in batch[read].to_pylist()]):
                counts, n_letters = gram_counts(texts)
                letters = n_letters > 0
                if not len(model.languages):
                    letters[:] = False
                    best = np.zeros(len(texts), np.int64)
                    top = np.zeros(len(texts))
                else:
                    cosines = unit(log_tf(counts) * model.idf) @ model.centroids.T
                    near = cosines.argmax(axis=1)
                    best, top = model.owner[near], np.clip(cosines[np.arange(len(texts)), near].astype(float), 0, 1)
                langs += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(top, letters, strict=True)]
                rejected += [bool(not ok or s < model.threshold[b][c]) for b, s, c, ok in zip(best, top, length_class(n_letters), letters, strict=True)]
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in passed), *added], [*passed, "lang_pred", "score", "rejected"])

    rows = docs.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, passed, strict=True)), *([] if keep_text else [F.col(text_col).alias(read)]))
    kinds = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(kept, passed, strict=True))
    out = rows.mapInArrow(classify, f"{kinds}{', ' if kept else ''}lang_pred string, score double, rejected boolean")
    return out.select(*(F.col(p).alias(c) for c, p in zip(kept, passed, strict=True)), "lang_pred", "score", "rejected")
