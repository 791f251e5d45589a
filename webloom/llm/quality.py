"""Quality classification by similarity-weighted votes of the nearest labelled documents.

Features are hashed counts of case-sensitive character 3-grams, of 4-grams of character classes, and of
marks of repetition. TF-IDF rows of a labelled sample give a truncated SVD; labelled rows and documents
are projected on it and set to unit length. The labelled vectors, at most ``LABELLED`` rows of ``RANK``
numbers, are broadcast; every document's exact cosines with all of them are computed block by block, and
its ``NEIGHBOURS`` nearest, and all that are as near as the last of them, vote with weight max(cosine, 0) ** ``POWER``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import hash_long
from webloom.llm.features import blocks, char_classes, code_points, count_into, dense, gram_hashes, log_tf, sparse, unit
from webloom.plans.tables import Stash

DIMS = 4096
GRAMS, SHAPES, MARKS = 3072, 960, 64
#: Labelled rows to learn from: those with the smallest hash of their id.
LABELLED = 4000
RANK = 64
NEIGHBOURS = 25
POWER = 4


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def repetition_marks(text: str) -> np.ndarray:
    """Bins for the shares of distinct words, distinct lines and upper-case or odd words, and the length."""
    out = np.zeros(MARKS, np.float32)
    words = text.split()
    if not words:
        out[63] = 20
        return out
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (len(set(words)) / len(words), len(set(lines)) / max(1, len(lines)), sum(w.isupper() for w in words) / len(words), sum(not any(c.isalpha() for c in w) for w in words) / len(words))
    for k, share in enumerate(shares):
        out[12 * k + min(9, int(share * 10))] = 20
    out[48 + min(14, len(words).bit_length())] = 20
    return out


def feature_counts(texts: list[str]) -> np.ndarray:
    codes, owner = code_points(texts)
    kinds = char_classes()[codes].astype(np.uint32)
    counts = np.zeros((len(texts), DIMS), np.float32)
    punctuation = np.where(kinds == 4, codes + 8, kinds)  # marks as they are, all else as its class
    for values, n, start, width in ((codes, 3, 0, GRAMS), (punctuation, 4, GRAMS, SHAPES)):
        hashes = gram_hashes(values, n, n)
        inside = owner[: len(hashes)] == owner[len(owner) - len(hashes) :]
        counts[:, start : start + width] = count_into(owner[: len(hashes)][inside], (hashes[inside] % width).astype(np.int64), len(texts), width)
    counts[:, GRAMS + SHAPES :] = [repetition_marks(t) for t in texts]
    return counts


def fit(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled rows where ``train``, a column over ``labels``, holds.

    At most ``LABELLED`` ids are drawn, by a hash of the id alone. An id counts once: of several labels the largest, of
    several documents the text that is first by its code points.
    """
    stash = Stash(docs.sparkSession, "quality")
    usable = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    each = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = stash.put(each.withColumn("h", hash_long(F.concat(F.lit("label:"), F.col("id").cast("string")))).orderBy("h", "id").limit(LABELLED).drop("h"), "sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drawn = rows.join(chosen, "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").cast("int").alias("label"))
    sample = stash.put(drawn, "texts")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, texts in blocks(batch["text"].tolist()):
                pairs = [sparse(row) for row in feature_counts(texts)]
                yield pd.DataFrame({"label": batch["label"].iloc[at : at + len(texts)], "at": [p[0] for p in pairs], "n": [p[1] for p in pairs]})

    got = sample.mapInPandas(vectors, "label int, at binary, n binary").orderBy("label", "at", "n").toPandas()  # as many rows as ids were drawn
    return learn(got["label"].to_numpy(), dense(list(zip(got["at"], got["n"], strict=True)), DIMS))


def learn(labels: np.ndarray, counts: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    idf = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = unit(log_tf(counts) * idf)
    basis = leading_axes(rows, min(RANK, len(labels)))
    return Model(idf, basis, unit(rows @ basis), labels.astype(np.float32), float(labels.mean()))


def leading_axes(rows: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(7).standard_normal((rows.shape[1], min(rank + 16, *rows.shape))).astype(np.float32)
    span = np.linalg.qr(rows.T @ (rows @ start))[0]
    for _ in range(rounds):
        span = np.linalg.qr(rows.T @ (rows @ span))[0]
    _, _, axes = np.linalg.svd(rows @ span, full_matrices=False)
    return (span @ axes.T)[:, :rank].astype(np.float32)


def votes(texts: list[str], model: Model) -> np.ndarray:
    if not len(model.labels):
        return np.full(len(texts), model.prior)
    cosines = unit(unit(log_tf(feature_counts(texts)) * model.idf) @ model.basis) @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    weight = np.where(cosines >= least, np.maximum(cosines, 0), 0).astype(float) ** POWER
    return (weight @ model.labels + 1e-6 * model.prior) / (weight.sum(axis=1) + 1e-6)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, higher where label 1 is likelier; null counts as empty text, which is scored too.

    Without labelled rows every score is 0.5. Repeated rows are scored each; other columns are left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [votes(texts, known.value) for _, texts in blocks([t if isinstance(t, str) else "" for t in batch["text"]])]
            yield pd.DataFrame({"id": batch["id"], "score": np.concatenate(found) if found else np.zeros(0)})

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, score double").select(F.col("id").cast(kind).alias(id_col), "score")
