"""Audit of how filters interact: what each removes in each order, by contractions of contingency tensors.

1. Spark marks in each row which filters its text fails, and counts rows for each part and each pattern of failures:
   at most 2**n cells of a part, however many documents it has.
2. A part's cells are a tensor with one axis of two (pass, fail) for each filter. For every order and step, a vector
   for each axis selects pass, fail or all of it; one einsum contracts the tensor with the vectors of all steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import SPACES

#: Selections of an axis whose places are pass and fail.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
MARKS = "[#$%&*|]"


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """The filters that look at one text: too short, too repetitive, too many capitals, odd marks."""
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def count_patterns(docs: DataFrame, labels: DataFrame, failures: Callable[[Column, Column], dict[str, Column]] = text_failures) -> DataFrame:
    """(part, pattern, n, good, toxic): documents of each part by the filters they fail.

    Bit k of ``pattern`` stands for the k-th filter of ``failures``; the bit after them says that a smaller id has the
    same text. Equal texts share all the other bits, so rows are first added up by text, part and label: a text
    that a third of all rows have becomes a few rows in each task before anything is shuffled. Texts are compared by
    SHA-256. A null text counts as empty, a null source as the part ''; a null id stands after all others; rows with
    the same id and text are no copies of each other; of several labels for an id the worst and best both count.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.filter(F.split(text, SPACES), lambda w: w != "").alias("words"))
    bits = failures(F.col("words"), F.col("text")).values()
    pattern = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(bits)), F.lit(0))
    marked = split.select("doc_id", "part", pattern.alias("pattern"), F.unhex(F.sha2("text", 256)).alias("hash"))
    rows = marked.groupBy("doc_id", "hash", "part", "pattern").agg(F.count("*").alias("n"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    labelled = rows.join(known, "doc_id", "left").select("hash", "part", "pattern", "n", *marks, F.struct(F.col("doc_id").isNull(), "doc_id").alias("id"))
    texts = labelled.groupBy("hash", "part", "pattern", "good", "toxic").agg(F.min(F.struct("id", "n")).alias("first"), F.sum("n").alias("n"))
    least = texts.groupBy("hash").agg(F.min("first.id").alias("least"))
    # without an id at all, no row has a smaller one
    no_id = F.col("least.doc_id").isNull()
    firsts = F.when(no_id, F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    sides = F.array(F.struct(F.lit(0).alias("bit"), firsts.alias("n")), F.struct(F.lit(1 << len(bits)).alias("bit"), (F.col("n") - firsts).alias("n")))
    cells = texts.join(least, "hash").select("part", "pattern", "good", "toxic", F.explode(sides).alias("side"))
    counted = cells.groupBy("part", (F.col("pattern") + F.col("side.bit")).alias("pattern")).agg(
        F.sum("side.n").alias("n"),
        *(F.sum(F.when(F.col(c), F.col("side.n")).otherwise(0)).alias(c) for c in ("good", "toxic")),
    )
    return counted


def selections(filters: int, orders: list[tuple[int, ...]], choose: Callable[[int, int], tuple[int, int]]) -> list[np.ndarray]:
    """For each axis, one vector for every order and step: ``choose`` gets the axis's place in the order, and the step."""
    steps = [(order, step) for order in orders for step in range(filters)]
    return [np.array([choose(order.index(axis), step) for order, step in steps], np.int64) for axis in range(filters)]


def contraction(names: str) -> Callable[[Iterator[pd.DataFrame]], pd.DataFrame]:
    """The report of one part: a function of its cells, for the filters whose letters are ``names``."""
    n = len(names)
    orders = list(permutations(range(n)))
    axes = "abcdefgh"[:n]
    product = f"m{axes}," + ",".join(f"k{a}" for a in axes) + "->mk"
    kept = selections(n, orders, lambda place, step: PASS if place <= step else ALL)
    removed = selections(n, orders, lambda place, step: PASS if place < step else FAIL if place == step else ALL)
    failing = selections(n, orders, lambda place, step: FAIL if place == step else ALL)
    only = selections(n, orders, lambda place, step: FAIL if place == step else PASS)
    labels = ["".join(names[k] for k in order) for order in orders for _ in range(n)]
    filters = np.array([k for order in orders for k in order])

    def report(cells: pd.DataFrame) -> pd.DataFrame:
        # the pattern's lowest bit is the first filter, and the tensor's last axis in C order
        tensor = np.zeros((3, 1 << n), np.int64)
        tensor[:, cells["pattern"].to_numpy()] = cells[["n", "good", "toxic"]].to_numpy(np.int64).T
        tensor = tensor.reshape(3, *[2] * n).transpose(0, *range(n, 0, -1))
        counts, good, toxic = np.einsum(product, tensor, *removed)
        everything = tensor[:1]
        of = lambda chosen: np.einsum(product, everything, *chosen)[0]
        shapley = np.bincount(filters, counts, n).astype(np.int64)
        return pd.DataFrame(
            {
                "part": cells["part"].iloc[0], "filter_order": labels, "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)), "kept": of(kept), "removed": counts,
                "redundant": of(failing) - counts, "unique_fails": of(only), "good_lost": good, "toxic_lost": toxic, "shapley": shapley[filters],
            }
        )

    return report


def audit_filters(docs: DataFrame, labels: DataFrame, failures: Callable[[Column, Column], dict[str, Column]] = text_failures, repeated: str = "E") -> DataFrame:
    """For every part, every order of the filters and every step: what the step keeps and removes.

    ``failures`` names the filters that look at one text; ``repeated`` names the filter, after them, that fails a text
    which a smaller id has. Parts without documents do not occur, so an empty table gives no rows. Nulls and repeated
    rows are as in :func:`count_patterns`; other columns of ``docs`` and ``labels`` are left out.
    """
    names = "".join(failures(F.array(F.lit("")), F.lit(""))) + repeated
    return count_patterns(docs, labels, failures).groupBy("part").applyInPandas(contraction(names), REPORT)
