"""What learning a language holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webloom.llm import language
from webloom.llm.features import log_tf, sparse, unit


def test_learning_holds_no_second_matrix():
    rnd = np.random.default_rng(1)
    counts = rnd.poisson(0.02, (2000, language.DIMS)).astype(np.float32)
    whole, half, letters = np.arange(2000) < 200, np.arange(2000) % 2, np.full(2000, 40)
    idf = np.ones(language.DIMS, np.float32)
    vectors, size = unit(log_tf(counts) * idf), counts.nbytes
    tracemalloc.start()
    language.learn(counts, half, whole, letters, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < size  # beside the counts themselves
    assert (counts == vectors).all()


def test_learning_holds_the_texts_alone():
    """Sparse pieces become vectors a block at a time, and the model is that of the whole matrix."""
    rnd = np.random.default_rng(2)
    counts = rnd.poisson(0.02, (4000, language.DIMS)).astype(np.float32)
    whole, half, letters = np.arange(4000) % 10 == 0, np.arange(4000) % 3 % 2, rnd.integers(1, 4000, 4000)
    idf, pairs = rnd.uniform(1, 2, language.DIMS).astype(np.float32), [sparse(row) for row in counts]
    tracemalloc.start()
    centroids, threshold = language.learn(pairs, half, whole, letters, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < counts.nbytes / 2
    expected = language.learn(counts, half, whole, letters, idf)
    assert np.allclose(centroids, expected[0], atol=1e-5) and np.allclose(threshold, expected[1], atol=1e-5)


def test_prediction_sends_texts_once_and_answers_by_blocks(spark):
    """The text that stays is the text that is read; what goes out is a block of a batch."""
    model = language.fit(spark.createDataFrame([(k, "the house " * (k + 1), "en") for k in range(9)], "doc_id long, text string, lang string"), F.lit(True))
    seen = {}

    class Rows:
        columns = ["doc_id", "text"]
        schema = spark.createDataFrame([], "doc_id long, text string").schema
        sparkSession = spark  # noqa: N815

        def select(self, *columns):
            seen.setdefault("sent", columns)
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            seen["run"] = run
            return self

    language.predict(Rows(), model, keep_text=True)
    assert len(seen["sent"]) == 2
    batch = pa.RecordBatch.from_pydict({"c0": list(range(1000)), "c1": ["the house"] * 999 + [None]})
    out = list(seen["run"](iter([batch])))
    assert max(b.num_rows for b in out) <= language.BLOCK
    assert pa.Table.from_batches(out).select(["c0", "c1"]).to_pydict() == batch.to_pydict()
    assert [v for b in out for v in b["lang_pred"].to_pylist()] == ["en"] * 999 + ["und"]
