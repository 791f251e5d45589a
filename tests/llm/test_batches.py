"""What Spark sends to a Python worker, and what a worker holds, is bounded by bytes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import decontaminate, language, ngram_join
from webloom.plans.tables import BATCH_BYTES, small_batches

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(BOUND, None)
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND) if before is None else spark.conf.set(BOUND, before)


def texts(spark):
    """One partition of 20 MB in fewer than 10,000 rows."""
    return spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 512).alias("text"), F.lit("en").alias("lang"))


def test_decontamination_gets_bounded_batches(unbounded, monkeypatch):
    def measure(blocks):
        def run(batches):
            for batch in batches:
                n = batch.num_rows
                empty = [[]] * n
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["th"], pa.array([batch.nbytes] * n), pa.array([0] * n), pa.array(empty, pa.list_(pa.string())), pa.array(empty, decontaminate.RESULT.field("spans").type)],
                    schema=decontaminate.RESULT,
                )

        return run

    monkeypatch.setattr(decontaminate, "search", measure)
    bench = unbounded.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows, most = decontaminate.find_contamination(texts(unbounded), bench).agg(F.count("*"), F.max("n_words")).first()
    assert rows == 8000 and most <= 1.1 * BATCH_BYTES


def test_all_steps_bound_their_batches(unbounded):
    model = language.fit(texts(unbounded).limit(5), F.lit(True))
    assert unbounded.conf.get(BOUND) == str(BATCH_BYTES)
    unbounded.conf.unset(BOUND)
    language.predict(texts(unbounded), model)
    assert unbounded.conf.get(BOUND) == str(BATCH_BYTES)
    unbounded.conf.unset(BOUND)
    ngram_join.Join(texts(unbounded).limit(5).select(F.col("doc_id").alias("id"), "text"), 5, 80)
    assert unbounded.conf.get(BOUND) == str(BATCH_BYTES)
    unbounded.conf.set(BOUND, "123456")  # a bound that is there stays
    small_batches(unbounded)
    assert unbounded.conf.get(BOUND) == "123456"


def test_tokens_are_counted_before_many_are_held():
    """2000 sets of 2000 tokens are not held together, and are all counted."""
    rnd = np.random.default_rng(3)
    rows = [" ".join(map(str, rnd.integers(0, 1 << 30, 2004))) for _ in range(2000)]
    scan = ngram_join.scan_sets(5, 1 << 12)
    batches = [pa.RecordBatch.from_pydict({"id": list(range(at, at + 50)), "th": [0] * 50, "text": rows[at : at + 50]}) for at in range(0, 2000, 50)]
    tracemalloc.start()
    out = list(scan(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8
    assert sum(n for batch in out for n in batch["n"].to_pylist() if n is not None) == 2000 * 2000
    import zlib

    counts = [np.frombuffer(zlib.decompress(c), np.int32) for batch in out for c in batch["counts"].to_pylist() if c is not None]
    assert sum(int(c.sum()) for c in counts) == 2000 * 2000
