"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each task hashes the normalised texts it reads and cuts its rows into chunks. A chunk's distinct
   fingerprints are sorted, split by owner (their top bits), Rice-coded and sent to the owners.
2. An owner decodes the lists of all chunks and returns one bitmap per list: which of its fingerprints
   other chunks have too. A chunk sends a fingerprint once, so a very common text weighs no more than
   one entry per chunk.
3. Rows whose fingerprint is marked, or repeats within its chunk, are suspects. Only their texts are
   shuffled, and grouped by the whole normalised text, which settles equality byte by byte. Tasks tell suspects by the
   broadcast fingerprints of all suspects; if these take more than ``BROADCAST_BYTES``, the rows meet them by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import SPACES
from webloom.plans.tables import Stash, bounded

#: Rows of one chunk: what a sender holds at a time.
CHUNK_ROWS = 1 << 17
#: Fingerprints that an owner gets, on average: at least, while there are fewer owners than tasks of a shuffle, and at most.
#: The more there are, the longer a chunk's list for an owner, and the fewer bits its gaps take.
OWNER_LEAST, OWNER_MOST = 1 << 16, 1 << 21

SENT = "chunk long, id string, fp long, sha string, twice boolean, owner int, n int, shift int, unary binary, low binary"


def rice_encode(values: np.ndarray, span_bits: int) -> tuple[int, bytes, bytes]:
    """Codes sorted uint64 values below 2**span_bits: gaps as unary quotients and fixed-width rests."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = (1 << span_bits) / max(1, len(values))
    shift = max(0, int(np.log2(max(1.0, mean * 0.69))))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    rests = (gaps & np.uint64((1 << shift) - 1))[:, None] >> np.arange(shift, dtype=np.uint64)[None, :]
    return shift, np.packbits(unary).tobytes(), np.packbits((rests & np.uint64(1)).astype(np.uint8)).tobytes()


def rice_decode(n: int, shift: int, unary: bytes, low: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(unary, np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    rests = np.unpackbits(np.frombuffer(low, np.uint8))[: n * shift].reshape(n, shift).astype(np.uint64)
    rest = (rests << np.arange(shift, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(shift)) + rest, dtype=np.uint64)


def sender(owner_bits: int):
    """Rows and coded lists of each chunk of a task, in one output: a retried task replaces both."""
    schema = pa.schema([("chunk", pa.int64()), ("id", pa.string()), ("fp", pa.int64()), ("sha", pa.string()), ("twice", pa.bool_()), ("owner", pa.int32()), ("n", pa.int32()), ("shift", pa.int32()), ("unary", pa.binary()), ("low", pa.binary())])
    span_bits = 64 - owner_bits

    def flush(chunk: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        fps = rows["fp"].to_numpy()
        seen, back, counts = np.unique(fps.view(np.uint64), return_inverse=True, return_counts=True)
        none = lambda kind: pa.nulls(len(fps), kind)
        columns = [pa.array(np.full(len(fps), chunk)), rows["id"].combine_chunks(), pa.array(fps), rows["sha"].combine_chunks(), pa.array(counts[back] > 1), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.binary()), none(pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        owners = (seen >> np.uint64(span_bits)).astype(np.int64) if owner_bits else np.zeros(len(seen), np.int64)
        lists: dict[str, list] = {k: [] for k in ("owner", "n", "shift", "unary", "low")}
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        for at, end in zip(cuts, np.append(cuts[1:], len(owners)), strict=True):
            inside = seen[at:end] & np.uint64((1 << span_bits) - 1)
            for k, v in zip(lists, (int(owners[at]), int(end - at), *rice_encode(inside, span_bits)), strict=True):
                lists[k].append(v)
        n = len(lists["n"])
        columns = [pa.array(np.full(n, chunk)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()), *(pa.array(v, schema.field(k).type) for k, v in lists.items())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        chunks = 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield from flush(part + chunks, held)
                held, chunks = [], chunks + 1
        if any(b.num_rows for b in held):
            yield from flush(part + chunks, held)

    return send


def owner_bitmaps(lists: pd.DataFrame) -> pd.DataFrame:
    """For each list of one owner, the bits of the fingerprints that another list has too."""
    decoded = [rice_decode(n, s, u, w) for n, s, u, w in zip(lists["n"], lists["shift"], lists["unary"], lists["low"], strict=True)]
    _, back, counts = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
    marks = np.split(counts[back] > 1, np.cumsum([len(d) for d in decoded])[:-1])
    return pd.DataFrame({"chunk": lists["chunk"], "owner": lists["owner"], "n": lists["n"], "bits": [np.packbits(m).tobytes() for m in marks]})


def mark_suspects(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    """Applies the bitmaps of a chunk, in the order of its sorted distinct fingerprints, to its rows."""
    if not len(rows):
        return pd.DataFrame({"id": [], "fp": [], "sha": [], "suspect": []})
    fps = rows["fp"].to_numpy().view(np.uint64)
    seen, back = np.unique(fps, return_inverse=True)
    bitmaps = bitmaps.sort_values("owner")
    bits = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(bitmaps["bits"], bitmaps["n"], strict=True)]
    shared = np.concatenate(bits).astype(bool)
    assert len(shared) == len(seen)
    return pd.DataFrame({"id": rows["id"], "fp": rows["fp"], "sha": rows["sha"], "suspect": rows["twice"].to_numpy(bool) | shared[back]})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the document kept of its group of equal texts, and the group's size.

    Texts are equal when they are after each run of white space becomes one space; null counts as empty.
    A null id is larger than any other. Rows that repeat both id and text are all marked kept if their id
    is the group's smallest. An empty table gives no rows. Columns besides id and text are left out.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "exact")
    kind = docs.schema[id_col].dataType
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    texts = docs.select(F.col(id_col).cast("string").alias("id"), norm.alias("norm")).withColumn("fp", F.xxhash64("norm"))
    n_rows = docs.select(id_col).count()
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(1.0, n_rows / OWNER_MOST, min(n_rows / OWNER_LEAST, tasks))
    owner_bits = int(np.ceil(np.log2(owners)))
    hashed = texts.select("id", "fp", F.sha2("norm", 256).alias("sha"))
    sent = stash.put(hashed.mapInArrow(sender(owner_bits), SENT), "sent")

    lists = sent.where("owner is not null").select("chunk", "owner", "n", "shift", "unary", "low")
    bitmaps = lists.groupBy("owner").applyInPandas(owner_bitmaps, "chunk long, owner int, n int, bits binary")
    rows = sent.where("owner is null").select("chunk", "id", "fp", "sha", "twice")
    marked = stash.put(
        rows.groupBy("chunk").cogroup(bitmaps.groupBy("chunk")).applyInPandas(mark_suspects, "id string, fp long, sha string, suspect boolean"), "marked"
    )
    # a fingerprint is suspect for all rows that have it; while these numbers are few, no text is moved to find it
    suspects = bounded(stash.put(marked.where("suspect").select("fp").distinct(), "suspects"))
    held = texts.join(suspects, "fp", "left_semi")
    # whole texts are grouped; what their rows then need to find their group is narrow
    grouped = held.groupBy("fp", "norm").agg(F.min(F.col("id").cast(kind)).alias("keep_id"), F.count("*").alias("group_size"))
    groups = bounded(stash.put(grouped.select("fp", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"), "groups"))
    verified = marked.where("suspect").join(groups, ["fp", "sha"]).select(
        F.col("id").cast(kind).alias(id_col), "keep_id", "group_size", F.col("id").cast(kind).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    single = marked.where("not suspect").select(
        F.col("id").cast(kind).alias(id_col), F.col("id").cast(kind).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return single.unionByName(verified)
