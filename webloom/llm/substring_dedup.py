"""Removal of passages that earlier documents hold, by a log-structured fingerprint index.

Windows are ``WINDOW`` consecutive words. Consecutive windows of a document that share the same smallest
``GRAM``-word hash, their anchor, form a segment; equal windows always have equal anchors, so segments
stand for all their windows at about one row for every seventeen. The index holds immutable runs, sorted
and bucketed by their key:

* spans: the fingerprint of all words under a segment, with a digest of the words themselves that verifies a match;
* anchors: where each segment seen for the first time lies, by its anchor;
* texts: the documents of each batch that have a window, by id.

A batch of documents with ids above all earlier ones is merge-joined with every run. A segment whose span
an earlier document has is removed whole. What is left meets, by anchor, other segments that share some but
not all of its windows: their texts are read again, window by window, and digests of the words of whole
windows decide. The batch's own new segments become runs of level 0; when ``FANOUT`` runs of a level are
there, they are merged into one of the next, so a fingerprint is written again once a level only.

The list of runs is a table beside them: ``FingerprintIndex.open`` finds it, in a later session too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.wordhash import U, Runs, sliding_min, word_blocks
from webloom.plans.tables import Stash, bucketed, children, put_sorted

WINDOW = 50
GRAM = 16
BATCHES = 3
FANOUT = 2
#: Words of a very long document that are cut into segments at a time.
PIECE = 1 << 20
#: The id that stands for null: larger than any other.
LAST_ID = (1 << 63) - 1

SEGMENTS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("first", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("fp", pa.int64()), ("proof", pa.int64())])
SEGMENTS_DDL = "id long, th long, n_words long, sha string, first int, n int, anchor long, fp long, proof long"
KEYS = {"spans": "fp", "anchors": "anchor", "texts": "id"}


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def cut_segments(lane: np.ndarray, begins: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, anchor, span hash) of all segments of a block; places count from the block's start."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    for at in range(0, max(0, len(lane) - window + 1), PIECE):
        part = lane[at : at + PIECE + window - 1]
        n = len(part)
        runs = Runs(part)
        grams = runs.hashes(np.arange(n - gram + 1), gram)
        low = sliding_min((grams >> U(24) << U(24)) | np.arange(len(grams), dtype=U), window - gram + 1)
        doc = owner[at : at + n]
        places = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        if not len(places):
            continue
        anchor = (low[places] & U((1 << 24) - 1)).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(doc[places], prepend=-1) != 0))
        first, last = places[new], np.append(places[new[1:] - 1], places[-1])
        yield doc[first], first + at, last - first + 1, grams[anchor[new]], runs.of_lengths(first, last - first + window)


def scan_segments(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda kind, size: pa.nulls(size, kind)
        for batch in batches:
            ids, hashes = batch["id"].to_numpy(zero_copy_only=False), batch["th"].to_numpy(zero_copy_only=False)
            for block in word_blocks(batch["text"]):
                at, words, begins = block.at, block.words, block.begins
                n = len(begins) - 1
                shas = [hashlib.sha256(words.bytes(a, b)).hexdigest() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + n]), pa.array(hashes[at : at + n]), pa.array(np.diff(begins)), pa.array(shas), none(pa.int32(), n), none(pa.int32(), n), none(pa.int64(), n), none(pa.int64(), n), none(pa.int64(), n)],
                    schema=SEGMENTS,
                )
                for own, first, count, anchor, fp in cut_segments(block.lanes[0], begins, window, gram):
                    m = len(own)
                    proof = words.digests(first, first + count + window - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at + own]), pa.array(hashes[at + own]), none(pa.int64(), m), none(pa.string(), m), pa.array((first - begins[own]).astype(np.int32)), pa.array(count.astype(np.int32)), signed(anchor), signed(fp), signed(proof)],
                        schema=SEGMENTS,
                    )

    return scan


def window_rows(window: int):
    """Hashes and digests of all windows of the listed segments of each text."""
    schema = pa.schema([("h", pa.int64()), ("proof", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("fresh", pa.bool_()), ("place", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch["segments"].to_pylist()
            for block in word_blocks(batch["text"]):
                at, words, begins, runs = block.at, block.words, block.begins, Runs(block.lanes[0])
                places = [np.concatenate([np.arange(s["first"], s["first"] + s["n"]) for s in listed[at + k] or []] or [np.zeros(0, np.int64)]) for k in range(len(begins) - 1)]
                own = np.repeat(np.arange(len(places)), [len(p) for p in places])
                place = np.concatenate(places)
                for a in range(0, len(own), PIECE):
                    of, found = own[a : a + PIECE], place[a : a + PIECE]
                    first = found + begins[of]
                    ids, hashes, fresh = (batch[c].take(pa.array(at + of)) for c in ("id", "th", "fresh"))
                    yield pa.RecordBatch.from_arrays([signed(runs.hashes(first, window)), signed(words.digests(first, first + window)), ids, hashes, fresh, pa.array(found.astype(np.int32))], schema=schema)

    return emit


def strike(window: int):
    """From covered spans and struck windows of each text: the words removed, and the digest of the rest."""
    run = pa.struct([("first", pa.int32()), ("stop", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_removed", pa.int64()), ("kept_sha", pa.string()), ("removed", pa.list_(run))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "kept_sha": [], "removed": []}
            texts = batch["text"].cast(pa.large_binary())
            for k in range(batch.num_rows):
                words = (texts[k].as_py() or b"").split()
                edges = np.zeros(len(words) + 1, np.int64)
                for s in batch["covered"][k].as_py() or []:
                    edges[s["first"]] += 1
                    edges[s["first"] + s["n"] + window - 1] -= 1
                places = np.array(batch["places"][k].as_py() or [], np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha"].append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                out["removed"].append([{"first": int(a), "stop": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha"], pa.string()), pa.array(out["removed"], pa.list_(run))], schema=schema)

    return apply


class FingerprintIndex:
    """Runs of span and anchor fingerprints, and texts, of the documents added so far.

    All of it lies under ``root``. Runs are never changed; each new list of runs is a table of its own, and the
    one with the highest number counts, so a batch that fails half-way leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, root: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> None:
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.stash = Stash(spark, "substring")
        self.root = root.rstrip("/")
        self.version, self.last_id = 0, None
        #: (kind, level, path, buckets)
        self.runs: list[tuple[str, int, str, int]] = []
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str, fanout: int = FANOUT) -> FingerprintIndex:
        """The index that is stored under ``root``, as its last added batch left it."""
        listed = children(spark, f"{root.rstrip('/')}/lists")
        if not listed:
            raise ValueError(f"no index under {root}")
        rows = spark.read.parquet(f"{root.rstrip('/')}/lists/{max(listed)}").collect()  # a few rows for each level
        head = next(r for r in rows if r["kind"] == "index")
        index = cls(spark, root, head["level"], head["buckets"], fanout)
        index.version, index.last_id = int(max(listed)), head["last_id"]
        index.runs = [(r["kind"], r["level"], r["path"], r["buckets"]) for r in rows if r["kind"] != "index"]
        return index

    def save(self) -> None:
        self.version += 1
        rows = [("index", self.window, self.root, self.gram, self.last_id), *((*run, None) for run in self.runs)]
        listed = self.spark.createDataFrame(rows, "kind string, level int, path string, buckets int, last_id long")
        listed.coalesce(1).write.parquet(f"{self.root}/lists/{self.version:08d}")

    def of(self, kind: str) -> list[DataFrame]:
        """The runs of a kind, as tables that are known to be bucketed and sorted."""
        out = []
        for name, _, path, buckets in self.runs:
            if name == kind:
                if path not in self.tables:
                    self.tables[path] = bucketed(self.spark, path, KEYS[kind], buckets)
                out.append(self.tables[path])
        return out

    def put(self, df: DataFrame, kind: str, level: int) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = put_sorted(df, f"{self.root}/runs/{self.version + 1:08d}-{kind}-{level}", KEYS[kind], buckets)
        self.runs.append((kind, level, path, buckets))

    def compact(self) -> None:
        """Merges the runs of every level that has ``fanout`` of them into one of the next level."""
        for kind in ("spans", "anchors"):
            level = 0
            while level <= max((r[1] for r in self.runs if r[0] == kind), default=-1):
                full = [r for r in self.runs if r[0] == kind and r[1] == level]
                if len(full) >= self.fanout:
                    frames = [self.spark.read.parquet(path) for _, _, path, _ in full]
                    self.runs = [r for r in self.runs if r not in full]
                    self.put(reduce(DataFrame.unionByName, frames), kind, level + 1)
                level += 1

    def close(self) -> None:
        """Takes the runs out of the session's catalog and drops intermediate tables; the index stays stored."""
        for table in self.tables.values():
            self.spark.sql(f"drop table if exists {table._webloom_name}")  # type: ignore[attr-defined]
        self.tables = {}

    def segments(self, texts: DataFrame) -> DataFrame:
        """Document rows and segment rows of (id, th, text)."""
        return texts.select("id", "th", "text").mapInArrow(scan_segments(self.window, self.gram), SEGMENTS_DDL)

    def add(self, texts: DataFrame, segments: DataFrame | None = None) -> DataFrame:
        """Adds (id, th, text) rows whose ids lie above all earlier ones; gives (id, th, n_removed, kept_sha, removed).

        ``th`` tells rows with the same id apart. ``segments`` is what :meth:`segments` gives for them, if that is there already.
        Documents without a removed word may be left out of the result.
        """
        stash = self.stash
        if segments is None:
            segments = stash.put(self.segments(texts), "scan").where("anchor is not null").drop("n_words", "sha")
        least, most = segments.agg(F.min("id"), F.max("id")).first()
        if least is None:
            return self.spark.createDataFrame([], "id long, th long, n_removed long, kept_sha string, removed array<struct<first:int,stop:int>>")
        if self.last_id is not None and least <= self.last_id:
            raise ValueError(f"id {least} is not above {self.last_id}, the last of the index")

        seen = segments.groupBy("fp", "proof", "n").agg(F.min("id").alias("owner")).withColumn("known", F.lit(False))
        for run in self.of("spans"):
            old = run.select("fp", F.col("proof").alias("old_proof"), F.col("n").alias("old_n"))
            joined = seen.join(old, "fp", "left")  # the digest of the words and their number verify the match
            match = F.coalesce((F.col("old_proof") == F.col("proof")) & (F.col("old_n") == F.col("n")), F.lit(False))
            seen = joined.withColumn("known", F.col("known") | match).drop("old_proof", "old_n").groupBy("fp", "proof", "n", "owner").agg(F.max("known").alias("known"))
        seen = stash.put(seen, "seen")
        judged = stash.put(
            segments.join(seen, ["fp", "proof", "n"]).select("id", "th", "first", "n", "anchor", (F.col("known") | (F.col("id") > F.col("owner"))).alias("gone")), "judged"
        )
        left = judged.where("not gone")

        near = left.select("anchor").distinct()
        old = None
        for run in self.of("anchors"):
            hits = run.join(near, "anchor", "left_semi")
            old = hits if old is None else old.unionByName(hits)
        several = left.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
        if old is not None:
            old = stash.put(old, "old")
            several = several.unionByName(old.select("anchor")).distinct()
        several = stash.put(several, "several")
        live = left.join(several, "anchor", "left_semi").select("id", "th", "first", "n", F.lit(True).alias("fresh"), F.lit(False).alias("gone"))
        wanted = live.unionByName(judged.where("gone").select("id", "th", "first", "n", F.lit(True).alias("fresh"), "gone"))
        if old is not None:
            wanted = wanted.unionByName(old.select("id", "th", "first", "n", F.lit(False).alias("fresh"), F.lit(False).alias("gone")))
        piece = F.struct("first", "n")
        per_text = wanted.groupBy("id", "th").agg(
            F.collect_list(F.when(~F.col("gone"), piece)).alias("segments"), F.collect_list(F.when(F.col("gone"), piece)).alias("covered"), F.max("fresh").alias("fresh")
        )
        per_text = stash.put(per_text, "wanted").withColumnsRenamed({"id": "w_id", "th": "w_th"})
        self.put(texts.select("id", "th", "text").where(F.octet_length("text") >= 2 * self.window - 1), "texts", 0)
        held = None
        for run in self.of("texts"):  # stored by id: the texts stay where they are, and the hash is no join key, only compared
            hits = run.join(per_text, (F.col("id") == F.col("w_id")) & (F.col("th").bitwiseXOR(F.col("w_th")) == 0)).drop("w_id", "w_th")
            held = hits if held is None else held.unionByName(hits)
        held = stash.put(held, "texts")

        windows = stash.put(
            held.where(F.size("segments") > 0).select("id", "th", "text", "segments", "fresh").mapInArrow(window_rows(self.window), "h long, proof long, id long, th long, fresh boolean, place int"), "windows"
        )
        shared = stash.put(windows.groupBy("h", "proof").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").drop("last"), "shared")
        struck = windows.where("fresh").join(shared, ["h", "proof"]).where("id > owner").groupBy("id", "th").agg(F.collect_set("place").alias("places"))
        decided = held.where("fresh").select("id", "th", "text", "covered").join(struck, ["id", "th"], "left").where("size(covered) > 0 or places is not null")
        out = stash.put(
            decided.mapInArrow(strike(self.window), "id long, th long, n_removed long, kept_sha string, removed array<struct<first:int,stop:int>>"), "removed"
        )
        self.put(seen.where("not known").select("fp", "proof", "n"), "spans", 0)
        self.put(left.select("anchor", "id", "th", "first", "n"), "anchors", 0)
        self.compact()
        self.last_id = most
        self.save()
        stash.drop(held, windows, shared, judged, seen, several)
        return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 and the removed runs of words.

    Ids are integers. Documents enter a new index in ``batches`` of rising ids; the result does not depend on how many.
    Null text has no words. A null id stands after all others; rows with equal ids never remove each other's
    words. Texts shorter than a window keep all. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    stash = Stash(spark, "repeats")
    index = FingerprintIndex(spark, f"{stash.root}/index", window, gram, fanout)
    scanned = stash.put(index.segments(texts), "scan")
    documents = scanned.where("n_words is not null").select("id", "th", "n_words", "sha")
    segments = scanned.where("anchor is not null").drop("n_words", "sha")
    cuts = documents.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    removed = None
    lower = None
    for upper in [*sorted(set(cuts or [])), None]:
        part, own = segments, texts
        if lower is not None:
            part, own = part.where(F.col("id") > lower), own.where(F.col("id") > lower)
        if upper is not None:
            part, own = part.where(F.col("id") <= upper), own.where(F.col("id") <= upper)
        found = index.add(own, part)
        removed = found if removed is None else removed.unionByName(found)
        lower = upper
    index.close()
    removed = removed.dropDuplicates(["id", "th"])
    out = documents.join(removed, ["id", "th"], "left")
    return out.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).cast(kind).alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<struct<first:int,stop:int>>")).alias("removed"),
    )
