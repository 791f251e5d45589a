"""Merkle manifest of a dataset: a tree of digests over the rows of each part, and one over the parts.

Nodes are labelled by nested intervals: a node carries the ranks [lo, hi) of the leaves it covers, so that it is an
ancestor of what lies in its interval, and its siblings are its parent's interval without its own. Levels are bucketed
into bands of ``BAND``: within a band, the nodes above one bucket of 2**BAND neighbours have no others below
them. A band is grown bucket by bucket from the tops of the band below, and proofs are attached the other way, from
the root down, by a join of members and nodes on their bucket and containment of their intervals.
No task holds more than one bucket, and what a band's members share above it travels once for each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans.prefix import global_rank
from webloom.plans.tables import Stash

#: Levels of a band; a bucket has 2**BAND members at most.
BAND = 9
#: One level of a proof: the digests left and right of a node in its run, '' where there is none.
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
STEPS = "array<struct<left:string,right:string>>"
#: Columns of a proof beside those of its row.
ADDED = ("digest", "steps", "subroot", "root")
NODES = "part long, n long, level int, lo long, hi long, digest string"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: '-' if null, else the bytes of its text, ':' and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and the steps of its proof."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def depth(n: int) -> int:
    """Levels above n leaves."""
    return max(0, n - 1).bit_length()


def top_band(n: Column) -> Column:
    """The band in which the root of n leaves lies."""
    levels = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(1)
    return F.floor((levels - 1) / BAND).cast("int")


def grower(band: int):
    """Nodes of the band above one bucket's members (part, n, rank, digest), from their level up."""
    kinds = [("part", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("digest", pa.string())]
    base = band * BAND

    def grow(members: pa.Table) -> pa.Table:
        members = members.sort_by("rank")
        part, n, first = (members[c][0].as_py() for c in ("part", "n", "rank"))
        digests = members["digest"].to_pylist()
        found: dict[str, list] = {c: [] for c in ("level", "lo", "hi", "digest")}
        for level in range(base + 1, min(base + BAND, depth(n)) + 1):
            digests = [sha256("".join(digests[k : k + 2]).encode()).hexdigest() for k in range(0, len(digests), 2)]
            lo = (first >> (level - base) << level) + (np.arange(len(digests)) << level)
            for column, values in (("level", [level] * len(lo)), ("lo", lo), ("hi", np.minimum(lo + (1 << level), n)), ("digest", digests)):
                found[column].extend(values)
        m = len(found["level"])
        return pa.table({"part": [part] * m, "n": [n] * m, **found}, schema=pa.schema(kinds))

    return grow


def attacher(band: int):
    """Members of one bucket with their steps up to the root: those of the band's nodes, then the bucket's own.

    The other table has the band's nodes above the bucket, and one row with ``steps``: the rest of the way up, which
    all members share, with the roots at its ends.
    """
    base = band * BAND

    def attach(members: pa.Table, nodes: pa.Table) -> pa.Table:
        members = members.sort_by("rank")
        shared = nodes.filter(pc.is_valid(nodes["steps"]))
        nodes = nodes.filter(pc.is_valid(nodes["digest"])).sort_by([("level", "ascending"), ("lo", "ascending")])
        place, n, m = members["rank"].to_numpy() << base, members["n"][0].as_py(), members.num_rows
        level_of, lo_of, hi_of = (nodes[c].to_numpy() for c in ("level", "lo", "hi"))
        # all digests of the bucket, after an empty one that stands for no sibling
        digests = pa.concat_arrays([pa.array([""]), *members["digest"].chunks, *nodes["digest"].chunks])
        lo, hi, at, offset = place, np.minimum(place + (1 << base), n), np.arange(m), 1
        left, right = [], []
        for level in range(base + 1, min(base + BAND, depth(n)) + 1):
            above = np.flatnonzero(level_of == level)
            parent = np.searchsorted(lo_of[above], place, side="right") - 1
            parent_lo, parent_hi = lo_of[above][parent], hi_of[above][parent]
            if not ((parent_lo <= lo) & (hi <= parent_hi)).all():
                raise ValueError("a node is not inside its parent")
            # what the parent's interval has besides the node's own, on either side
            left.append(np.where(parent_lo < lo, offset + at - 1, 0))
            right.append(np.where(hi < parent_hi, offset + at + 1, 0))
            offset += m if level == base + 1 else np.count_nonzero(level_of == level - 1)
            lo, hi, at = parent_lo, parent_hi, parent
        own = [digests.take(pa.array(np.array(side, np.int64).T.ravel())) for side in (left, right)]
        up = shared["steps"].combine_chunks().flatten()
        flat = pa.concat_arrays([pa.StructArray.from_arrays(own, fields=list(STEP)), pa.StructArray.from_arrays([up.field("left"), up.field("right")], fields=list(STEP))])
        rows = np.arange(m)[:, None]
        order = np.concatenate([rows * len(left) + np.arange(len(left)), np.broadcast_to(m * len(left) + np.arange(len(up)), (m, len(up)))], axis=1)
        ends = np.arange(m + 1, dtype=np.int32) * order.shape[1]
        out = members.drop(["bucket"]).append_column("steps", pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(order.ravel()))))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array(shared[c].to_pylist() * m, pa.string()))
        return out

    return attach


@dataclass
class Tree:
    """Trees of several parts: the members of each band (part, n, rank, digest, ...) and the nodes that they grow."""

    members: list[DataFrame]
    nodes: list[DataFrame]

    def tops(self) -> DataFrame:
        """(part, n, digest): the root of each part; a lone leaf is its own."""
        found = self.members[0].where("n = 1").select("part", "n", "digest")
        for nodes in self.nodes:
            found = found.unionByName(nodes.where("lo = 0 and hi = n").select("part", "n", "digest"))
        return found


def grow_tree(leaves: DataFrame, most: int, stash: Stash) -> Tree:
    """The trees over written ``leaves`` (part, n, rank, digest, ...), of which no part has more than ``most``."""
    tree = Tree([leaves], [])
    for band in range(max(1, -(-depth(most) // BAND))):
        members = tree.members[band].select("part", "n", "rank", "digest", F.shiftright("rank", BAND).alias("bucket"))
        tree.nodes.append(stash.put(members.groupBy("part", "bucket").applyInArrow(grower(band), NODES), "nodes"))
        top = (band + 1) * BAND
        inner = tree.nodes[band].where((F.col("level") == top) & ((F.col("lo") > 0) | (F.col("hi") < F.col("n"))))
        tree.members.append(inner.select("part", "n", F.shiftright("lo", top).alias("rank"), "digest"))
    return tree


def attach_steps(tree: Tree, heads: DataFrame, stash: Stash) -> DataFrame:
    """The leaves with ``steps`` to the root, ``subroot`` and ``root``; ``heads`` (part, n, steps, subroot, root) has
    these for the root of each part."""
    above = None
    for band in reversed(range(len(tree.nodes))):
        # parts whose root lies in this band begin here, others with what the band above has
        start = heads.where(top_band(F.col("n")) == band).select("part", F.lit(0).cast("long").alias("bucket"), "steps", "subroot", "root")
        start = start if above is None else start.unionByName(above)
        nodes = tree.nodes[band].select("part", F.shiftright("lo", (band + 1) * BAND).alias("bucket"), "level", "lo", "hi", "digest")
        right = nodes.unionByName(start, allowMissingColumns=True)
        members = tree.members[band]
        kinds = T.StructType([*members.schema, *T._parse_datatype_string(f"steps {STEPS}, subroot string, root string")])
        left = members.withColumn("bucket", F.shiftright("rank", BAND))
        out = left.groupBy("part", "bucket").cogroup(right.groupBy("part", "bucket")).applyInArrow(attacher(band), kinds)
        if band:
            above = stash.put(out.select("part", F.col("rank").alias("bucket"), "steps", "subroot", "root"), "steps")
    return out


@dataclass
class Manifest:
    """The trees over the rows of each part, the tree over the parts, and the parts themselves."""

    rows: Tree
    over: Tree
    parts: DataFrame
    stash: Stash

    def nodes(self) -> DataFrame:
        """(key, level, lo, hi, digest): every inner node of the parts, by the ranks of the leaves it covers."""
        found = self.rows.nodes[0]
        for nodes in self.rows.nodes[1:]:
            found = found.unionByName(nodes)
        return found.join(self.parts.select("part", "key"), "part").select("key", "level", "lo", "hi", "digest")

    def proofs(self) -> DataFrame:
        """Every row with its leaf, the steps of its proof (from the leaf up), the root of its part and of all: the columns
        of the table, ``digest``, ``steps``, ``subroot``, ``root``."""
        root = self.over.tops().select("part", "n", F.array().cast(STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        of_parts = attach_steps(self.over, root, self.stash).select(F.col("rank").alias("part"), "steps", F.col("digest").alias("subroot"), "root")
        heads = self.stash.put(of_parts.join(self.parts.select("part", "n"), "part"), "heads")
        return attach_steps(self.rows, heads, self.stash).select("row.*", *ADDED)


def build_manifest(rows: DataFrame, part: str, order: str, leaf: str) -> Manifest:
    """The manifest of ``rows``: in each part, leaves ascend by ``order`` (null last; equal ones by their digests), and
    parts by bytes (null first).

    Proofs carry all columns of ``rows``, but for those with the name of a proof's own. Repeated rows are leaves of their
    own. An empty table has no parts, no root and no proofs.
    """
    stash = Stash(rows.sparkSession, "merkle")
    carried = F.struct(*(c for c in rows.columns if c.lower() not in ADDED)).alias("row")
    known = stash.put(rows.select(F.col(part).alias("key"), F.col(order).alias("sort"), F.col(leaf).alias("digest"), carried), "leaves")
    placed = stash.put(global_rank(known, stash, [F.asc_nulls_first("key"), F.asc_nulls_last("sort"), F.asc("digest")], "place").drop("sort"), "places")
    counted = stash.put(placed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")), "counted")
    parts = stash.put(global_rank(counted, stash, [F.asc_nulls_first("key")], "part"), "parts")
    sizes = parts.agg(F.count("*"), F.max("n")).first()
    ranked = placed.join(parts.withColumnRenamed("key", "part_key"), placed["key"].eqNullSafe(F.col("part_key")))
    leaves = stash.put(ranked.withColumn("rank", F.col("place") - F.col("first")).drop("place", "first", "part_key", "key"), "ranked")
    tree = grow_tree(leaves, sizes[1] or 0, stash)
    tops = tree.tops().select(F.lit(0).cast("long").alias("part"), F.lit(sizes[0]).cast("long").alias("n"), F.col("part").alias("rank"), "digest")
    return Manifest(tree, grow_tree(stash.put(tops, "tops"), sizes[0], stash), parts, stash)
