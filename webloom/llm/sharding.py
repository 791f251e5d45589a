"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends region, rack and shard. On each level every child c of the node reached draws
u_c in (0, 1) from a hash of (row key, level, c); the child with the smallest -ln(u_c) / weight_c
wins, so a child gets rows in proportion to its weight. When a weight changes, only draws of that
child change: rows move into or out of the subtree below it and nowhere else. A tree is laid out for a
number of shards; each shard added later opens a region of its own, so that no other weight changes and
rows move into the new shard alone, whatever the numbers are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.columns import hash_long
from webloom.plans.prefix import running_total
from webloom.plans.tables import spare

#: Pieces of each shard in which slots are counted; a shard of any size is so many windows.
SLOT_PIECES = 256


@dataclass
class Node:
    """A region, rack or shard; ``weight`` is that of its leaves."""

    name: str
    weight: float = 0.0
    shard: int = -1
    children: list[Node] = field(default_factory=list)


def tree(weights: list[float], shards_per_rack: int = 5, racks_per_region: int = 4, laid_out: int | None = None) -> Node:
    """Lays shards 0, 1, ... into racks and racks into regions; a full rack or region opens the next.

    Only the first ``laid_out`` shards, all if not given, share racks and regions; each later one has its own.
    """
    root = Node("root")
    first = len(weights) if laid_out is None else laid_out
    last_rack = max(0, first - 1) // shards_per_rack
    for shard, weight in enumerate(weights):
        rack = shard // shards_per_rack if shard < first else last_rack + 1 + shard - first
        region = rack // racks_per_region if shard < first else last_rack // racks_per_region + 1 + shard - first
        if region == len(root.children):
            root.children.append(Node(f"g{region}"))
        at = root.children[region]
        if not at.children or at.children[-1].name != f"r{rack}":
            at.children.append(Node(f"r{rack}"))
        at.children[-1].children.append(Node(f"s{shard}", weight, shard))
        for node in (root, at, at.children[-1]):
            node.weight += weight
    return root


def levels(root: Node) -> list[list[list[Node]]]:
    """For each level, the children of every node of the level above, in order."""
    found, above = [], [root]
    while above[0].children:
        found.append([node.children for node in above])
        above = [child for node in above for child in node.children]
    return found


def choose(key: Column, families: list[list[Node]], parent: Column) -> Column:
    """The place, on its level, of the child of ``parent`` with the smallest -ln(u) / weight."""
    place = 0
    known = []
    for children in families:
        members = []
        for child in children:
            members.append(F.struct(F.lit(child.name).alias("name"), F.lit(float(child.weight)).alias("weight"), F.lit(place).alias("place")))
            place += 1
        known.append(F.array(*members))

    def draw(child: Column) -> Column:
        u = (hash_long(F.concat(key, F.lit(":"), child["name"])).cast("double") + 0.5) / float(2**52)
        return F.struct((-F.ln(u) / child["weight"]).alias("d"), child["place"].alias("place"))

    return F.array_min(F.transform(F.filter(F.get(F.array(*known), parent), lambda c: c["weight"] > 0), draw))["place"]


def assign_shards(df: DataFrame, weights: list[float], id_col: str = "doc_id", out: str = "shard", laid_out: int | None = None) -> DataFrame:
    """Adds the shard of each row. A null id is the key "null"; repeated ids share a shard. ``laid_out`` is as in :func:`tree`.

    Every other column, whatever its name or content, passes through.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    root = tree(weights, laid_out=laid_out)
    at = F.lit(0)
    for families in levels(root):
        at = choose(key, families, at)
    return df.withColumn(out, at)


def number_slots(df: DataFrame, id_col: str = "doc_id", shard: str = "shard", out: str = "slot") -> DataFrame:
    """Adds gapless places from 0 within each shard, in a hashed order that part-sums make scalable."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    h, piece = spare(df, "h", "piece")
    hashed = df.withColumn(h, hash_long(F.concat(F.lit("slot:"), key))).withColumn(piece, F.shiftright(h, 52 - int(math.log2(SLOT_PIECES))))
    return running_total(hashed, [shard], piece, [h, id_col], F.lit(1).cast("long"), out).drop(h, piece)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document with size, checksum, shard, slot, and the shard were there one more.

    Null text has size 16 and checksum 0. Nulls, repeated rows and empty tables give rows (or none) by
    the same rule; further columns of ``docs`` are left out.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(rows, [1.0] * shards)
    grown = assign_shards(placed, [1.0] * (shards + 1), out="grown_shard", laid_out=shards)
    return number_slots(grown).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
