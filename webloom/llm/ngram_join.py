"""Jaccard self-join of documents on word shingles, by prefix filters under several token orders.

Documents with equal shingle sets are one node. If two sets are similar enough, then under *any* order of
the tokens their prefixes share a token. Three orders are used:

1. rarest class first, by a fixed-size table of token counts over all documents, then by hash: its prefix
   tokens are the join keys, with a bound from the token's places in both sets;
2. rarest coarse class first, then by another hash;
3. by a third hash alone.

A pair goes to verification only if it passes all three; in orders 2 and 3 the prefixes' common tokens and
what can still follow bound the overlap. Tokens start from one hash lane of the words, verification intersects
the whole sets of the other lane's, and sets count as equal only if they are so in both lanes.

Groups of near copies are not expanded. First each document meets only the member of its buckets that
stands earliest in order 1, and links make components; then buckets that still hold several components
compare members of their smaller components with the others. No pair inside one component is formed, and
no pair that could join two components is left out. The smaller set of a pair must have the shared token early
enough for both (what follows has to hold the whole overlap), so a token that is late in all its sets makes no
pairs, however many sets have it; a token with many members is cut into salted blocks.

All links lie inside components, so they are counted there, once the components are known: every pair of
different sets of a component is compared, a component's members being cut into salted blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.wordhash import GOLDEN, U, mix, word_blocks
from webloom.plans.components import connected_components
from webloom.plans.tables import Stash, bounded, small_batches, spare

SHINGLE = 5
PERCENT = 80
#: The table of token counts: one counter for each row, by powers of two, so that rare tokens stay apart from frequent
#: ones as the corpus grows; 2**20 at least, and 2**26 at most, which is 64 MB when broadcast.
LEAST_COUNTERS, MOST_COUNTERS = 1 << 20, 1 << 26
CHUNK = 1 << 12
#: Tokens that a task holds before it counts them.
HELD_TOKENS = 1 << 16
#: Rounds in which documents meet one bucket member before all remaining pairs are formed.
STAR_ROUNDS = 2
#: A component of more sets, or of more tokens in all, than these is cut into blocks when its links are counted.
BLOCK_SETS = 16
BLOCK_TOKENS = 1 << 19
#: A token's members are cut into the root of so many of them.
BLOCK_MEMBERS = 1 << 10
#: The id that stands for null: larger than any other.
LAST_ID = (1 << 63) - 1


def shingle_sets(column: pa.Array, size: int, lanes: tuple[int, ...]) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text in each of the lanes, words lower-cased in A-Z."""
    for block in word_blocks(column, lower=True):
        words, begins = block.lanes, block.begins
        n = max(0, words.shape[1] - size + 1)
        grams = []
        for lane in lanes:
            of = np.full(n, U(size))
            for k in range(size):
                of = mix(of * GOLDEN + words[lane, k : k + n])
            grams.append(of)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= size:
                yield [sorted_distinct(of[a : b - size + 1]) for of in grams]
            elif b > a:  # fewer words than a shingle: the whole sequence is one
                found = []
                for lane in lanes:
                    one = np.full(1, U(b - a))
                    for k in range(a, b):
                        one = mix(one * GOLDEN + words[lane, k : k + 1])
                    found.append(one)
                yield found
            else:
                yield [of[:0] for of in grams]


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def counters_for(rows: int) -> int:
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, rows - 1).bit_length()))


def scan_sets(size: int, counters: int):
    """A row per document with its set's size and hashes; a task's token counts as compressed chunks."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def add(counts: np.ndarray, held: list[np.ndarray]) -> None:
        at, more = np.unique((np.concatenate(held) & U(counters - 1)).astype(np.int64), return_counts=True)
        counts[at] += more.astype(np.int32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int32)
        held: list[np.ndarray] = []
        size_held = 0
        for batch in batches:
            out = []
            for name, th, (tokens, others) in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), shingle_sets(batch["text"], size, (0, 1)), strict=True):
                out.append({"id": name, "th": th, "n": len(tokens), "s1": set_digest(tokens), "s2": set_digest(others)})
                held.append(tokens)
                size_held += len(tokens)
                if size_held > HELD_TOKENS:
                    add(counts, held)
                    held, size_held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            add(counts, held)
        chunks = [(k, counts[k * CHUNK : (k + 1) * CHUNK]) for k in range(counters // CHUNK)]
        yield pa.RecordBatch.from_pylist([{"chunk": k, "counts": zlib.compress(c.tobytes(), 1)} for k, c in chunks if c.any()], schema=schema)

    return scan


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums chunks as they stream by: one counter array per chunk number, however many tasks sent one."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(c), np.int32).astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    classes = [np.floor(4 * np.log2(c + 1.0)).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], names=["chunk", "classes"])


def rarity(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(tokens & U(len(table) - 1)).astype(np.int64)].astype(U)


def first_order(tokens: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The prefix in order 1: rarity class, then hash."""
    key = (rarity(tokens, table) << U(56)) | (mix(tokens) >> U(8))
    return tokens[np.argsort(key, kind="stable")[: prefix_length(len(tokens), percent)]]


def other_orders(tokens: np.ndarray, table: np.ndarray, percent: int) -> tuple[bytes, bytes]:
    """The prefixes in orders 2 and 3, as sorted 32-bit keys (ties only loosen the bound)."""
    p = prefix_length(len(tokens), percent)
    two = ((rarity(tokens, table) >> U(3)) << U(24)) | (mix(tokens ^ U(0xA4093822299F31D0)) >> U(40))
    three = mix(tokens ^ U(0x082EFA98EC4E6C89)) >> U(32)
    return tuple(np.sort(v.astype(np.uint32))[:p].tobytes() for v in (two, three))


def overlap_bound(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """At most so many tokens are common: those seen below both prefixes' ends, and all that may follow."""
    end = min(x[-1], y[-1])
    a, b = x[x < end], y[y < end]
    values, counts = np.unique(a, return_counts=True)
    others, more = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(values, others, assume_unique=True, return_indices=True)
    return int(np.minimum(counts[i], more[j]).sum()) + min(nx - len(a), ny - len(b))


def pass_orders(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("na", "nb", "a2", "b2", "a3", "b3")), strict=True)
            passed = [
                all((100 + percent) * overlap_bound(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), na, nb) >= percent * (na + nb) for x, y in ((a2, b2), (a3, b3)))
                for na, nb, a2, b2, a3, b3 in rows
            ]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(passed, pa.bool_()))

    return keep


def verify_pairs(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                a, b = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                links.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return check


def common_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """How many tokens each of the ``first`` sets shares with each of the others, or with each other if there are no others."""
    m, n = len(sets), [len(t) for t in sets]
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    column = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1])))
    several = np.bincount(column)[column] > 1  # the others are common to no pair
    owner, column = owner[several], column[several]
    if len(column):
        column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1])))
    width = max(256, (1 << 22) // m)
    common = np.zeros((first, m - first if first < m else m), np.int64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        marks = np.zeros((m, int(column[hi - 1]) - a + 1), np.float32)
        marks[owner[lo:hi], column[lo:hi] - a] = 1
        common += (marks[:first] @ (marks[first:] if first < m else marks).T).astype(np.int64)
    return common


def link_blocks(size: int, percent: int, pairs: bool):
    """For each pair of blocks, rows of which stand together: every link (a, b), or how many links each set has."""

    def settle(sets: dict[tuple, np.ndarray], first: int) -> tuple[list, list]:
        names, tokens = list(sets), list(sets.values())
        n = np.array([len(t) for t in tokens])
        common = common_counts(tokens, first)
        others = n if first == len(n) else n[first:]
        linked = 100 * common >= percent * (n[:first, None] + others[None, :] - common)
        if first == len(n):
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        j += 0 if first == len(n) else first
        if pairs:
            one, two = ([names[k][0] for k in at] for at in (i, j))
            return [min(x) for x in zip(one, two, strict=True)], [max(x) for x in zip(one, two, strict=True)]
        return names, (np.bincount(i, minlength=len(n)) + np.bincount(j, minlength=len(n))).tolist()

    def batch_of(one: list, two: list) -> pa.RecordBatch:
        if pairs:
            return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])
        ids, hashes = ([name[k] for name in one] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(two, pa.int64())], names=["id", "s2", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, first = None, {}, 0
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("component", "one", "two", "salt", "id", "s2"))
            for component, one, two, salt, name, s2, (tokens,) in zip(*columns, shingle_sets(batch["text"], size, (1,)), strict=True):
                if (component, one, two) != now:
                    if first and len(sets) > 1 and (first < len(sets) or now[1] == now[2]):
                        yield batch_of(*settle(sets, first))
                    now, sets, first = (component, one, two), {}, 0
                # another text with the same id has another hash; a row may be there twice
                if (name, s2) not in sets and set_digest(tokens) == s2:
                    sets[name, s2] = tokens
                    first += salt == one
        if first and len(sets) > 1 and (first < len(sets) or now[1] == now[2]):
            yield batch_of(*settle(sets, first))

    return run


class Join:
    """The stages of one self-join."""

    def __init__(self, texts: DataFrame, size: int, percent: int) -> None:
        self.texts, self.size, self.percent = texts, size, percent
        self.spark = texts.sparkSession
        small_batches(self.spark)
        self.stash = Stash(self.spark, "ngrams")
        self.counters = counters_for(texts.count())

    def run(self, count_links: bool = False) -> DataFrame:
        """(id, n_shingles, component) per row of the texts; if asked, also links and component_links."""
        documents, classes = self.classes()
        columns = ["id", "n", "component"]
        rest = documents.where("n = 0").select("id", "n", F.col("id").alias("component"))
        if count_links:
            classes = self.with_links(classes)
            columns += ["links", "component_links"]
            rest = rest.select("*", *(F.lit(0).cast("long").alias(c) for c in columns[3:]))
        linked = documents.where("n > 0").join(classes, ["n", "s1", "s2"]).select(columns)
        return linked.unionByName(rest)

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(id, th, n, s1, s2) per row of the texts, and (n, s1, s2, node, component) per different set."""
        size, stash = self.size, self.stash
        scanned = stash.put(self.texts.withColumn("th", F.xxhash64("text")).mapInArrow(scan_sets(size, self.counters), "id long, th long, n long, s1 long, s2 long, chunk int, counts binary"), "scan")
        documents = scanned.where("n is not null").select("id", "th", "n", "s1", "s2")
        nodes = stash.put(documents.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("node")), "nodes")
        self.counts = scanned.where("chunk is not null").select("chunk", "counts")
        found = self.components(nodes)
        if found is None:
            classes = nodes.withColumn("component", F.col("node"))
        else:
            found = bounded(found)
            classes = nodes.join(found, nodes["node"] == found["id"], "left").select("n", "s1", "s2", "node", F.coalesce("component", "node").alias("component"))
        return documents, stash.put(classes.select("n", "s1", "s2", "node", "component"), "classes")

    def blocks(self, classes: DataFrame) -> DataFrame:
        """The texts of components of several sets, each in every pair of its component's blocks that has its block.

        A component of m sets has about the root of m / 16 blocks, more if its sets are long: the pairs of
        blocks are dealt over the tasks, none holds more than two blocks, and a text is sent once a block.
        """
        of = classes.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).where("m > 1")
        of = of.select("component", F.greatest(F.ceil(F.sqrt(F.col("m") / BLOCK_SETS)), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("k"))
        of = bounded(self.stash.put(of, "several"))
        members = classes.join(of, "component").select(F.col("node").alias("id"), "s2", "component", "k", F.pmod(F.xxhash64("node", "s2"), "k").cast("int").alias("salt"))
        members = bounded(self.stash.put(members, "linked"))
        texts = self.texts.join(members, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = texts.select("component", F.least("salt", "other").alias("one"), F.greatest("salt", "other").alias("two"), "salt", "id", "s2", "text")
        keys = ["component", "one", "two"]
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "salt")

    def with_links(self, classes: DataFrame) -> DataFrame:
        """Adds how many other sets each set is linked with, and how many links its component has."""
        several = classes.groupBy("component").agg(F.count("*").alias("m"), (F.min("node") != F.max("node")).alias("apart")).where("m > 1")
        kinds = classes.join(bounded(self.stash.put(several, "sizes")), "component").withColumn("alone", (F.col("m") == 2) & F.col("apart"))  # two sets are there by their one link
        kinds = self.stash.put(kinds, "kinds")
        found = self.blocks(kinds.where("not alone")).mapInArrow(link_blocks(self.size, self.percent, False), "id long, s2 long, links long")
        found = self.stash.put(found.groupBy(F.col("id").alias("node"), "s2").agg(F.sum("links").alias("links")), "degrees")
        counted = kinds.join(found, ["node", "s2"], "left").withColumn("links", F.when(F.col("alone"), 1).otherwise(F.coalesce("links", F.lit(0))).cast("long"))
        counted = self.stash.put(counted.select("n", "s1", "s2", "component", "links"), "counted")
        totals = self.stash.put(counted.groupBy("component").agg((F.sum("links") / 2).cast("long").alias("component_links")), "totals")
        counted = counted.join(bounded(totals), "component").drop("component")
        linked = classes.select("n", "s1", "s2", "component").join(counted, ["n", "s1", "s2"], "left")
        return linked.fillna(0, ["links", "component_links"])

    def grown(self, components: DataFrame | None, links: DataFrame) -> DataFrame:
        """The components after some more links, from those before."""
        if components is not None:
            links = links.unionByName(components.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b")))
        return self.stash.put(connected_components(links, self.stash), "components")

    def components(self, nodes: DataFrame) -> DataFrame | None:
        """(id, component) of the nodes that have a link, by verified links that connect every component."""
        size, percent, stash = self.size, self.percent, self.stash
        parts = self.counts.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
        table = np.zeros(self.counters, np.uint8)
        for row in parts.mapInArrow(add_counts, "chunk int, classes binary").toLocalIterator():  # one byte a counter
            table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["classes"], np.uint8)
        known = self.spark.sparkContext.broadcast(table)
        least = -(-percent // (100 - percent))  # smaller sets are similar only if equal

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {"id": [], "s1": [], "tokens": []}
                for name, (tokens,) in zip(batch["id"].to_pylist(), shingle_sets(batch["text"], size, (0,)), strict=True):
                    if len(tokens) >= least:
                        out["id"].append(name)
                        out["s1"].append(set_digest(tokens))
                        out["tokens"].append(first_order(tokens, known.value, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["s1"], pa.int64()), pa.array(out["tokens"], pa.list_(pa.int64()))], names=["id", "s1", "tokens"])

        prefixed = self.texts.mapInArrow(prefixes, "id long, s1 long, tokens array<long>")
        own = nodes.where(F.col("n") >= least).select(F.col("node").alias("id"), "s1", "n")
        keyed = stash.put(prefixed.join(own, ["id", "s1"]).dropDuplicates(["id", "s1"]), "prefixes")
        postings = keyed.select("id", "n", F.posexplode("tokens").alias("place", "token"))
        shared = stash.put(postings.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"), "shared")
        live = stash.put(postings.join(shared, "token", "left_semi"), "live")
        pivots = live.groupBy("token").agg(F.min(F.struct("place", "id", "n")).alias("p"))
        starred = stash.put(live.join(pivots, "token").where("id != p.id").where(self.may_match("n", "p.n", "place", "p.place")), "starred")
        self.keys, self.known = keyed.select("id", "s1"), known

        tested = None
        components = None
        for _ in range(STAR_ROUNDS):
            star = self.with_components(starred, components, "id", "p.id")
            pairs = star.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), "id", (F.col("place") + F.col("p.place")).alias("cost"))
            if tested is not None:
                pairs = pairs.join(bounded(tested), ["a", "b"], "left_anti")
            chosen = pairs.groupBy("id").agg(F.min(F.struct("cost", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
            chosen = stash.put(chosen, "star")
            links = self.settle(chosen)
            tested = chosen if tested is None else tested.unionByName(chosen)
            if links.isEmpty():
                break
            components = self.grown(components, links)
        rest = self.remaining(live, components)
        if tested is not None:
            rest = rest.join(bounded(tested), ["a", "b"], "left_anti")
        links = self.settle(stash.put(rest.distinct(), "rest"))
        if not links.isEmpty():
            components = self.grown(components, links)
        stash.drop(keyed, shared, live, starred)
        return components

    def may_match(self, nx: str, ny: str, px: str, py: str):
        """Lengths, and what can be common from a shared token at these places on, allow a link."""
        t = self.percent
        nx, ny, px, py = (F.col(c) for c in (nx, ny, px, py))
        return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * t) & (F.least(nx - px, ny - py) * (100 + t) >= (nx + ny) * t)

    def with_components(self, rows: DataFrame, components: DataFrame | None, one: str, two: str) -> DataFrame:
        """Keeps rows whose two nodes lie in different components."""
        if components is None:
            return rows
        components = bounded(components)
        x = components.select(F.col("id").alias("x_id"), F.col("component").alias("x"))
        y = components.select(F.col("id").alias("y_id"), F.col("component").alias("y"))
        joined = rows.join(x, F.col(one) == F.col("x_id"), "left").join(y, F.col(two) == F.col("y_id"), "left")
        return joined.where(F.coalesce("x", F.col(one)) != F.coalesce("y", F.col(two))).drop("x", "y", "x_id", "y_id")

    def remaining(self, live: DataFrame, components: DataFrame | None) -> DataFrame:
        """Pairs of different components that share a bucket, from the side of its smaller components."""
        rows = live.select("token", "id", "n", "place")
        if components is None:
            rows = rows.withColumn("component", F.col("id"))
        else:
            rows = rows.join(bounded(components), "id", "left").withColumn("component", F.coalesce("component", F.col("id")))
        rows = self.stash.put(rows, "members")
        sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
        mixed = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("kinds"), F.sum("size").alias("all")).where("kinds > 1")
        mixed = self.stash.put(mixed.select("token", F.col("most.component").alias("main"), F.ceil(F.sqrt(F.col("all") / BLOCK_MEMBERS)).cast("int").alias("k")), "mixed")
        minor, early = F.col("component") != F.col("main"), (F.col("n") - F.col("place")) * (100 + self.percent) >= 2 * self.percent * F.col("n")
        members = self.stash.put(rows.join(bounded(mixed), "token").select("*", minor.alias("minor"), early.alias("early")).drop("main"), "mixed_members")
        x = members.where("early").select(F.col("token").alias("x_token"), F.pmod(F.xxhash64("id"), "k").cast("int").alias("x_salt"), *(F.col(c).alias(f"x_{c}") for c in ("id", "n", "place", "component", "minor")))
        y = members.select(F.col("token").alias("y_token"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("y_salt"), *(F.col(c).alias(f"y_{c}") for c in ("id", "n", "place", "component", "minor")))
        pairs = None
        for one, two in ((x.where("x_minor"), y), (x.where("not x_minor"), y.where("y_minor"))):
            met = (F.col("x_token") == F.col("y_token")) & (F.col("x_salt") == F.col("y_salt")) & (F.col("x_component") != F.col("y_component")) & (F.col("x_n") <= F.col("y_n"))
            joined = one.join(two, met & self.may_match("x_n", "y_n", "x_place", "y_place"))
            found = joined.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
            pairs = found if pairs is None else pairs.unionByName(found)
        return pairs

    def whole_sets(self, pairs: DataFrame) -> DataFrame:
        """(id, n, tokens, o2, o3) of the nodes in the pairs, from their texts."""
        size, percent, known = self.size, self.percent, self.known

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {k: [] for k in ("id", "n", "tokens", "o2", "o3")}
                for name, s1, (tokens, others) in zip(batch["id"].to_pylist(), batch["s1"].to_pylist(), shingle_sets(batch["text"], size, (0, 1)), strict=True):
                    if set_digest(tokens) == s1:  # else another text with the same id
                        for k, v in zip(out, (name, len(tokens), others.tobytes(), *other_orders(tokens, known.value, percent)), strict=True):
                            out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

        ids = bounded(self.stash.put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"))
        wanted = bounded(self.stash.put(self.keys.join(ids, "id", "left_semi"), "wanted"))
        texts = self.texts.join(wanted, "id").select("id", "s1", "text")
        return self.stash.put(texts.mapInArrow(sets, "id long, n long, tokens binary, o2 binary, o3 binary"), "sets")

    def settle(self, pairs: DataFrame) -> DataFrame:
        """Filters and verifies pairs; gives those that are links."""
        sets = self.whole_sets(pairs)
        asked = bounded(pairs)
        light = sets.select("id", "n", "o2", "o3")
        a = light.join(asked, F.col("id") == F.col("a")).select("a", "b", F.col("n").alias("na"), F.col("o2").alias("a2"), F.col("o3").alias("a3"))
        b = light.join(asked, F.col("id") == F.col("b")).select("a", "b", F.col("n").alias("nb"), F.col("o2").alias("b2"), F.col("o3").alias("b3"))
        passed = bounded(self.stash.put(a.join(b, ["a", "b"]).mapInArrow(pass_orders(self.percent), "a long, b long"), "passed"))
        x = sets.join(passed, F.col("id") == F.col("a")).select("a", "b", F.col("tokens").alias("sa"))
        y = sets.join(passed, F.col("id") == F.col("b")).select("a", "b", F.col("tokens").alias("sb"))
        new = self.stash.put(x.join(y, ["a", "b"]).mapInArrow(verify_pairs(self.percent), "a long, b long"), "links")
        self.stash.drop(sets)
        return new


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def as_id(docs: DataFrame, id_col: str, found: str):
    return F.when(F.col(found) != LAST_ID, F.col(found)).cast(docs.schema[id_col].dataType)


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: (id, n_shingles, component_id), the least id reachable by links, itself included.

    Null, empty and wordless texts have an empty set and are linked with nothing; a text of fewer words than
    a shingle is one shingle. Ids are integers; a null id stands after all others. Rows that share an id and
    a text are the same node; rows that share an id but not a text count as linked. An empty table gives no
    rows. Columns besides id and text are left out.
    """
    found = Join(texts_of(docs, id_col, text_col), size, percent).run()
    return found.select(as_id(docs, id_col, "id").alias(id_col), F.col("n").alias("n_shingles"), as_id(docs, id_col, "component").alias("component_id"))


def count_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``join_similar`` with n_links, to how many other sets the row's set is linked, and component_links in all.

    A link joins two different shingle sets, however many documents have them, and is counted once.
    """
    found = Join(texts_of(docs, id_col, text_col), size, percent).run(count_links=True)
    ids = as_id(docs, id_col, "id").alias(id_col), F.col("n").alias("n_shingles"), as_id(docs, id_col, "component").alias("component_id")
    return found.select(*ids, F.col("links").alias("n_links"), "component_links")


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): each link between two different shingle sets, named by the least ids that have them.

    With ``join_similar``, rows grow with the square of a group of near copies: they are asked for here only.
    """
    join = Join(texts_of(docs, id_col, text_col), size, percent)
    found = join.stash.put(join.blocks(join.classes()[1]).mapInArrow(link_blocks(size, percent, True), "a long, b long"), "pairs")
    return found.select(as_id(docs, id_col, "a").alias("a"), as_id(docs, id_col, "b").alias("b"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one of each group of similar documents, all columns kept: that with the least id.

    Of rows with that id, one text stays; of rows that repeat both id and text, one row. Wordless texts are similar to
    nothing, so all stay, but for such repeats. A null id stands after all others. An empty table gives no rows.
    """
    join = Join(texts_of(docs, id_col, text_col), size, percent)
    documents, classes = join.classes()
    text = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    found = documents.where("n > 0").join(classes.select("n", "s1", "s2", "component"), ["n", "s1", "s2"])
    first = found.groupBy("component").agg(F.min(F.struct("id", "th")).alias("m"), F.count("*").alias("rows"))
    kept = first.select("m.id", "m.th").unionByName(documents.where("n = 0").select("id", "th").distinct())
    kept = join.stash.put(kept, "kept")
    repeated = documents.groupBy("id", "th").agg(F.count("*").alias("rows")).where("rows > 1")
    kept = join.stash.put(kept.join(bounded(join.stash.put(repeated, "repeated")), ["id", "th"], "left").select("id", "th", F.col("rows").isNotNull().alias("many")), "keys")
    same_id, same_text, many = spare(docs, "same_id", "same_text", "many")
    keys = bounded(kept.withColumnsRenamed({"id": same_id, "th": same_text, "many": many}))
    held = docs.join(keys, (F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)) == keys[same_id]) & (text == keys[same_text]))
    once = held.where(~F.col(many)).select(docs.columns)
    return once.unionByName(held.where(F.col(many)).dropDuplicates([id_col, same_text]).select(docs.columns))
