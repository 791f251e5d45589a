"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

Benchmark words get a code each, and every window of consecutive item words becomes a pattern of codes.
A document's words are mapped to the same codes (words that no item has share one code outside the
alphabet), and the automaton reads the resulting sequence once. Match ends are word places, so a hit maps
back to the words' offsets in the original text.

Documents are read once, whatever the size of the benchmark, and are not moved. The coded items are broadcast, a
few bytes a word; a task holds the automaton of ``block_words`` of them at a time, and passes its batch through
one after the other if there are more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.tables import small_batches

WINDOW = 13
#: Benchmark words of one automaton: some 13 nodes for each.
BLOCK_WORDS = 200_000
#: Lower-cases A-Z and makes a space of every other ASCII byte that is no letter or digit.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def char_of(code: int) -> str:
    """The code as one character, past the surrogates, which no text may hold alone."""
    return chr(code if code < 0xD800 else code + 0x800)


class Patterns:
    """Some items, coded; their windows become an automaton where they are looked for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, str] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, char_of(len(self.vocabulary) + 1))
        self.items = [(name, "".join([self.vocabulary[w] for w in words])) for name, words in items]

    def build(self) -> tuple[ahocorasick.Automaton | None, list[tuple[int, list[str]]]]:
        """The automaton over distinct windows, and the length and item names of each."""
        owners: dict[str, set[str]] = {}
        for name, coded in self.items:
            for at in range(max(1, len(coded) - self.window + 1)):
                owners.setdefault(coded[at : at + self.window], set()).add(name)
        automaton = ahocorasick.Automaton() if owners else None
        for k, pattern in enumerate(owners):
            automaton.add_word(pattern, k)
        if owners:
            automaton.make_automaton()
        return automaton, [(len(pattern), sorted(names)) for pattern, names in owners.items()]

    def find(self, built: tuple, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """The places of words inside any match, and the items matched."""
        automaton, owners = built
        if automaton is None:
            return None, set()
        get = self.vocabulary.get
        edges, names = None, set()
        for end, k in automaton.iter("".join([get(w, "\0") for w in words])):
            if edges is None:
                edges = np.zeros(len(words) + 1, np.int64)
            length, owned = owners[k]
            edges[end + 1 - length] += 1
            edges[end + 1] -= 1
            names.update(owned)
        return (None if edges is None else np.flatnonzero(np.cumsum(edges[:-1]) > 0)), names


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Patterns]:
    """Benchmark items in blocks of bounded size; an item longer than a block is cut with overlap."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    for name, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        for at in range(0, len(words), block_words):
            piece = words[at : at + block_words + window - 1]
            if at and len(piece) < window:
                continue
            if size + len(piece) > block_words + window and held:
                yield Patterns(held, window)
                held, size = [], 0
            held.append((name, piece))
            size += len(piece)
    yield Patterns(held, window)


RESULT = pa.schema([
    ("id", pa.string()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def spans_of(text: bytes, places: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of the runs of the words at these places."""
    at = [m.span() for m in WORD.finditer(text.decode("utf-8", "replace"))]
    cuts = np.flatnonzero(np.diff(places, prepend=-2, append=places[-1] + 2) != 1)
    return [{"start": at[places[a]][0], "end": at[places[b - 1]][1]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def search(blocks: list):
    """Passes each batch of texts through the automata of all blocks (broadcast :class:`Patterns`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            rows = batch.num_rows
            n_words, hits, names = [0] * rows, [None] * rows, [set() for _ in range(rows)]
            for block in blocks:
                if built is None or len(blocks) > 1:
                    built = None  # the one before goes first
                    built = block.value.build()
                for row in range(rows):
                    words = words_of(texts[row].as_py() or b"")
                    places, found = block.value.find(built, words)
                    n_words[row] = len(words)
                    names[row] |= found
                    if places is not None:
                        hits[row] = places if hits[row] is None else np.union1d(hits[row], places)
            spans = [[] if places is None else spans_of(texts[row].as_py(), places) for row, places in enumerate(hits)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["th"], pa.array(n_words), pa.array([0 if places is None else len(places) for places in hits]), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, RESULT.field("spans").type)], schema=RESULT
            )

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per document: its words, the words that benchmark windows hit, where, and of which items.

    ``spans`` are code-point offsets of runs of hit words in the original text; text_hash is xxhash64 of the text (of
    "" for null) and tells rows with one id apart. Null text has no words; an item without words matches nothing; a
    null item id is named "null"; items with equal ids count once. A document is contaminated if at least 5 in 100 of
    its words are hit. Repeated rows give repeated rows; an empty table gives none; other columns are left out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    blocks = [docs.sparkSession.sparkContext.broadcast(patterns) for patterns in item_blocks(benchmark, window, block_words)]
    found = rows.mapInArrow(search(blocks), "id string, th long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>")
    n_hit = F.col("n_hit")
    return found.select(
        F.col("id").cast(kind).alias(id_col), "n_words", "n_hit", "items", "spans",
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), F.col("th").alias("text_hash"),
    )
