"""SentencePiece BPE encoding and decoding in rounds of vectorised merges.

All texts of a block lie in one flat array of symbols, one for each character. Words are cut where no piece of the
vocabulary has two neighbouring characters side by side, so that nothing is merged across a cut. In each round every
word finds the smallest rank among its neighbouring pairs and merges, from the left, all pairs of that rank that do
not overlap; words without a pair leave, and the array is compacted. It ends when no pair remains.

Merging one pair at a time, the best first and the leftmost of equals, could choose a pair that a merge has just made
before the next pair of the same rank. A word where this happens keeps only the merges up to that place in the round.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.tables import spare

#: What stands for a space in pieces.
MARK = "▁"
#: Characters of a block of texts; a longer text is cut between its words.
BLOCK_CHARS = 1 << 17
#: Ids that are decoded at a time.
BLOCK_IDS = 1 << 17
NONE = np.iinfo(np.int32).max
CODES = 0x110000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Pairs of symbols by open hashing in arrays, and the piece that each makes; -1 for pairs that only stand in pieces."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (3 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        for key, at, made in zip(keys.tolist(), self.slots(keys).tolist(), pairs.values(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.made[at] = key, made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair makes, -1 for nothing, and whether the table has it."""
        keys = left.astype(np.int64)
        keys <<= 32
        keys |= right
        at = self.slots(keys)
        found = self.keys.take(at)
        there = found == keys
        probing = np.flatnonzero((found >= 0) & ~there)
        while len(probing):
            at[probing] = (at[probing] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[probing]]
            same = found == keys[probing]
            there[probing] = same
            probing = probing[~same & (found >= 0)]
        made = self.made.take(at)
        made[~there] = -1
        return made, there


@dataclass
class Vocabulary:
    """Pieces by id, and tables over symbols: a symbol is a piece's id, or a number after them for other characters of
    pieces; a character that no piece has is -1 minus its code."""

    pieces: list[str]
    end: int
    control: frozenset[int]
    unknown: int
    first_byte: int
    #: The symbol of each code point.
    symbols: np.ndarray
    #: The characters of the symbols after the pieces.
    others: list[str]
    pairs: PairTable
    #: The rank of each piece, and at the end NONE.
    ranks: np.ndarray
    #: Symbol and longest run of characters whose runs all have one rank, by that rank.
    runs: dict[int, tuple[int, int]]
    #: Whether marks stand only at the start of pieces.
    spaced: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a model of kind BPE with byte fallback, a dummy prefix and no other normalisation; others raise.

    The file is read where this is called; what comes of it, a few megabytes for 32,000 pieces, goes to the tasks.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm, kind = model.normalizer_spec, proto.ModelProto.SentencePiece
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    of = lambda *kinds: [k for k, p in enumerate(model.pieces) if p.type in kinds]
    normal, as_bytes, unknown = of(kind.NORMAL), of(kind.BYTE), of(kind.UNKNOWN)
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not plain or len(as_bytes) != 256 or len(unknown) != 1 or of(kind.USER_DEFINED, kind.UNUSED):
        raise ValueError("needs BPE with byte fallback, a dummy prefix, and no other normalisation or piece kinds")
    if as_bytes != list(range(as_bytes[0], as_bytes[0] + 256)) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("needs byte pieces in order and white space as a prefix")

    pieces = [p.piece for p in model.pieces]
    known = {pieces[k]: k for k in normal}
    others = sorted({c for k in normal for c in pieces[k]} - set(known))
    known |= {c: len(pieces) + k for k, c in enumerate(others)}
    # equal scores are one rank
    _, ranks = np.unique([-model.pieces[k].score for k in normal], return_inverse=True)
    pairs: dict[tuple[int, int], int] = {}
    for k in normal:  # characters side by side in a piece, whether they make one or not
        pairs.update({(known[a], known[b]): -1 for a, b in zip(pieces[k], pieces[k][1:], strict=False)})
    for k in normal:
        for cut in range(1, len(pieces[k])):
            left, right = known.get(pieces[k][:cut]), known.get(pieces[k][cut:])
            if left is not None and right is not None:
                pairs[left, right] = k
    symbols = -1 - np.arange(CODES, dtype=np.int32)
    for text, k in known.items():
        if len(text) == 1:
            symbols[ord(text)] = k
    spaced = not any(re.search(f"[^{MARK}]{MARK}", pieces[k]) for k in normal)
    rank_of = np.full(len(pieces) + 1, NONE, np.int32)
    rank_of[normal] = ranks
    out = Vocabulary(pieces, model.trainer_spec.eos_id, frozenset(of(kind.CONTROL)), unknown[0], as_bytes[0], symbols, others, PairTable(pairs), rank_of, {}, spaced)
    out.runs = tied_runs(out, [pieces[k] for k in normal], ranks)
    return out


def tied_runs(vocabulary: Vocabulary, texts: list[str], ranks: np.ndarray) -> dict[int, tuple[int, int]]:
    """Ranks that several pieces share, all of them runs of one character: that character's symbol, and the longest run.

    Of equal ranks the leftmost goes first, so a long run grows from its left end until it is as long as the longest
    piece; then the rest begins anew. It holds if these are all runs of the character, if no piece has another before
    it or goes on from the longest run, and if that run comes out as one piece.
    """
    found = {}
    for rank in np.flatnonzero(np.bincount(ranks) > 1).tolist():
        tied = [texts[k] for k in np.flatnonzero(ranks == rank)]
        longest = max(tied, key=len)
        c = longest[0]
        symbol = int(vocabulary.symbols[ord(c)])
        others = (t for t in texts if t != longest)
        only_runs = all(set(t) == {c} for t in tied) and {t for t in tied if len(t) > 1} == {t for t in texts if len(t) > 1 and set(t) == {c}}
        if only_runs and not any(longest in t or re.search(f"[^{re.escape(c)}]{re.escape(c)}", t) for t in others) and len(merge_texts([longest], vocabulary)[0]) == 1:
            found[rank] = (symbol, len(longest))
    return found


def merge_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts one after the other, and the number of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes), np.iinfo(np.int32).min, np.int32)
    if len(codes):
        begins = np.zeros(len(codes) + 1, bool)
        begins[np.cumsum(sizes) - sizes] = True
        for symbols, place in merge_rounds(vocabulary.symbols[codes], begins[:-1], vocabulary):
            out[place] = symbols
    there = out > np.iinfo(np.int32).min
    upto = np.append(0, np.cumsum(there))[np.append(0, np.cumsum(sizes))]
    return as_ids(out[there], np.diff(upto), vocabulary)


def merge_rounds(symbols: np.ndarray, begins: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Final symbols and their places, in the rounds in which their words are done. ``begins`` marks starts of texts."""
    place = np.arange(len(symbols), dtype=np.int32)
    # what each symbol makes with the next one, -1 for nothing
    made = np.full(len(symbols), -1, np.int32)
    made[:-1], together = vocabulary.pairs.find(symbols[:-1], symbols[1:])
    begins = begins.copy()
    begins[1:] |= ~together
    made[:-1][begins[1:]] = -1
    while len(symbols):
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(symbols))
        ranks = vocabulary.ranks.take(made, mode="wrap")
        least = np.minimum.reduceat(ranks, starts)
        # words without a pair leave
        alive = least < NONE
        keep = np.repeat(alive, sizes)
        if not alive.all():
            done = np.flatnonzero(~keep)
            yield symbols[done], place[done]
            if not alive.any():
                return
        of_word = np.repeat(np.where(alive, least, -1), sizes)
        if cut_runs(symbols, made, begins, least, of_word, vocabulary):
            continue
        # of neighbouring candidates every second one, from the left
        merged = np.flatnonzero(ranks == of_word)
        beside = np.diff(merged, prepend=-2) == 1
        if beside.any():
            steps = np.arange(len(merged))
            merged = merged[(steps - np.maximum.accumulate(np.where(beside, 0, steps))) % 2 == 0]
        new = made[merged]
        # each new symbol with the one before, which the merge before may have made, and with the next, still unmerged
        inner = np.flatnonzero(~begins[merged])
        before = symbols[merged[inner] - 1]
        follows = np.flatnonzero(np.diff(merged, prepend=-3)[inner] == 2)
        before[follows] = new[inner[follows] - 1]
        on_left, on_right = np.full(len(merged), -1, np.int32), np.full(len(merged), -1, np.int32)
        on_left[inner], _ = vocabulary.pairs.find(before, new[inner])
        beyond = np.minimum(merged + 2, len(symbols) - 1)
        more = np.flatnonzero(~begins[beyond] & (merged + 2 == beyond))
        on_right[more], _ = vocabulary.pairs.find(new[more], symbols[beyond[more]])
        early = np.minimum(vocabulary.ranks[on_left], vocabulary.ranks[on_right]) <= ranks[merged]
        if early.any():
            stands = up_to_first(early, np.cumsum(begins)[merged])
            merged, new, on_left, on_right = (x[stands] for x in (merged, new, on_left, on_right))
        symbols[merged] = new
        made[merged] = on_right
        # the symbol before a merged pair, which is the first of the pair before where that has been merged too
        inner = np.flatnonzero(~begins[merged])
        made[merged[inner] - 1 - (np.diff(merged, prepend=-3)[inner] == 2)] = on_left[inner]
        keep[merged + 1] = False
        kept = np.flatnonzero(keep)
        symbols, place, made, begins = (x.take(kept) for x in (symbols, place, made, begins))


def up_to_first(early: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which merges of a round stand: in each word, those up to the first that is marked."""
    before = np.cumsum(early) - early
    opens = np.flatnonzero(np.diff(word, prepend=-1))
    return before == np.repeat(before[opens], np.diff(np.append(opens, len(word))))


def cut_runs(symbols: np.ndarray, made: np.ndarray, begins: np.ndarray, least: np.ndarray, of_word: np.ndarray, vocabulary: Vocabulary) -> bool:
    """Cuts runs of a character, whose pieces all have the word's smallest rank, at every longest piece."""
    cut = False
    for rank, (symbol, longest) in vocabulary.runs.items():
        if not (least == rank).any():
            continue
        inside = (symbols == symbol) & (of_word == rank)
        place = np.arange(len(inside))
        since = place - np.maximum.accumulate(np.where(inside & ~begins & np.append(False, inside[:-1]), 0, place))
        fresh = np.flatnonzero(inside & (since > 0) & (since % longest == 0))
        if len(fresh):
            begins[fresh] = True
            made[fresh - 1] = -1
            cut = True
    return cut


def as_ids(symbols: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of final symbols; a character that is no piece becomes the ids of its bytes, which changes the counts."""
    n = len(vocabulary.pieces)
    odd = np.flatnonzero((symbols < 0) | (symbols >= n))
    if not len(odd):
        return symbols, counts
    raw = [(chr(-1 - s) if s < 0 else vocabulary.others[s - n]).encode("utf-8", "surrogatepass") for s in symbols[odd].tolist()]
    sizes = np.ones(len(symbols), np.int64)
    sizes[odd] = [len(r) for r in raw]
    ids = np.repeat(symbols, sizes)
    ids[(ids < 0) | (ids >= n)] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + vocabulary.first_byte
    upto = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
    return ids, np.diff(upto)


def stretches(text: str, vocabulary: Vocabulary) -> Iterator[str]:
    """A long text cut between its words."""
    at = 0
    while vocabulary.spaced and len(text) - at > BLOCK_CHARS:
        cut = text.rfind(MARK, at, at + BLOCK_CHARS)
        while cut > at and text[cut - 1] == MARK:
            cut -= 1
        if cut <= at:  # one word, or white space, longer than a block
            cut = next((m.start() + 1 for m in re.compile(f"[^{MARK}]{MARK}").finditer(text, at + BLOCK_CHARS)), len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Whole texts in blocks of bounded size; a longer text is a block of its own."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encode_texts(texts: Iterable[str | None], vocabulary: Vocabulary, end: bool) -> Iterator[pa.ListArray]:
    """A list of ids for each text, in blocks, so that no more than a block or one long text is held besides the texts."""
    marked = (MARK + t.replace(" ", MARK) if t else "" for t in texts)
    for block in blocks(marked):
        if len(block) == 1 and len(block[0]) > BLOCK_CHARS:
            ids = np.concatenate([merge_texts([part], vocabulary)[0] for part in stretches(block[0], vocabulary)])
            counts = np.array([len(ids)])
        else:
            ids, counts = merge_texts(block, vocabulary)
        if end:
            ids, counts = np.insert(ids, np.cumsum(counts), vocabulary.end), counts + 1
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))


def surfaces(vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each id stands for, as bytes one after the other, with their begins and sizes; and each again without the
    mark that begins it, which is left out at the start of a text."""
    marked = range(vocabulary.first_byte, vocabulary.first_byte + 256)
    out = []
    for k, piece in enumerate(vocabulary.pieces):
        if k in vocabulary.control:
            out.append(b"")
        elif k == vocabulary.unknown:
            out.append(" \u2047 ".encode())
        else:
            out.append(bytes([k - vocabulary.first_byte]) if k in marked else piece.replace(MARK, " ").encode())
    bare = [b[1:] if k not in marked and vocabulary.pieces[k].startswith(MARK) else b for k, b in enumerate(out)]
    sizes = np.array([len(b) for b in out + bare], np.int64)
    return np.frombuffer(b"".join(out + bare), np.uint8), np.cumsum(sizes) - sizes, sizes


def one_by_one(error: UnicodeError) -> tuple[str, int]:
    """A replacement for each byte that is not part of a character."""
    return "\ufffd", error.start + 1


codecs.register_error("webloom-bytes", one_by_one)


def decode_lists(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, table: tuple[np.ndarray, np.ndarray, np.ndarray], start: bool = True) -> list[str]:
    """The text of each list of ids; ``start``: a mark at its start is left out."""
    data, begins, sizes = table
    n = len(vocabulary.pieces)
    if len(ids) and (ids.min() < 0 or ids.max() >= n):
        raise ValueError("an id is not in the vocabulary")
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shown = np.flatnonzero(~np.isin(ids, list(vocabulary.control)))
    used = ids.astype(np.int64)
    if start and len(shown):
        used[shown[np.append(True, owner[shown][1:] != owner[shown][:-1])]] += n
    counts = sizes[used]
    upto = np.append(0, np.cumsum(counts))
    raw = data[np.repeat(begins[used] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
    ends = upto[offsets].tolist()
    out = [raw[a:b].decode("utf-8", "webloom-bytes") for a, b in zip(ends, ends[1:], strict=False)]
    # bytes before and after a control id are no part of one character
    byte = (ids >= vocabulary.first_byte) & (ids < vocabulary.first_byte + 256)
    split = shown[1:][(np.diff(shown) > 1) & byte[shown[1:]] & byte[shown[:-1]] & (owner[shown[1:]] == owner[shown[:-1]])]
    for k in np.unique(owner[split]).tolist():
        cuts = [ends[k], *upto[split[owner[split] == k]].tolist(), ends[k + 1]]
        out[k] = "".join(raw[a:b].decode("utf-8", "webloom-bytes") for a, b in zip(cuts, cuts[1:], strict=False))
    return out


def decode_long(ids: np.ndarray, vocabulary: Vocabulary, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    """The text of one long list, in stretches cut before pieces that are no bytes."""
    whole = np.flatnonzero((ids >= vocabulary.first_byte + 256) | (ids < 0))
    aims = np.searchsorted(whole, np.arange(BLOCK_IDS, len(ids), BLOCK_IDS))
    cuts = np.unique(np.concatenate([[0], whole[aims[aims < len(whole)]], [len(ids)]]))
    return "".join(decode_lists(ids[a:b], np.array([0, b - a]), vocabulary, table, start=a == 0)[0] for a, b in zip(cuts, cuts[1:], strict=False))


def decode_array(lists: pa.ListArray, vocabulary: Vocabulary, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.StringArray:
    """The texts of lists, some of them at a time; null counts as an empty list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes))
    out: list[str] = []
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_IDS, side="right")) - 1)
        part = ids[offsets[at] : offsets[stop]]
        if len(part) > BLOCK_IDS:
            out.append(decode_long(part, vocabulary, table))
        else:
            out += decode_lists(part, offsets[at : stop + 1] - offsets[at], vocabulary, table)
        at = stop
    return pa.array(out, pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: list[str] | None = None, end: bool = True, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of every whole text, with an end id after them unless ``end`` is false, and under the name
    ``decoded``, if given, the text that these ids stand for.

    A null text counts as empty and has the end id alone. ``keep`` names the columns that stay, all if not given;
    whatever they hold, repeated rows too, they pass through, but for those that have the name of an added one. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (out.lower(), (decoded or out).lower())]
    (text,) = spare(docs, "whole_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = surfaces(shared.value)
        for batch in batches:
            rows, at = batch.drop_columns([text]), 0
            for ids in encode_texts((t.as_py() for t in batch[text]), shared.value, end):
                part = rows.slice(at, len(ids))
                added = [ids] if decoded is None else [ids, decode_array(ids, shared.value, table)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])
                at += len(ids)

    names = [out] if decoded is None else [out, decoded]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    fields += [f"`{out}` array<int>", f"`{decoded}` string"][: len(names)]
    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, ", ".join(fields))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that each list of ids stands for; null counts as an empty list, an id beyond the vocabulary raises.

    All columns stay, but for one that has the name of the added one. Bytes that make no character become U+FFFD one by one.
    """
    rows = rows.select(*(f"`{c}`" for c in rows.columns if c.lower() != out.lower()))
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = surfaces(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_array(batch[ids_col], shared.value, table)], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` string")
