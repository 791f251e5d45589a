"""Words as hashes of their own bytes, and hashes of runs of words, vectorised.

A word's two 64-bit lanes take its bytes eight at a time through a non-linear finaliser, each lane by a function of
its own; words of more than ``LONG_WORD`` bytes are hashed by BLAKE2b. Hashes of runs build on one lane and double
their length step by step with the same finaliser, so no run of words cancels another, and a match in both lanes is
a match of 128 bits that start from the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of texts that are handled at a time; a longer text is a block of its own, in such pieces.
BLOCK_BYTES = 1 << 20
LONG_WORD = 64
SPACE = b" \t\n\r\v\f"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
GOLDEN = U(0x9E3779B97F4A7C15)
#: Odd multipliers of the lanes, from the binary digits of pi.
ONE, TWO = U(0x243F6A8885A308D3), U(0x13198A2E03707345)
#: The low n bytes of eight.
LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Piece:
    """Texts or part of one, as bytes with white space after each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join([*texts, bytes(8)])  # and eight bytes so that the last word can be read by eights
        self.size = len(self.data) - 8
        self.array = np.frombuffer(self.data, np.uint8, self.size)
        self.inside = ~IS_SPACE[self.array]
        edges = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]

    def lanes(self) -> np.ndarray:
        """(2, words): both lanes of each word."""
        eights = np.ndarray((self.size + 1,), "<u8", self.data, strides=(1,))
        starts, sizes = self.starts, self.ends - self.starts
        out = np.empty((2, len(starts)), U)
        read = eights[starts] & LOW[np.minimum(sizes, 8)]
        out[0] = mix(read * ONE + sizes.astype(U))
        out[1] = mix((read ^ GOLDEN) * TWO + sizes.astype(U))
        for k in range(8, LONG_WORD, 8):
            at = np.flatnonzero(sizes > k)
            if not len(at):
                break
            read = eights[starts[at] + k] & LOW[np.minimum(sizes[at] - k, 8)]
            out[0, at] = mix(out[0, at] * ONE + read)
            out[1, at] = mix((out[1, at] ^ GOLDEN) * TWO + read)
        for k in np.flatnonzero(sizes > LONG_WORD):
            out[:, k] = np.frombuffer(blake2b(self.data[starts[k] : self.ends[k]], digest_size=16).digest(), U)
        return out

    def spaced(self) -> bytes:
        """All words, one space after each."""
        keep = self.inside.copy()
        keep[self.ends] = True
        return np.where(self.inside, self.array, np.uint8(32))[keep].tobytes()


class Block:
    """The words of some whole texts: their lanes, and the place at which each text's words begin, and the end."""

    def __init__(self, at: int, pieces: list[Piece], sizes: list[int]) -> None:
        self.at, self.pieces = at, pieces
        self.lanes = np.concatenate([p.lanes() for p in pieces], axis=1)
        if len(pieces) > 1:
            self.begins = np.array([0, self.lanes.shape[1]])
        else:
            self.begins = np.searchsorted(pieces[0].starts, np.cumsum([0, *(n + 1 for n in sizes)]))

    @cached_property
    def words(self) -> Words:
        return Words(self.pieces)


class Words:
    """Words themselves, one space between them, and digests of runs of them."""

    def __init__(self, pieces: list[Piece]) -> None:
        self.joined = b"".join([p.spaced() for p in pieces])
        self.starts = np.cumsum(np.concatenate([[0], *(p.ends - p.starts + 1 for p in pieces)]))

    def bytes(self, first: int, stop: int) -> bytes:
        return self.joined[self.starts[first] : max(self.starts[first], self.starts[stop] - 1)]

    def digests(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """BLAKE2b of the words first..stop-1 themselves, for arrays of places."""
        joined, digest = self.joined, blake2b
        spans = zip(self.starts[first].tolist(), (self.starts[stop] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([digest(joined[a:b], digest_size=8).digest() for a, b in spans]), U)


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space; words stay whole."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        head = text[at : at + BLOCK_BYTES]
        rest = len(head.rstrip(SPACE))
        cut = max(head.rfind(s, 0, rest) for s in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if rest == len(head) else rest
        if cut <= 0:  # one word, or white space, longer than a piece
            stop = at + BLOCK_BYTES
            while stop < len(text) and text[stop] not in SPACE:
                stop += 1
            cut = stop - at
        yield text[at : at + cut]
        at += cut
    yield text[at:] if at else text


def word_blocks(column: pa.Array, lower: bool = False) -> Iterator[Block]:
    """Blocks of whole texts in order, null as empty: short texts together, a long one alone and in pieces."""
    held: list[bytes] = []
    at = size = 0
    for k, cell in enumerate(column.cast(pa.large_binary())):
        text = cell.as_py() or b""
        if lower:
            text = text.lower()  # of bytes: A-Z only
        if held and size + len(text) > BLOCK_BYTES:
            yield Block(at, [Piece(held)], [len(t) for t in held])
            at, held, size = k, [], 0
        if len(text) > BLOCK_BYTES:
            yield Block(k, [Piece([p]) for p in pieces(text)], [len(text)])
            at = k + 1
        else:
            held.append(text)
            size += len(text)
    if held:
        yield Block(at, [Piece(held)], [len(t) for t in held])


class Runs:
    """Hashes of runs of words of one lane: level k holds, for every place, the hash of 2**k words from there."""

    def __init__(self, lane: np.ndarray) -> None:
        self.levels = [np.ascontiguousarray(lane)]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(below) - half)
            self.levels.append(mix(below[:n] * GOLDEN + below[half : half + n]))
        return self.levels[k]

    def hashes(self, first: np.ndarray, length: int) -> np.ndarray:
        """Of ``length`` words from each place: of the two overlapping powers of two that cover them."""
        k = length.bit_length() - 1
        values = self.level(k)
        return mix(values[first] * GOLDEN + values[first + length - (1 << k)] + U(length))

    def of_lengths(self, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), U)
        for n in np.unique(lengths).tolist():
            at = lengths == n
            out[at] = self.hashes(first[at], n)
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for every i, by prefix and suffix minima of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])
