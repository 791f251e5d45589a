"""Hashed text features, vectorised over blocks of documents."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Characters of one block, and documents of one block: what a task holds besides its batch.
BLOCK_CHARS = 1 << 19
BLOCK_DOCS = 256


@cache
def char_classes() -> np.ndarray:
    """For every code point: 0 white space, 1 lower or other letter, 2 upper-case letter, 3 digit, 4 anything else."""
    found = np.full(sys.maxunicode + 1, 4, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            found[code] = 2 if kind == "Lu" else 1
        elif kind == "Nd":
            found[code] = 3
    found[[9, 10, 11, 12, 13, 32, 0xA0]] = 0
    return found


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Cuts texts, whole, into blocks of bounded size; a longer text is a block of its own."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if k > at and (size + len(text) > BLOCK_CHARS or k - at >= BLOCK_DOCS):
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, texts[at:]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by a space, and the text each belongs to."""
    joined = " ".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def gram_hashes(codes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of the n codes from each place on; the last n - 1 places are left out."""
    size = max(0, len(codes) - n + 1)
    out = np.full(size, seed, np.uint32)
    for k in range(n):
        out = mix(out * np.uint32(31) + codes[k : k + size].astype(np.uint32))
    return out


def count_into(owner: np.ndarray, bins: np.ndarray, docs: int, dims: int) -> np.ndarray:
    return np.bincount(owner * dims + bins, minlength=docs * dims).reshape(docs, dims).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def log_tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def sparse(row: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(row)
    return at.astype(np.uint16).tobytes(), np.minimum(row[at], 65535).astype(np.uint16).tobytes()


def dense(pairs: list[tuple[bytes, bytes]], dims: int) -> np.ndarray:
    out = np.zeros((len(pairs), dims), np.float32)
    for k, (at, counts) in enumerate(pairs):
        out[k, np.frombuffer(at, np.uint16)] = np.frombuffer(counts, np.uint16)
    return out
