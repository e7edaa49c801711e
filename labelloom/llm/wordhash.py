"""Hashes of words, computed for many texts at once on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multiplier of the polynomial over a word's bytes; multipliers of the finaliser are those of MurmurHash3.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

# Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` for runs of texts of about CHUNK_BYTES; null is the empty text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        last = min(last, len(texts))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of every word, text of every word)``; words are what lies between ASCII white space, A-Z lower-cased on demand."""
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(raw) == 0:
        return none
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    # a text's first byte begins a word even if the text before ends with one
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return none
    raw, space, begins = raw[starts[0] :], space[starts[0] :], begins[starts[0] :]
    at = np.arange(len(raw)) - (starts - starts[0])[np.cumsum(begins) - 1]
    values = raw.astype(np.uint64)
    if lower:
        values[(raw >= 65) & (raw <= 90)] += np.uint64(32)
    at[space] = 0
    values = (values + np.uint64(1)) * _powers(int(at.max()) + 1)[at]
    values[space] = 0
    return mixed(np.add.reduceat(values, starts - starts[0])), np.searchsorted(offsets, starts, side="right") - 1
