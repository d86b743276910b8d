"""Vectorised scanning of Arrow string batches: pieces of bounded size, word spans and word hashes over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def class_table(text: bytes = b"", *, negate: bool = False, low: int = 256) -> np.ndarray:
    """256 booleans: the bytes named and all from `low` on, or all others."""
    lut = np.zeros(256, bool)
    lut[list(text)] = True
    lut[low:] = True
    return ~lut if negate else lut


#: Words between ASCII blanks.
SPACED = class_table(b" \t\n\x0b\x0c\r", negate=True)
#: Runs of 0-9, a-z, A-Z and all that is not ASCII.
ALNUM = class_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", low=128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batch: pa.RecordBatch, size_col: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about `limit` bytes of text."""
    col = batch.column(size_col)
    n = np.array(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(n)
    at, total = 0, len(n)
    while at < total:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the n + 1 offsets of the texts; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and first word of each text (n + 1 numbers); words don't cross texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    mark = lut[buf]
    before = np.empty_like(mark)
    before[0] = False
    before[1:] = mark[:-1]
    inner = off[1:-1]
    before[inner[inner < len(buf)]] = False
    start = np.flatnonzero(mark & ~before)
    after = np.empty_like(mark)
    after[-1] = False
    after[:-1] = mark[1:]
    after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(mark & ~after) + 1
    return start, end, np.searchsorted(start, off)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, the same wherever the word stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, int(len(buf)).bit_length())
    up, down = _powers(size)
    values = (LOWER[buf] if lower else buf).astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(buf)]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text, and where each text's runs begin (n + 1 numbers)."""
    n = np.diff(first)
    count = np.maximum(n - k + 1, 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = (out ^ h[at + j]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(31)
    return mix(out), begin


def per_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values over each text's stretch."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[begin[1:]] - sums[begin[:-1]]
