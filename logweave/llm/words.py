"""Words, word hashes and n-gram hashes of whole Arrow batches, without a Python object per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit polynomials over the bytes
(or over word hashes) followed by a mixing step; they depend only on content, so equal texts hash alike in any
process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # a task holds some hundred times as much for a while
_M = (1 << 64) - 1
_BASE, _WBASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of terms: also all other ASCII that is not a letter, a digit or an underscore.
TERM_SPACE = np.zeros(256, bool)
TERM_SPACE[[c for c in range(128) if not (chr(c).isalnum() or c == 0x5F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (both[0], both[1])
    return have


@dataclass
class Words:
    """buf: the bytes of all texts of a slice; start, end: of each word; first: index of each text's first word, one more at the end."""

    row: int
    buf: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        p, inv = powers(_BASE, n + 1)
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[self.buf] * p[:n], out=run[1:])
        return mix((run[self.end] - run[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))


def gram_sums(h: np.ndarray) -> np.ndarray:
    """Running sums from which grams() makes the hash of any span."""
    p, _ = powers(_WBASE, len(h) + 1)
    run = np.empty(len(h) + 1, np.uint64)
    run[0] = 0
    np.cumsum(h * p[: len(h)], out=run[1:])
    return run


def span_hash(run: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words a..b-1."""
    _, inv = powers(_WBASE, len(run))
    return mix((run[b] - run[a]) * inv[a] + (b - a).astype(np.uint64))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(col: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, space_bytes: np.ndarray = _SPACE) -> Iterator[Words]:
    """Words of successive runs of rows of about limit bytes each; a longer text makes a slice of its own."""
    if not len(col):
        return
    data, off = text_buffers(col)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        to = min(to, n)
        buf = data[off[at] : off[to]]
        if lower:
            buf = _LOWER[buf]
        text = off[at : to + 1] - off[at]
        space = space_bytes[buf]
        word = ~space
        begin = word.copy()
        begin[1:] &= space[:-1]
        edge = text[:-1][text[:-1] < len(buf)]
        begin[edge] = word[edge]
        stop = word.copy()
        stop[:-1] &= space[1:]
        last = text[1:][text[1:] > 0] - 1
        stop[last] = word[last]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        yield Words(at, buf, text, start, end, np.searchsorted(start, text))
        at = to
