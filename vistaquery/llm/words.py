"""Vectorised words and their hashes, for whole batches of texts at a time.

A word is [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes.  A word of up to 16 bytes is two 64-bit
lanes, its bytes themselves; a longer one is its 128-bit BLAKE2 digest.  Hashes mix the lanes
by multiplications and shifts that do not distribute over sums, so no algebra of the letters
(as in polynomials modulo 2**64) makes texts collide.  Hashes only deal and look up: operators
compare the words themselves before two windows or sets count as equal."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
LOWER_TABLE = np.frombuffer(LOWER, dtype=np.uint8)
#: The lowest k bytes of a lane.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each word: its bytes, or of one over 16 bytes its digest."""
    n = end - start
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(24, np.uint8)]), 8)
    x = eight[start].view("<u8")[:, 0] & _LOW[np.minimum(n, 8)] if len(n) else np.zeros(0, np.uint64)
    y = eight[np.minimum(start + 8, len(data) + 8)].view("<u8")[:, 0] & _LOW[np.clip(n - 8, 0, 8)] if len(n) else np.zeros(0, np.uint64)
    for k in np.flatnonzero(n > 16).tolist():
        digest = hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=16).digest()
        x[k], y[k] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return x, y


@dataclass
class Hasher:
    """One family of word and window hashes."""

    seed: int

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.of_lanes(*lanes(data, start, end), end - start)

    def of_lanes(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = mix(x + np.uint64(self.seed * int(_STEP) % 2**64))
        h = mix(h * _STEP + y)
        return mix(h * _STEP + n.astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Of each run of size words, over all words of the batch (borders of texts too).

        Windows of 1, 2, 4, ... words are made of two halves; those that add up to size are joined."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out, width, done, now = None, 1, 0, hashes
        while True:
            if size & width:
                piece = now[done : done + n]
                out = piece if out is None else mix(out * _STEP + piece)
                done += width
            if 2 * width > size:
                return mix(out + np.uint64(size))
            now = mix(now[:-width] * _STEP + now[width:])
            width *= 2


@dataclass
class Words:
    data: np.ndarray  #: the bytes of all texts, one after the other
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  #: words of text i: offsets[i] to offsets[i + 1]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and where each begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, dtype=np.int64)


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, at = flat_bytes(column)
    if lower:
        data = LOWER_TABLE[data]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(at), dtype=np.int64))
    solid = NON_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    borders = at[:-1][at[:-1] < n]
    begins[borders] = solid[borders]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = borders[borders > 0] - 1
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, at))


def blocks(lengths: np.ndarray, limit: int):
    """Ranges of texts that hold about limit bytes together, a longer text alone."""
    i, n = 0, len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def text_lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def digest_of_words(text: str | None) -> bytes | None:
    """128 bits that stand for a text's words, lower-cased; null without words."""
    words = (text or "").encode().translate(LOWER).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
