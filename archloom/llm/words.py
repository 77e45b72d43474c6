"""Words as 64-bit hashes, computed over Arrow's text buffers without building strings.

A word is a run of bytes other than space and 0x09-0x0D, so the same in code
points and in UTF-8. Each hash is a polynomial over the word's bytes modulo
2**64, then mixed; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WINDOW_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK * 2
    while size < n:
        size *= 2
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not (wide or pa.types.is_string(column.type)):
        column, wide = column.cast(pa.string()), False
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    if where is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes together, or of a single longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _hash_piece(raw: np.ndarray, heads: np.ndarray, lower: bool, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (a row for the words and one for each prefix length) and starts of the words in ``raw``; a text starts at each of ``heads``."""
    if not len(raw):
        return np.zeros((1 + len(prefixes), 0), np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[heads] = True
    cut[0] = cut[-1] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    values = (_LOWER[raw] if lower else raw).astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(raw)]
    np.cumsum(values, out=total[1:])
    out = np.empty((1 + len(prefixes), len(starts)), np.uint64)
    for row, size in enumerate((None, *prefixes)):
        h = total[ends if size is None else np.minimum(starts + size, ends)]
        h -= total[starts]
        h *= down[starts]
        out[row] = mix(h + np.uint64(row))
    return out, starts


def hash_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n+1 positions at which each text's words begin."""
    h, at = hash_words_and_prefixes(raw, offsets, (), lower)
    return h[0], at


def hash_words_and_prefixes(raw: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As ``hash_words``, with a further row of hashes for the words' first bytes, for each length of ``prefixes``."""
    if len(raw) <= 2 * CHUNK:
        h, starts = _hash_piece(raw, offsets[:-1], lower, prefixes)
    else:  # a very long text goes in pieces that end at white space
        parts, places, lo = [], [], 0
        while lo < len(raw):
            hi = min(lo + CHUNK, len(raw))
            step = hi
            while hi < len(raw):
                gap = np.flatnonzero(_SPACE[raw[step : step + 65536]])
                if len(gap):
                    hi = step + int(gap[0])
                    break
                step += 65536
                hi = min(step, len(raw))
            heads = offsets[(offsets >= lo) & (offsets < hi)] - lo
            part, place = _hash_piece(raw[lo:hi], heads, lower, prefixes)
            parts.append(part)
            places.append(place + lo)
            lo = hi
        h, starts = np.concatenate(parts, axis=1), np.concatenate(places)
    return h, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word windows of each text, and the n+1 positions at which they begin.

    A text of fewer words than ``size`` has one window of all its words, a text without words none.
    """
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = np.arange(begin[-1]) - begin[text] + at[text]
    out = np.zeros(len(first), np.uint64)
    left = np.minimum(n[text], size)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    factors = np.resize(WINDOW_FACTORS, size)
    for k in range(size):
        term = padded[first + k] * factors[k] + np.uint64(k + 1)
        out += np.where(k < left, term, np.uint64(0))
    return mix(out), begin
