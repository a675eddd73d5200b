"""Words of UTF-8 texts as 64-bit hashes, for a whole Arrow batch at a time.

A-Z count as a-z; words are runs of bytes outside \\x20 and \\x09-\\x0D, which in UTF-8 is the same as
runs of characters outside them. A word's hash is a multilinear hash of its bytes with pseudo-random
64-bit keys, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(start: int, n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    return mix((np.arange(start + 1, start + n + 1, dtype=np.uint64)) * _GOLD) | np.uint64(1)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = keys(1 << 20, 256)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[_SPACE] = 0
_PLACE = keys(0, 256)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = keys(0, 2 * n)
    return _PLACE


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): the texts of a batch in pieces of about `most` bytes.

    Null is the empty text. offsets are into bytes, one more than there are rows.
    """
    text = batch.column(column)
    text = text.fill_null("") if text.null_count else text
    text = text.cast(pa.large_string())
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(text) else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the hashes of all words in order; text i has those from bounds[i] to bounds[i+1]."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    # Separators between a word and the next add nothing to either's sum.
    spread = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, spread)
    table = _places(int(spread.max()))
    hashes = np.add.reduceat(_BYTE[data[starts[0] :]] * table[place], starts - starts[0])
    length = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0]).astype(np.uint64)
    return mix(hashes + length * _GOLD), np.searchsorted(starts, offsets)


_SHINGLE = keys(1 << 21, 64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of `size` words; of fewer words, that of all."""
    whole = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        whole += hashes[i : len(hashes) - size + 1 + i] * _SHINGLE[i]
    whole = mix(whole)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            found.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            found.append(mix((hashes[a:b] * _SHINGLE[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
