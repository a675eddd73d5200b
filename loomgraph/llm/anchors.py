"""Anchors of fixed-length windows: the same window has the same anchor wherever it stands.

For every string of `length` bytes (a window), the anchor is the leftmost of its seeds (strings of SEED
bytes) with the smallest hash. Neighbouring windows mostly share their anchor, so a text of n bytes has
about 2n/(length - SEED) runs of windows with one anchor. As the anchor depends on nothing but the
window's bytes, equal windows have equal anchors at equal places, and whatever compares windows need
only compare those of equal anchors.
"""

from __future__ import annotations

import numpy as np

from .tokens import keys, mix

SEED = 64
PIECE = 1 << 20
_BYTE = keys(1 << 22, 256)
_BASE = np.uint64(0x2545F4914F6CDD1D)
_PLACE_BITS = np.uint64(24)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), 1 << 12)
_DOWN = _powers(pow(int(_BASE), -1, 1 << 64), 1 << 12)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(int(_BASE), 2 * n), _powers(pow(int(_BASE), -1, 1 << 64), 2 * n)
    return _UP, _DOWN


class Hashes:
    """Hashes of any substring of data, from prefix sums of its bytes' keys times powers of a base."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def rolling(self, size: int) -> np.ndarray:
        """Of the substrings of `size` bytes at every place."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n] + np.uint64(size))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by running minima inside blocks from either side."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def runs(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The runs of windows with one anchor in texts laid end to end.

    (text, first, count, anchor, span): the text's number, the first window's start in the text, how many
    windows, the hash of the anchor with its place in the first window left out, and a hash of all bytes
    under the run's windows together with the anchor's place among them.
    """
    width = length - SEED + 1
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(data)
    seeds = hashes.rolling(SEED)
    coded = (seeds >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(seeds), dtype=np.uint64)
    place = (_sliding_min(coded, width) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(len(place)), "right") - 1
    whole = np.arange(len(place)) + length <= bounds[text + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    # Windows that reach over a text's end stand last in their run or fill it.
    count = np.add.reduceat(whole.astype(np.int64), start)
    start = start[count > 0]
    count = count[count > 0]
    at = place[start]
    span = hashes.of(start, start + count - 1 + length) + mix((at - start).astype(np.uint64) * np.uint64(3) + count.astype(np.uint64) * np.uint64(1 << 20))
    return text[start], start - bounds[text[start]], count, seeds[at], mix(span)
