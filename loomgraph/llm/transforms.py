"""Merging shards' Burrows-Wheeler transforms of byte strings, as far as a given depth.

Strings are read in symbols of a few bytes that overlap: the symbol at a place is the bytes from there
on, and the suffix at a place continues with the suffix one symbol further. A Transform holds one shard's
suffixes in order, as far as the depth, with the symbol that each begins with and the row that it continues in
(the inverse of the transform's last-to-first mapping).

merge() finds the interleave of the shards' transforms. First the columns of first symbols meet, each sorted
already. Each pass then takes a row's block so far together with the block of the row that it continues in:
after h passes rows stand in the order of their first h symbols, and a block holds the rows that share these.
Along a shard's own order these pairs never fall, so a pass is a merge of sorted columns, by counting how many
rows of each other shard come before: no pass sorts, and a shard whose rows are out of order gives wrong blocks.
Where a block splits is the common prefix of the rows on either side. A block with rows of one shard only is
settled, as that shard's transform has the order and common prefixes in it: later passes leave it out, and its
place in the interleave stands for it.
"""

from __future__ import annotations

import numpy as np

SYMBOL = 8


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


class Transform:
    """The sorted suffixes of one shard's strings."""

    def __init__(self, strings: list[bytes], step: int, depth: int):
        sizes = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(sizes)
        self.which = np.repeat(np.arange(len(strings)), sizes)
        self.n = n = int(sizes.sum())
        self.place = np.arange(n) - np.repeat(ends - sizes, sizes)
        data = np.frombuffer(b"".join(strings) + bytes(step), np.uint8).astype(np.uint64)
        words = np.zeros(n, np.uint64)
        for k in range(step):
            words = words << np.uint64(8) | data[k : n + k]
        after = np.arange(n) + step
        limit = ends[self.which] if n else ends[:0]
        # What is left at a string's end is shorter than a symbol: it is like nothing else, and sorted last.
        tail = after > limit
        self.order, tied = self._sorted(words, tail, after, limit, step, depth)
        row = np.empty(n, np.int64)
        row[self.order] = np.arange(n)
        self.whole = n - int(tail.sum())
        self.first = words[self.order][: self.whole]
        there = after[self.order]
        self.follow = np.where(there < limit[self.order], row[np.minimum(there, max(0, n - 1))], -1)
        #: Whether a row shares the whole depth with the one before or behind it.
        self.tied = tied

    @staticmethod
    def _sorted(words: np.ndarray, tail: np.ndarray, after: np.ndarray, limit: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the order of their suffixes, whether each is alike with a neighbour), by doubling the depth that ranks stand for."""
        n = len(words)
        order = np.lexsort((words, tail))
        some = words[order]
        rank = np.empty(n, np.int64)
        new = np.append(True, (some[1:] != some[:-1]) | tail[order][1:])[:n]
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        known = 1
        left = np.arange(n)
        while known < depth:
            far = min(known, depth - known)
            left = left[np.bincount(rank, minlength=n)[rank[left]] > 1]
            if not len(left):
                break
            # Equal so far, so none ends before: the rank further on tells them apart, or that a string ends just there.
            there = after[left] + (far - 1) * step
            second = np.where(there < limit[left], rank[np.minimum(there, n - 1)], n + left)
            by = np.argsort(rank[left] * (2 * n + 1) + second)
            one, two = rank[left][by], second[by]
            head = np.maximum.accumulate(np.where(np.append(True, one[1:] != one[:-1]), np.arange(len(left)), 0))
            split = np.maximum.accumulate(np.where(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])), np.arange(len(left)), 0))
            # A rank is where its rows start in the shard's order.
            rank[left[by]] = one + split - head
            known += far
        order = np.argsort(rank, kind="stable")
        return order, np.bincount(rank, minlength=n)[rank[order]] > 1 if n else np.zeros(0, bool)


def _meet(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of every row of sorted columns: (how many rows of all columns have a smaller value, whether another column has its value)."""
    first = [_starts(c) for c in columns]
    values = [c[f] for c, f in zip(columns, first, strict=True)]
    bounds = [np.append(f, len(c)) for c, f in zip(columns, first, strict=True)]
    before, shared = [], []
    for s, mine in enumerate(values):
        count, met = first[s].copy(), np.zeros(len(mine), bool)
        for t, other in enumerate(values):
            if t != s and len(other) and len(mine):
                at = np.searchsorted(other, mine)
                count += bounds[t][at]
                at[at == len(other)] = 0
                met |= other[at] == mine
        size = np.diff(bounds[s])
        before.append(np.repeat(count, size))
        shared.append(np.repeat(met, size))
    return before, shared


def merge(shards: list[Transform], depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(the place of each row's block in the interleave, how many symbols the row shares with one of another shard, up to depth), by shard."""
    n = sum(x.n for x in shards)
    base = np.cumsum([0, *[x.n for x in shards]])
    blocks, shared = _meet([x.first for x in shards])
    # Behind all whole symbols: what is left at strings' ends, each a block.
    behind = sum(x.whole for x in shards)
    for s, x in enumerate(shards):
        blocks[s] = np.append(blocks[s], behind + np.arange(x.n - x.whole))
        behind += x.n - x.whole
    rows = [np.flatnonzero(x) for x in shared]
    common = [np.zeros(x.n, np.int64) for x in shards]
    for some, at in zip(common, rows, strict=True):
        some[at] = 1
    for h in range(1, depth):
        if not any(map(len, rows)):
            break
        was = [b[r] for b, r in zip(blocks, rows, strict=True)]
        # A suffix that ends here is like no other, and behind those that go on.
        then = [np.where(x.follow[r] >= 0, b[x.follow[r]], n + base[s] + r) for s, (x, b, r) in enumerate(zip(shards, blocks, rows, strict=True))]
        before, shared = _meet([a * (2 * n + 1) + c for a, c in zip(was, then, strict=True)])
        start, _ = _meet(was)
        for s, r in enumerate(rows):
            blocks[s][r] = was[s] + before[s] - start[s]
            common[s][r[shared[s]]] = h + 1
        rows = [r[m] for r, m in zip(rows, shared, strict=True)]
    return blocks, common


class Shards:
    """Byte strings, each of one shard, and the windows of `length` bytes in them."""

    def __init__(self, strings: list[bytes], shard: np.ndarray, length: int):
        step = next(s for s in range(SYMBOL, 0, -1) if length % s == 0)
        self.depth, self.length = length // step, length
        shard = np.asarray(shard)
        self.of = [np.flatnonzero(shard == s) for s in np.unique(shard)]
        self.sizes = np.array([len(x) for x in strings], np.int64)
        self.transforms = [Transform([strings[i] for i in some], step, self.depth) for some in self.of]

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the string, place in it) of the windows that also start elsewhere, in order.

        These are the rows whose prefix in common with a neighbour in the interleave reaches the depth: with
        a row of another shard by the merge, or with one of the same shard by its transform.
        """
        _, common = merge(self.transforms, self.depth)
        which, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, some, shared in zip(self.transforms, self.of, common, strict=True):
            at = x.order[(shared == self.depth) | x.tied]
            string = some[x.which[at]]
            inside = x.place[at] + self.length <= self.sizes[string]
            which.append(string[inside])
            place.append(x.place[at][inside])
        which, place = np.concatenate(which), np.concatenate(place)
        by = np.lexsort((place, which))
        return which[by], place[by]
