"""A Merkle manifest of a dataset, whose parents keep the states of their hash before each child.

Nodes are SHA-256 digests; a parent hashes its children's digests as lower-case hex, end to end. 64 hex
digits fill one block of SHA-256 exactly, so the state of a parent's hash before a child is the eight words
that the compression function has left so far. Parents keep it for each of their children (shards' tables
keep them as bytes): a changed child's root follows by resuming from the state before it, with the new
digest and what stands right of it, without reading anything left of it.

The leaves of a group are cut into runs of arity**LEVELS; the nodes above a run are one row of a table, a
run's top is a leaf of the next table, and so on until one node of the group is left. The groups' roots are
the leaves of a last tree. What a leaf needs of the tables above its own reaches it as a path, made once
for each run, so a task never holds more than a run and no table is larger than the leaves'.

Defined results: each null field is `-`; a null group comes first and a null order first in its group; rows
with equal order are ordered by their leaf, and rows alike in both are alike; a leaf alone is its group's
root, and a group alone is the root; no rows, no root; further columns are ignored unless asked for.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from .runtime import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
ROOT = ""


# ---- SHA-256 with states that can be kept ----


def _roots(power: int, count: int) -> np.ndarray:
    """The first 32 bits behind the point of the square (2) or cube (3) roots of the first primes."""
    found, n = [], 2
    while len(found) < count:
        if all(n % p for p in range(2, int(n**0.5) + 1)):
            low, high = 0, 1 << 40
            while high - low > 1:  # largest x with x**power <= n * 2**(32 * power)
                mid = (low + high) // 2
                low, high = (mid, high) if mid**power <= n << 32 * power else (low, mid)
            found.append(low & 0xFFFFFFFF)
        n += 1
    return np.array(found, np.uint32)


_START, _ROUND = _roots(2, 8), _roots(3, 64)
_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States [8, n] after one more block [16, n] of 32-bit words each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i > 15:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + _ROUND[i] + w[i]
        s = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = t + s, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def _block(digest: np.ndarray) -> np.ndarray:
    """Digests [n, 32] as the blocks [16, n] of their hex digits."""
    return _HEX[digest].reshape(len(digest), 64).view(">u4").astype(np.uint32).T


def _closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests [n, 32] of states that have had so many children."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0], end[15], end[14] = 0x80000000, (children * 512) & 0xFFFFFFFF, children >> 23
    return _bytes(absorb(state, end))


def _bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(state.shape[1], 32)


def _state(kept: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(kept).view(">u4").astype(np.uint32).T


# ---- the nodes above a run of leaves ----


def heights(total: int, arity: int) -> int:
    """How many levels stand above so many leaves."""
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


def _sizes(n: int, levels: int, arity: int) -> list[int]:
    return [n, *[n := -(-n // arity) for _ in range(levels)]]


def raised(leaves: np.ndarray, levels: int, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(digests of each level from the leaves up, state of the parent's hash before each of them)."""
    nodes, states = [leaves], []
    for _ in range(levels):
        below = nodes[-1]
        parents = -(-len(below) // arity)
        block, before = _block(below), np.zeros((len(below), 32), np.uint8)
        state = np.repeat(_START[:, None], parents, axis=1)
        for slot in range(min(arity, len(below))):
            child = np.arange(slot, len(below), arity)
            have = len(child)  # the last parent may have fewer
            before[child] = _bytes(state[:, :have])
            state = np.concatenate([absorb(state[:, :have], block[:, child]), state[:, have:]], axis=1)
        nodes.append(_closed(state, np.minimum(arity, len(below) - np.arange(parents) * arity)))
        states.append(before)
    return nodes, states


def _split(packed: bytes, sizes: list[int]) -> list[np.ndarray]:
    flat = np.frombuffer(packed, np.uint8).reshape(-1, 32)
    ends = np.cumsum(sizes)
    return [flat[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def _steps(nodes: list[np.ndarray], states: list[np.ndarray], at: int, arity: int) -> list[tuple[bytes, bytes, bytes]]:
    """(state before the node, digests left of it, digests right of it) on each level above a leaf."""
    found = []
    for level, state in zip(nodes, states, strict=False):
        first = at // arity * arity
        found.append((state[at].tobytes(), level[first:at].tobytes(), level[at + 1 : first + arity].tobytes()))
        at //= arity
    return found


def folded(digests: np.ndarray, at: np.ndarray, nodes: list[np.ndarray], states: list[np.ndarray], path: list[tuple[bytes, bytes, bytes]], arity: int) -> np.ndarray:
    """The root that follows from each of digests [n, 32] in place of the leaf at `at`, all else as it was."""
    for level, kept in zip(nodes, states, strict=False):
        state, first = absorb(_state(kept[at]), _block(digests)), at // arity * arity
        block, end = _block(level), np.minimum(first + arity, len(level))
        for step in range(1, arity):
            right = np.flatnonzero(at + step < end)
            if len(right):
                state[:, right] = absorb(state[:, right], block[:, at[right] + step])
        digests, at = _closed(state, end - first), at // arity
    for kept, left, right in path:
        state = absorb(np.repeat(_state(np.frombuffer(kept, np.uint8).reshape(1, 32)), len(digests), axis=1), _block(digests))
        for one in np.frombuffer(right, np.uint8).reshape(-1, 32):
            state = absorb(state, np.repeat(_block(one[None]), len(digests), axis=1))
        digests = _closed(state, np.full(len(digests), (len(left) + len(right)) // 32 + 1))
    return digests


# ---- tables ----

_STEP = "array<struct<kept: binary, left: binary, right: binary>>"
_STEPS = pa.list_(pa.struct([("kept", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))
_PATHS = pa.schema([("group_key", pa.string()), ("run", pa.int64()), ("path", _STEPS), ("subroot", pa.binary()), ("root", pa.binary())])


def field(name: str, value: Column | None = None) -> Column:
    value = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: tuple[str, ...] = FIELDS, **changed: Column) -> Column:
    """The hex digest of the fields, each with its length in bytes in front."""
    return F.sha2(F.concat(*[field(x, changed.get(x)) for x in fields]), 256)


def group_key(group: str) -> Column:
    """A key that is never null, in the group's order: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (group_key, digest, ...) with their place in the group, from 0, and its size; written."""
    return written(numbered(rows, ["group_key"], order, "_n", "total").withColumn("_n", F.col("_n") - 1), "placed")


def _runs(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """A row for each run of leaves (group_key, _n, total, digest) with all nodes above it, written."""
    size = arity**levels

    def raise_(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        up = min(levels, heights(int(pdf["total"].iloc[0]), arity))
        nodes, states = raised(np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(-1, 32), up, arity)
        packed = [b"".join(x.tobytes() for x in some) for some in (nodes, states)]
        return pd.DataFrame({"group_key": [pdf["group_key"].iloc[0]], "run": [int(pdf["run"].iloc[0])], "total": [-(-int(pdf["total"].iloc[0]) // size)], "leaves": [len(pdf)], "up": [up], "nodes": packed[:1], "states": packed[1:], "top": [nodes[-1][0].tobytes()]})

    rows = rows.select("group_key", F.floor(F.col("_n") / size).alias("run"), "_n", "total", "digest")
    return written(rows.groupBy("group_key", "run").applyInPandas(raise_, "group_key string, run long, total long, leaves long, up int, nodes binary, states binary, top binary"), "runs")


def _tops(runs: DataFrame) -> DataFrame:
    return runs.select("group_key", F.col("run").alias("_n"), "total", F.col("top").alias("digest"))


def tree(rows: DataFrame, arity: int = 2, levels: int = LEVELS) -> list[DataFrame]:
    """The tables of runs, from the leaves (group_key, _n, total, digest) up to one run for each group."""
    tables = [_runs(rows, arity, levels)]
    while tables[-1].filter("total > 1").head(1):
        tables.append(_runs(_tops(tables[-1].filter("total > 1")), arity, levels))
    return tables


def _unpacked(run: dict, arity: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sizes = _sizes(run["leaves"], run["up"], arity)
    return _split(run["nodes"], sizes), _split(run["states"], sizes[:-1])


def _path(steps: list[dict]) -> list[tuple[bytes, bytes, bytes]]:
    return [(x["kept"], x["left"], x["right"]) for x in steps]


def _down(runs: DataFrame, paths: DataFrame, arity: int, size: int) -> DataFrame:
    """From the paths of runs (group_key, run, path, subroot, root): those of their leaves, under their number in the group."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                run = batch.slice(i, 1).to_pylist()[0]
                nodes, states = _unpacked(run, arity)
                for first in range(0, run["leaves"], 256):
                    some = range(first, min(first + 256, run["leaves"]))
                    own = [[dict(zip(("kept", "left", "right"), x, strict=True)) for x in _steps(nodes, states, k, arity)] + run["path"] for k in some]
                    columns = [[run["group_key"]] * len(some), [run["run"] * size + k for k in some], own, [run["subroot"]] * len(some), [run["root"]] * len(some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PATHS.types, strict=True)], schema=_PATHS)

    return runs.join(paths, ["group_key", "run"]).mapInArrow(each, f"group_key string, run long, path {_STEP}, subroot binary, root binary")


def _descended(tables: list[DataFrame], tops: DataFrame, arity: int, size: int) -> DataFrame:
    """The paths of the lowest table's runs, from those of the groups' roots (group_key, path, subroot, root)."""
    found = None
    for table in reversed(tables):
        # A group's last table has one run of it; the groups of lower trees join in further down.
        own = table.filter("total = 1").select("group_key", "run").join(tops, "group_key")
        found = own if found is None else own.unionByName(found)
        if table is not tables[0]:
            found = written(_down(table, found, arity, size), "paths")
    return found


def _hex(digests: np.ndarray) -> pa.Array:
    flat = _HEX[digests].reshape(-1)
    return pa.Array.from_buffers(pa.string(), len(digests), [None, pa.py_buffer(np.arange(0, len(flat) + 1, 64, dtype=np.int32)), pa.py_buffer(flat)])


class Manifest:
    """A dataset's tree: leaves with their places, tables of runs with all nodes and states, and the same above the groups' roots."""

    def __init__(self, rows: DataFrame, order: list[str], arity: int = 2, levels: int = LEVELS):
        """rows: group_key (from group_key()), digest (32 bytes), the columns of order, and others to carry; a written table, as it is read more than once."""
        self.arity, self.size = arity, arity**levels
        self.leaves = placed(rows, order)
        self.runs = tree(self.leaves, arity, levels)
        done = [table.filter("total = 1").select(F.lit(ROOT).alias("group_key"), F.col("group_key").alias("of"), F.col("top").alias("digest")) for table in self.runs]
        self.subroots = placed(functools.reduce(DataFrame.unionByName, done), ["of"])
        self.above = tree(self.subroots, arity, levels)

    def root(self) -> DataFrame:
        """One row, or none without leaves: root."""
        return self.above[-1].filter("total = 1").select(F.col("top").alias("root"))

    def paths(self) -> DataFrame:
        """group_key, run, path, subroot, root of each lowest run: what joins its top on the way to the root."""
        top = self.root().select(F.lit(ROOT).alias("group_key"), F.array().cast(_STEP).alias("path"), F.lit(b"").alias("subroot"), "root")
        ends = _down(self.above[0], _descended(self.above, top, self.arity, self.size), self.arity, self.size)
        of = self.subroots.select(F.col("_n").alias("run"), F.col("of").alias("group_key"), "digest")
        tops = written(ends.drop("group_key", "subroot").join(of, "run").select("group_key", "path", F.col("digest").alias("subroot"), "root"), "paths")
        return written(_descended(self.runs, tops, self.arity, self.size), "paths")

    def folds(self, changed: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
        """key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf, as hex.

        changed is a column of digests: where it isn't null, folding starts from it, else from the leaf. The
        states before the node on each level stand for all that is left of it; the proof is over its siblings.
        """
        arity, size = self.arity, self.size

        def each(leaves: pa.Table, runs: pa.Table) -> pa.Table:
            run = runs.to_pylist()[0]
            nodes, states = _unpacked(run, arity)
            path = _path(run["path"])
            at = leaves["_n"].to_numpy() % size
            start = np.frombuffer(b"".join(leaves["start"].to_pylist()), np.uint8).reshape(-1, 32)
            ends = folded(start, at, nodes, states, path, arity)
            hexes = [_HEX[x].tobytes() for x in nodes[:-1]]
            rest = b"".join(_HEX[np.frombuffer(left + right, np.uint8)].tobytes() for _, left, right in path)
            proofs = []
            for i in at.tolist():
                beside = []
                for level in hexes:
                    first = i // arity * arity
                    beside += level[first * 64 : i * 64], level[(i + 1) * 64 : (first + arity) * 64]
                    i //= arity
                proofs.append(hashlib.sha256(b"".join(beside) + rest).hexdigest())
            n = len(at)
            same = [pa.array([run[c].hex()] * n, pa.string()) for c in ("subroot", "root")]
            good = (ends == np.frombuffer(run["root"], np.uint8)).all(axis=1)
            return pa.table([leaves[key], _hex(nodes[0][at]), *same, pa.array(proofs, pa.string()), _hex(ends), pa.array(good)], names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        leaves = self.leaves.select("group_key", F.floor(F.col("_n") / size).alias("run"), "_n", key, F.coalesce(changed, "digest").alias("start"))
        runs = self.runs[0].select("group_key", "run", "leaves", "up", "nodes", "states").join(self.paths(), ["group_key", "run"])
        schema = f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return leaves.groupBy("group_key", "run").cogroup(runs.groupBy("group_key", "run")).applyInArrow(each, schema)


def hashed(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, key: str = "doc_id", **changed: Column) -> DataFrame:
    """group_key, key, uid, digest of each row, and changed: the digest with columns changed, where one is; written."""
    same = leaf(fields)
    other = F.lit(False)
    for name, value in changed.items():
        other |= ~F.col(name).eqNullSafe(value)
    rows = docs.select(group_key(group).alias("group_key"), key, F.monotonically_increasing_id().alias("uid"), F.unhex(same).alias("digest"), F.when(other, F.unhex(leaf(fields, **changed))).alias("changed"))
    return written(rows, "hashed")


def verification(docs: DataFrame) -> DataFrame:
    """op13's rows: each document's proof, and the root folded from it, tampered where 7 divides the crc32 of its doc_id."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = hashed(docs, n_chars=F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return Manifest(rows, ["doc_id", "digest", "uid"]).folds("changed")
