import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, fields=merkle.FIELDS):
    return h(*["-" if (v := row[f]) is None else f"{len(str(v).encode())}:{v}" for f in fields])


def up(nodes, arity):
    """All levels, from a list of digests to the one left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def beside(levels, at, arity):
    found = []
    for level in levels[:-1]:
        first = at // arity * arity
        found += level[first:at] + level[at + 1 : first + arity]
        at //= arity
    return found


def expected(rows, arity=2):
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    names = sorted(groups, key=str.encode)
    trees = {g: up([leaf(r) for r in groups[g]], arity) for g in names}
    top = up([trees[g][-1][0] for g in names], arity)
    found = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            changed = leaf({**r, "n_chars": r["n_chars"] + 1}) if hit else leaf(r)
            levels = [list(x) for x in trees[g]]
            levels[0][i] = changed
            sub = up(levels[0], arity)[-1][0]
            root = up([sub if x == g else trees[x][-1][0] for x in names], arity)[-1][0]
            found.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*beside(trees[g], i, arity), *beside(top, k, arity)), root, root == top[-1][0]))
    return sorted(found, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(rows):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=str)


def test_absorb_is_sha256():
    for n in (0, 1, 3):
        data = bytes(range(64)) * n
        state = merkle._START[:, None]
        for i in range(n):
            state = merkle.absorb(state, np.frombuffer(data[64 * i : 64 * i + 64], ">u4").astype(np.uint32)[:, None])
        assert merkle._closed(state, np.array([n])).tobytes() == hashlib.sha256(data).digest()


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 40), st.integers(2, 5), st.integers(0, 3))
def test_raised_and_folded(n, arity, more):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = merkle.heights(n, arity) + more
    nodes, states = merkle.raised(np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32), levels, arity)
    want = up([x.hex() for x in leaves], arity)
    assert [x.tobytes().hex() for level in nodes for x in level][: sum(map(len, want))] == sum(want, [])
    changed = np.frombuffer(hashlib.sha256(b"other").digest() * n, np.uint8).reshape(-1, 32)
    ends = merkle.folded(changed, np.arange(n), nodes, states, [], arity)
    for i in range(n):
        other = [x.hex() for x in leaves]
        other[i] = changed[0].tobytes().hex()
        root = up(other, arity)[-1][0]
        for _ in range(more):
            root = h(root)
        assert ends[i].tobytes().hex() == root


def test_states_stand_for_what_is_left_of_a_node():
    """Folding gives the same root when the digests left of a node are gone."""
    leaves = np.frombuffer(hashlib.sha256(b"x").digest() * 9, np.uint8).reshape(-1, 32)
    nodes, states = merkle.raised(leaves, 2, 3)
    blind = [x.copy() for x in nodes]
    blind[0][:8] = 0
    blind[1][:2] = 0
    assert (merkle.folded(leaves[8:], np.array([8]), blind, states, [], 3) == nodes[-1][0]).all()


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 1)])
def test_rows(documents, arity, levels):
    rows = [(i, f"text {i % 50}", [None, "de", "en", "en", "é", "fr"][i % 6] if i else "lone", ["a", None][i % 2]) for i in range(90)]
    docs = documents(rows)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    hashed = merkle.hashed(docs, n_chars=F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    found = got(merkle.Manifest(hashed, ["doc_id", "digest", "uid"], arity, levels).folds("changed"))
    assert found == expected([r.asDict() for r in docs.collect()], arity)


def test_op13_rows(odd):
    found = got(merkle.verification(odd))
    assert found == expected([r.asDict() for r in odd.collect()])
    assert merkle.verification(odd.limit(0)).count() == 0


def test_null_size_is_not_tampered(documents):
    docs = documents([(i, "t", "en", None) for i in range(40)]).withColumn("n_chars", F.lit(None).cast("long"))
    assert all(r["verified"] for r in merkle.verification(docs).collect())


def test_one_row(documents):
    row = merkle.verification(documents([(2, "abc", "en", "a")])).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")
