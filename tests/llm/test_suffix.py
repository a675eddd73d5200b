import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import suffix
from loomgraph.llm.transforms import Shards, merge


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(dice):
    word = lambda: "".join(dice.choice("abcdé ") for _ in range(8))
    passages = ["".join(word() for _ in range(60)) for _ in range(4)]
    texts = ["".join(word() for _ in range(dice.randrange(120))) for _ in range(40)]
    for k in range(0, 40, 2):
        p = dice.choice(passages)
        a, b = sorted((dice.randrange(len(p)), dice.randrange(len(p))))
        texts[k] = texts[k][: dice.randrange(400)] + p[a:b] + texts[k][:50]
    return [*texts, texts[0], "z" * 1000, "xy" * 300, "abc" * 66 + "ab", "q" * 200, "q" * 199, "", None]


@pytest.mark.parametrize("crowd", [2000, 1])
def test_against_brute_force(documents, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    texts = corpus(random.Random(crowd))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removal(documents(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_long_texts_in_pieces(documents, monkeypatch):
    dice = random.Random(9)
    long = "".join(dice.choice("abcdefgh ") for _ in range(3_000_000))
    texts = [long, long[1_000_000:1_000_700] + "tail", long[2_090_000:2_110_000]]
    got = {r["doc_id"]: r for r in suffix.removal(documents(texts)).collect()}
    assert (got[0]["n_removed"], got[0]["n_spans"]) == (700 + 20_000, 2)
    assert got[1]["n_removed"] == 700 and got[2]["n_removed"] == 20_000


def test_cut_texts(documents):
    passage = "é" * 1 + "".join(f"w{i} " for i in range(80))
    docs = documents(["before " + passage + " after ü", "ü" + passage, "clean text"], "size")
    out = {r["doc_id"]: r for r in suffix.without_repeats(docs).collect()}
    assert out[2]["text"] == "clean text" and passage[:40] not in out[0]["text"] and out[0]["text"].startswith("before")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_odd(odd):
    got = suffix.removal(odd).collect()
    assert len(got) == 8 and {r["n_removed"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert suffix.removal(odd.limit(0)).count() == 0
    assert suffix.without_repeats(odd).columns == odd.columns
    assert suffix.without_repeats(odd.limit(0)).agg(F.count("*")).first()[0] == 0


def test_merged_transforms_against_all_pairs():
    dice = random.Random(3)
    for _ in range(120):
        length, letters = dice.choice([5, 8, 12, 16, 24, 40]), dice.choice([b"ab", b"abcdefgh", bytes(range(256))])
        some = lambda n, letters=letters: bytes(dice.choice(letters) for _ in range(n))
        base = [some(120) for _ in range(3)]
        strings = []
        for _ in range(dice.randrange(1, 14)):
            at = dice.randrange(100)
            strings.append(some(dice.randrange(30)) + dice.choice(base)[at : at + dice.randrange(20 + length)] + some(dice.randrange(30)))
        shards = Shards(strings, np.array([dice.randrange(dice.choice([1, 2, 4])) for _ in strings]), length)
        seen = {}
        for i, x in enumerate(strings):
            for k in range(len(x) - length + 1):
                seen.setdefault(x[k : k + length], []).append((i, k))
        which, place = shards.repeated()
        assert list(zip(which.tolist(), place.tolist(), strict=True)) == sorted(w for v in seen.values() if len(v) > 1 for w in v)
        for some, x in zip(shards.of, shards.transforms, strict=True):  # each shard's rows are its own suffixes in order
            whole = [strings[some[x.which[q]]][x.place[q] :][:length] for q in x.order if x.place[q] + length <= shards.sizes[some[x.which[q]]]]
            assert whole == sorted(whole)


def shared_by_bytes(strings, shard, length, step):
    """Of each (string, place): the most whole symbols in common with a place of another shard, as far as length."""
    found = {}
    for i, x in enumerate(strings):
        for k in range(len(x)):
            best = 0
            for j, y in enumerate(strings):
                for m in range(len(y)) if shard[i] != shard[j] else ():
                    n = 0
                    while n < length // step and k + (n + 1) * step <= len(x) and m + (n + 1) * step <= len(y) and x[k + n * step : k + (n + 1) * step] == y[m + n * step : m + (n + 1) * step]:
                        n += 1
                    best = max(best, n)
            found[i, k] = best
    return found


def some_shards(dice, length):
    base = bytes(dice.choice(b"ab") for _ in range(60))
    strings = [base[at : at + dice.randrange(length, 40)] + bytes(dice.choice(b"abc") for _ in range(5)) for at in (dice.randrange(30) for _ in range(6))]
    return strings, [0, 1, 2, 0, 1, 2]


def test_common_prefixes_and_order_of_the_interleave():
    dice = random.Random(8)
    for length in (6, 16):
        strings, shard = some_shards(dice, length)
        shards = Shards(strings, np.array(shard), length)
        step = length // shards.depth
        blocks, common = merge(shards.transforms, shards.depth)
        want, placed = shared_by_bytes(strings, shard, length, step), []
        for x, some, c, b in zip(shards.transforms, shards.of, common, blocks, strict=True):
            for row, place in enumerate(x.order):
                string = some[x.which[place]]
                assert c[row] == want[string, x.place[place]]
                rest = strings[string][x.place[place] :]
                if len(rest) >= length and c[row] == shards.depth:
                    placed.append((b[row], rest[:length]))
        assert [x for _, x in sorted(placed)] == sorted(x for _, x in placed)


def test_merge_reads_the_transforms_order():
    """With a shard's rows out of order, the merge goes wrong: nothing else sorts them."""
    dice = random.Random(8)
    strings, shard = some_shards(dice, 16)
    shards = Shards(strings, np.array(shard), 16)
    right = [x.tolist() for x in merge(shards.transforms, shards.depth)[1]]
    x = shards.transforms[0]
    x.first, x.follow = x.first[::-1].copy(), x.follow[::-1].copy()
    assert [c.tolist() for c in merge(shards.transforms, shards.depth)[1]] != right


def test_columns_with_clashing_names(spark, documents):
    passage = "".join(f"w{i} " for i in range(80))
    docs = documents(["before " + passage, "ü" + passage, "clean text"])
    for names in (["_id", "_th", "_bucket", "_bits"], ["starts", "_starts", "_ends", "_hit", "_maybe", "ID"]):
        more = docs.withColumns({n: F.lit(7) for n in names})
        out = suffix.without_repeats(more)
        assert out.columns == more.columns and [r["text"] for r in out.orderBy("doc_id").collect()] == [r["text"] for r in suffix.without_repeats(docs).orderBy("doc_id").collect()]
