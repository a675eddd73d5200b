import math

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing


def water(sizes, weights=(3, 1, 2)):
    """Targets by giving out, and giving again what full sources can't take."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else share[s]
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_targets(documents):
    texts = [(i, "w " * (5 + i * 37 % 400), "en", [None, "b", "a", "é", "c"][min(4, i % 9)]) for i in range(300)]
    rows = mixing.mix(documents(texts), block_tokens=8).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for s, total in sizes.items():
        some = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in some} == {total}
        assert all(abs(r["target"] - want[s]) < 1e-6 * want[s] for r in some)
        assert abs(sum(r["taken"] for r in some) - want[s]) < 1
    again = mixing.mix(documents(texts), block_tokens=8).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_apportionment(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0}
    for seats in (1, 2, 7, 10, 1000):
        table = spark.createDataFrame([("g", k, v, seats) for k, v in votes.items()], "g string, k string, v long, seats long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(table, ["g"], ["k"], "v", "seats").collect()}
        order = sorted(((-v / (2 * i + 1), k) for k, v in votes.items() for i in range(seats)))[:seats]
        assert got == {k: sum(1 for _, x in order if x == k) for k in votes}


def test_take_mix(documents):
    docs = documents([(i, f"a{i} b c d\ne f g h " * 40, "en", "s") for i in range(30)] + [(99, None, "en", "t")], "size")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.take_mix(docs)
    words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert out.columns == docs.columns and words == {i: n for i, n in taken.items() if n}
    assert out.filter("n_chars <> length(text)").count() == 0


def test_odd(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 8 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_short_texts_among_many_shards(documents):
    """A source whose texts stand one to a shard of the whole table still gets its target."""
    texts = [(i, "w " * 10, "en", "a") for i in range(400)] + [(1000 + i, "w " * 300, "en", "b") for i in range(400)] + [(2000 + i, "", "en", "a") for i in range(50)]
    rows = mixing.mix(documents(texts), docs_per_shard=1).collect()
    assert len(rows) == len(texts)
    for s in "ab":
        some = [r for r in rows if r["source"] == s]
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in some)
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) < 1


@pytest.mark.parametrize("rows", [[(1, "a b c", "en", "a"), (2, "d e f", "en", "b")], [(i, f"w{i}", "en", f"s{i}") for i in range(7)], [(1, "w " * 500, "en", "a"), (2, "one", "en", "b"), (3, "two words", "en", "c"), (4, "", "en", "d")]])
def test_small_sources_get_their_targets(documents, rows):
    """However far below a block a target is."""
    got = mixing.mix(documents(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water(sizes)
    for s in sizes:
        some = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in some) == math.floor(want[s] + 1e-9) and all(0 <= r["taken"] <= 2 * r["size"] for r in some)
    out = mixing.take_mix(documents(rows))
    assert out.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def test_columns_with_clashing_names(documents):
    docs = documents([(i, "a b c d " * 9, "en", "s") for i in range(9)])
    more = docs.withColumns({c: F.lit(5) for c in ("_whole", "_rest", "_copy", "target", "_docs_text", "_text", "taken", "rank")})
    out = mixing.take_mix(more)
    assert out.columns == more.columns and sorted(r["text"] for r in out.collect()) == sorted(r["text"] for r in mixing.take_mix(docs).collect())
    assert {tuple(r) for r in out.select("_whole", "_docs_text", "taken").collect()} == {(5, 5, 5)}
