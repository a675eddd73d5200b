import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph.llm import ann

ROWS = "vec_id long, embedding array<float>"


def brute(vectors, k, every):
    ids = sorted(vectors)
    out = {}
    for q in (i for i in ids if i % every == 0):
        score = {i: float(np.dot(vectors[q], vectors[i]) / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])) for i in ids if i != q}
        out[q] = sorted(score, key=lambda i: (-round(score[i], 12), i))[:k]
    return out


@pytest.mark.parametrize("few", [1000, 64])
def test_recall(spark, monkeypatch, few):
    monkeypatch.setattr(ann, "FEW", few)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 7)
    data = np.random.default_rng(4).standard_normal((600, 16)).astype(np.float32).astype(float)
    got, scores = {}, {}
    for r in ann.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], ROWS), every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        scores[r["query_id"], r["vec_id"]] = r["score"]
    want = brute(dict(enumerate(data)), 5, 20)
    assert all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in got.values()) and set(got) == set(want)
    hit = np.mean([len({i for _, i in got[q]} & set(want[q])) / 5 for q in want])
    assert hit == 1 if few == 1000 else hit >= 0.9
    assert all(abs(x - np.dot(data[a], data[b]) / np.linalg.norm(data[a]) / np.linalg.norm(data[b])) < 1e-12 for (a, b), x in scores.items())


def table(spark, folder, data):
    pq.write_table(pa.table({"vec_id": np.arange(len(data)), "embedding": list(data)}), f"{folder}/v.parquet")
    return spark.read.parquet(f"{folder}/v.parquet")


def test_fifty_thousand(spark, tmp_path):
    """Where neighbours stand out, under a tenth of the rows is scored, and nine of ten neighbours are found."""
    dice = np.random.default_rng(8)
    data = (dice.standard_normal((2500, 24))[dice.integers(0, 2500, 50_000)] + 0.35 * dice.standard_normal((50_000, 24))).astype(np.float32)
    rows = table(spark, tmp_path, data)
    hashing = ann.fit(ann.valid(rows), 5)
    assert hashing.m >= 4 and hashing.share < 0.1
    got = {}
    for r in ann.neighbours(rows, every=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1)[:, None]
    asked = np.arange(0, 50_000, 1000)
    scores = unit[asked] @ unit.T
    scores[np.arange(len(asked)), asked] = -2
    want = np.argsort(-scores, axis=1)[:, :5]
    assert np.mean([len(got[q] & set(w)) / 5 for q, w in zip(asked.tolist(), want.tolist(), strict=True)]) >= 0.9


def test_lengths_that_squares_cannot_hold(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [-1e200, 1e-200]), (50, [5e-324, 0.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 50), (0, 2), (50, 0), (50, 1), (50, 2)]
    assert abs(got[0]["score"] - 3 / 10**0.5) < 1e-12


def test_ties_copies_and_bad_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(100, [2.0, 1.0]), (150, None), (200, [0.0, 0.0]), (250, [nan, 1.0]), (300, [1.0, None]), (350, []), (0, [1.0, 2.0]), (None, [1.0, 1.0])]
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, ROWS)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}


def test_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0])], ROWS)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(rows).collect()) == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.neighbours(rows.limit(0)).count() == 0


def test_visits_are_in_order():
    hashing = ann.Hashing(8, 4)
    place = np.array([0.1, 0.5, 0.8, 3.3])
    hashing.reach = np.inf
    cells = hashing.visits(place)
    cost = [sum((place[j] - np.floor(place[j]) if c < np.floor(place[j]) else 1 - place[j] + np.floor(place[j])) ** 2 * (c != np.floor(place[j])) for j, c in enumerate(row)) for row in cells]
    assert len({tuple(c) for c in cells}) == len(cells) == 81 and cost == sorted(cost)
