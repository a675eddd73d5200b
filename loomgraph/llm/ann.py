"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the largest cosine is the smallest distance. Each of TABLES hash
tables has m functions floor((a.v + b) / WIDTH) with Gaussian a. A query visits, in every table, its own
bucket and then perturbed ones in the order of their estimated success: the sum of squared distances to
the crossed cell borders, smallest first. Candidates are ranked by the exact cosine in double precision.

m and how far a query's visits go are fitted on a sample of at most SAMPLE rows with SAMPLE_QUERIES of
them as queries, whose exact neighbours among all rows are found by a scan: for each m, the estimate up to
which a query must go so that GOAL of the neighbours lie in buckets it visits, and the share of the rows that lie there too; the m with the smallest
share is taken, among those where a query visits at most MOST_PROBES buckets a table. The index holds every
row. Tables of up to FEW rows are one bucket. A bucket is cut into blocks of BLOCK rows, and its queries
into blocks of QUERIES, which meet in separate tasks, so no task holds a whole large bucket or all its
queries. A query that has found fewer than k neighbours visits every bucket of the first table.

How small the share can be depends on the vectors: where neighbours stand out (texts of one subject) it is
a few hundredths; among independent directions, where the nearest of many rows is hardly nearer than any
other, no choice of buckets is far below all rows, and most rows are scored.

Equal vectors: of each, only the k+1 smallest vec_id can be among k nearest, so the others aren't put
into the index; queries with equal vectors are searched once. Nothing else is left out.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part,
nor do those of another length than most rows have; rows with equal vec_id and vector are one row; with
fewer than k candidates all are returned; ties go to the smaller vec_id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

TABLES, WIDTH, FEW, BLOCK, QUERIES = 2, 1.0, 512, 4096, 1024
SAMPLE, SAMPLE_QUERIES, GOAL, MOST_PROBES = 4096, 200, 0.95, 2048
#: The most functions a table, and the fewest rows in an average bucket.
MOST_FUNCTIONS, LEAST_ROWS = 16, 16


class Hashing:
    """The functions of all tables."""

    def __init__(self, size: int, m: int, tables: int = TABLES, width: float = WIDTH, seed: int = 11):
        dice = np.random.default_rng(seed)
        self.m, self.tables, self.width, self.reach, self.share = m, tables, width, 0.0, 1.0
        self.a, self.b = dice.standard_normal((tables, m, size)), dice.uniform(0, width, (tables, m))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(tables, rows, m): where each vector stands, in cells."""
        return (np.einsum("tmd,nd->tnm", self.a, vectors) + self.b[:, None, :]) / self.width

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """A number for each row of cells; -1 .. 1 steps in a coordinate never collide by wrapping."""
        key = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(cells.shape[-1]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        return key.view(np.int64)

    def visits(self, place: np.ndarray, most: int | None = None) -> np.ndarray:
        """Cells of one table that a query visits, in order of estimated success: as far as reach, at most `most`."""
        cell = np.floor(place)
        down = place - cell
        order = sorted((x * x, j, step) for j in range(self.m) for x, step in ((down[j], -1), (1 - down[j], 1)))
        found, heap, n = [()], [(order[0][0], (0,))] if order else [], len(order)
        while heap and heap[0][0] <= self.reach and (most is None or len(found) < most):
            score, some = heapq.heappop(heap)
            last = some[-1]
            if last + 1 < n:
                heapq.heappush(heap, (score - order[last][0] + order[last + 1][0], (*some[:-1], last + 1)))
                heapq.heappush(heap, (score + order[last + 1][0], (*some, last + 1)))
            if len({order[i][1] for i in some}) == len(some):  # not both ways in one coordinate
                found.append(some)
        cells = np.repeat(cell[None, :], len(found), axis=0)
        for row, some in enumerate(found):
            for i in some:
                cells[row, order[i][1]] += order[i][2]
        return cells

    def costs(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(queries, rows): the smallest estimate at which a query visits a row's cell, from the places of either.

        rows: (tables, rows, m), or (tables, queries, rows, m) if each query has rows of its own.
        """
        own = rows.ndim == 4
        found = np.full((queries.shape[1], rows.shape[-2]), np.inf)
        for t in range(self.tables):
            for q in range(queries.shape[1]):
                cell = np.floor(queries[t, q])
                step, down = np.floor(rows[t, q] if own else rows[t]) - cell, queries[t, q] - cell
                cost = np.where(step == 0, 0.0, np.where(step == -1, down**2, np.where(step == 1, (1 - down) ** 2, np.inf))).sum(axis=1)
                found[q] = np.minimum(found[q], cost)
        return found


def valid(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: the rows that take part, vectors as doubles."""
    rows = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that squares neither overflow nor vanish; exact, and of the same direction."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[:, None]


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pair by pair in the same order of additions, so that equal vectors get equal scores."""
    queries, vectors = _scaled(queries), _scaled(vectors)
    lengths = np.sqrt(np.einsum("qd,qd->q", queries, queries))[:, None] * np.sqrt(np.einsum("nd,nd->n", vectors, vectors))[None, :]
    return np.einsum("qd,nd->qn", queries, vectors) / lengths


def fit(rows: DataFrame, k: int) -> Hashing | None:
    """Functions and reach of the visits, from a bounded sample of rows (vec_id, v)."""
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size")).first()
    n = about["n"]
    if not n:
        return None
    best = Hashing(about["size"], 0)
    if n <= FEW:
        return best
    share = min(1.0, SAMPLE / n)
    some = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec_id", "v").limit(2 * SAMPLE).toPandas()
    if len(some) <= k:
        return best
    vectors = _unit(np.array(some["v"].tolist()))
    asked = min(SAMPLE_QUERIES, len(vectors))
    near = _nearest(rows, some["vec_id"].to_numpy()[:asked], vectors[:asked], k)
    for m in range(1, min(MOST_FUNCTIONS, max(1, int(math.log2(n / LEAST_ROWS)))) + 1):
        hashing = Hashing(about["size"], m)
        places = hashing.places(vectors)
        to_near = hashing.costs(places[:, :asked], hashing.places(near.reshape(-1, near.shape[-1])).reshape(hashing.tables, asked, k, m))
        hashing.reach = float(np.quantile(to_near, GOAL, method="higher"))
        if not np.isfinite(hashing.reach):
            break  # further functions only take neighbours further away
        hashing.share = float((hashing.costs(places[:, :asked], places) <= hashing.reach).mean())
        if hashing.share < best.share:
            visited = [len(hashing.visits(places[0, q], MOST_PROBES + 1)) for q in range(0, asked, 10)]
            if max(visited) <= MOST_PROBES:
                best = hashing
    return best


def _nearest(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """(queries, k, size): the unit vectors of each query's k nearest rows besides itself, by a scan of all rows.

    The queries are at most SAMPLE_QUERIES; every Arrow batch keeps its k best for each.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, vectors = batch.column("vec_id").to_numpy(), _unit(np.array(batch.column("v").to_pylist()))
            scores = np.where(own[None, :] == ids[:, None], -2.0, queries @ vectors.T)
            top = np.argsort(-scores, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), top.shape[1])), pa.array(np.take_along_axis(scores, top, 1).ravel()), pa.array(list(vectors[top.ravel()]), pa.list_(pa.float64()))], names=["q", "score", "v"])

    best = rows.select("vec_id", "v").mapInArrow(each, "q long, score double, v array<double>")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k).orderBy("q", "n").select("v").toPandas()["v"]
    return np.array(best.tolist()).reshape(len(ids), k, -1)


def _copies(rows: DataFrame, keep: int) -> DataFrame:
    """The rows with the `keep` smallest vec_id of each vector; first within shares of a vector's rows."""
    part = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(97))).withColumn("n", part("v", "salt")).filter(F.col("n") <= keep).drop("n", "salt")
    return some.withColumn("n", part("v")).filter(F.col("n") <= keep).drop("n")


def _best(visits: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, score: of each query the k best in every block of every bucket it visits."""

    def each(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            vectors, ids = np.array(rows["v"].tolist()), rows["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors, ids = vectors[order], ids[order]
            for at in range(0, len(queries), 512):
                scores = _cosines(np.array(queries["v"].iloc[at : at + 512].tolist()), vectors)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"qid": np.repeat(queries["qid"].to_numpy()[at : at + 512], best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "vec_id": [], "score": []})

    by = ["t", "key", "block", "part"]
    return visits.groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(each, "qid long, vec_id long, score double")


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries (vec_id, v) its k nearest rows (vec_id, v).

    Both must come from valid(). A query's own row is the one with its vec_id.
    """
    spark = rows.sparkSession
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = size["size"] if size else 0
    rows = rows.filter(F.size("v") == size).dropDuplicates()
    queries = queries.filter(F.size("v") == size).dropDuplicates()
    kept = written(_copies(rows, k + 1), "vectors")
    hashing = fit(kept, k)
    if hashing is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = hashing.keys(np.floor(hashing.places(_unit(np.array(batch.column("v").to_pylist())))))
            for t in range(hashing.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(cells[t]), batch.column("vec_id"), batch.column("v")], names=["t", "key", "vec_id", "v"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                where = hashing.places(_unit(np.array(some.column("v").to_pylist())))
                for t in range(hashing.tables):
                    cells = [hashing.keys(hashing.visits(p)) for p in where[t]]
                    again = pa.array(np.repeat(np.arange(some.num_rows), [len(c) for c in cells]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(again), t, np.int32)), pa.array(np.concatenate(cells)), some.column("qid").take(again)], names=["t", "key", "qid"])

    index = written(kept.mapInArrow(places, "t int, key long, vec_id long, v array<double>"), "index")
    blocks = index.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Queries with equal vectors are one.
    asked = written(queries.groupBy("v").agg(F.min("vec_id").alias("qid")), "asked")

    def best(visits: DataFrame) -> DataFrame:
        """The k + 1 best rows a query and block of the buckets in visits (t, key, qid)."""
        parts = visits.groupBy("t", "key").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        about = written(blocks.join(parts, ["t", "key"]), "about")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = visits.join(about, ["t", "key"]).select("t", "key", "qid", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block")).join(asked, "qid")
        theirs = index.join(about, ["t", "key"]).select("t", "key", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"))
        return _best(mine, theirs, k + 1)

    visits = written(asked.mapInArrow(probes, "t int, key long, qid long"), "visits")
    found = written(_top(best(visits), k + 1), "found")
    enough = min(k + 1, kept.count())
    short = asked.join(found.groupBy("qid").count(), "qid", "left").filter(F.coalesce("count", F.lit(0)) < enough).select("qid")
    if short.take(1):
        every = short.withColumn("t", F.lit(0)).join(blocks.filter("t = 0"), "t")
        found = found.unionByName(best(written(every.select("t", "key", "qid"), "visits")))
    owners = queries.join(asked, "v").select("qid", F.col("vec_id").alias("query_id"))
    joined = owners.join(found, "qid").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return joined.select("query_id", "vec_id", "score").dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["qid", "vec_id"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """op5's rows: the rows whose vec_id is divisible by `every` as queries against all rows."""
    rows = valid(embeddings)
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k)
