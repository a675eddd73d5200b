"""Exact top-k by dot product over a vector index cut into blocks, most of which a query needn't see.

Each row of the index belongs to the cell of its nearest centre (at most CENTRES of the rows, chosen by hash) and
to a ring of that cell, by its distance from the centre. A block is a ring, or a share of one that is too full,
packed into one row, and is written once, bucketed by block: rows of the index cross the network once, when the
blocks are made, and never when they are searched. A block's table keeps its ring's distances and its largest norm.
With d(q, x) >= |d(q, c) - d(c, x)|, q.x = (q.q + x.x - d(q, x)^2) / 2 has a bound from the ring alone.

A query first meets the blocks nearest to it; its k-th best score there is a floor. Then it meets the other blocks
whose bound reaches that floor. Queries travel to blocks in packs of at most PACK, so no block's queries are in one task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_path, written

CENTRES, ROWS, PACK = 1024, 2048, 512
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else list(column), np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a from each of b, some at a time so that memory stays small."""
    step = max(1, (1 << 22) // max(1, b.shape[0] * b.shape[1]))
    return np.concatenate([np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(-1)) for i in range(0, len(a), step)]) if len(a) else np.zeros((0, len(b)))


class BlockIndex:
    """The blocks of an index (key, embedding): `table` of packed rows, `rings` with their bounds, and the centres."""

    def __init__(self, index: DataFrame, key: str = "vec_id", rows: int = ROWS, centres: int = CENTRES):
        self.spark, self.key = index.sparkSession, key
        index = index.select(key, F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
        self.n = index.count()
        wanted = max(1, min(centres, math.isqrt(self.n)))
        # At most CENTRES vectors, whatever the size of the index.
        chosen = index.select("v", F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(wanted).collect()
        self.centres = np.unique(_matrix([r["v"] for r in chosen]), axis=0) if chosen else np.zeros((1, 1))
        self.wide = self.spark.sparkContext.broadcast(self.centres)
        placed = written(self._placed(index), "placed")
        self.rings = written(self._rings(placed, rows), "rings")
        # A row of six numbers for each ring, at most 128 * CENTRES: of a fixed size, so sent to every task.
        self.few = self.spark.sparkContext.broadcast(self.rings.orderBy("cell", "ring").toPandas())
        self.table = self._packed(placed)

    def _placed(self, index: DataFrame) -> DataFrame:
        wide, key = self.wide, self.key

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"))
                apart = _distances(v, wide.value) if len(v) else np.zeros((0, 1))
                cell = apart.argmin(1)
                columns = [batch.column(key), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(v)), cell]), pa.array((v * v).sum(1) if len(v) else np.zeros(0))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "v", "cell", "far", "square"])

        return index.mapInArrow(each, f"key {dict(index.dtypes)[key]}, v array<double>, cell int, far double, square double")

    @staticmethod
    def _cut(placed: DataFrame, rows: int) -> DataFrame:
        """cell, cuts: the distances at which a cell's rings end, so that each has about so many rows; at most CENTRES rows."""
        n = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", F.array(*[F.lit(i / 128) for i in range(1, 128)]), F.lit(2000)).alias("p"))
        # Every so many-th of 127 quantiles; cells of more than 128 blocks' rows have their rings shared out below.
        step = F.greatest(F.lit(1), F.floor(128 * F.lit(rows) / F.col("n"))).cast("int")
        return n.select("cell", F.array_distinct(F.filter("p", lambda x, i: (i + 1) % step == 0)).alias("cuts"))

    def _rings(self, placed: DataFrame, rows: int) -> DataFrame:
        """cell, ring, shares, near, far, square: a ring's distances, its largest square, and in how many blocks it is."""
        self.cuts = written(self._cut(placed, rows), "cuts")
        return self._with_ring(placed).groupBy("cell", "ring").agg(F.ceil(F.count("*") / rows).cast("int").alias("shares"), F.min("far").alias("near"), F.max("far").alias("far"), F.max("square").alias("square"), F.count("*").alias("n"))

    def _with_ring(self, placed: DataFrame) -> DataFrame:
        return placed.join(F.broadcast(self.cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda x: x < F.col("far")))).drop("cuts")

    def _packed(self, placed: DataFrame) -> DataFrame:
        # Rings: at most 128 for each of at most CENTRES cells.
        rows = self._with_ring(placed).join(F.broadcast(self.rings.select("cell", "ring", "shares")), ["cell", "ring"])
        rows = rows.withColumn("block", F.concat_ws("-", "cell", "ring", F.pmod(F.xxhash64("key"), F.col("shares"))))
        packs = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "v"))).alias("rows"))
        # Fewer buckets than Spark's partitions would have it deal the index out anew for more tasks.
        name, buckets = f"blocks_{uuid.uuid4().hex}", min(50_000, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n // (ROWS * 8))))
        packs.write.bucketBy(buckets, "block").option("path", shared_path(self.spark, "blocks")).saveAsTable(name)
        return self.spark.table(name)

    def visits(self, asked: DataFrame, home: bool) -> DataFrame:
        """query_id, v, block: the blocks of the ring nearest to each query (home), or those of all others whose bound reaches its floor."""
        wide, few = self.wide, self.few

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ring = few.value
            cell, near, far, square, shares = (ring[c].to_numpy() for c in ("cell", "near", "far", "square", "shares"))
            names = [[f"{c}-{r}-{s}" for s in range(n)] for c, r, n in zip(ring["cell"], ring["ring"], shares, strict=True)]
            for batch in batches:
                q = _matrix(batch.column("v"))
                if not len(q) or not len(ring):
                    continue
                apart = _distances(q, wide.value)
                floors = batch.column("floor").to_numpy(zero_copy_only=False)
                at, found = [], []

                def out(batch=batch, at=at, found=found) -> pa.RecordBatch:
                    take, names_ = pa.array(at, pa.int64()), pa.array(found, pa.string())
                    at.clear(), found.clear()
                    return pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("v").take(take), names_], ["query_id", "v", "block"])

                for i in range(len(q)):
                    d = apart[i][cell]
                    gap = np.maximum(0, np.maximum(d - far, near - d))
                    bound = ((q[i] @ q[i]) + square - gap * gap) / 2
                    first = int(np.lexsort((-bound, gap))[0])
                    some = [first] if home else np.flatnonzero(bound >= floors[i] - SLACK * (1 + abs(floors[i]))).tolist() if np.isfinite(floors[i]) else range(len(ring))
                    for r in some:
                        if home or r != first:
                            at += [i] * len(names[r])
                            found += names[r]
                    if len(at) >= 4096:
                        yield out()
                yield out()

        return asked.mapInArrow(each, f"query_id {dict(asked.dtypes)['query_id']}, v array<double>, block string")

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, key, raw, rank of the k best rows of each query; query_id, blocks, skipped).

        queries: query_id, embedding, of the index's length. Ties go to the smaller key; null vectors find nothing.
        """
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
        first = written(self.visits(asked.withColumn("floor", F.lit(None).cast("double")), True), "homes")
        home = written(self._scored(first, k), "home")
        best = Window.partitionBy("query_id").orderBy(F.desc("raw"), self.key)
        ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        floor = ranked(home).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("raw"))).alias("floor"))
        rest = written(self.visits(asked.join(written(floor, "floors"), "query_id", "left"), False), "visits")
        total = self.few.value["shares"].sum() if len(self.few.value) else 0
        seen = first.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count("*").alias("seen"))
        told = seen.select("query_id", F.lit(int(total)).cast("long").alias("blocks"), (F.lit(int(total)) - F.col("seen")).cast("long").alias("skipped"))
        return ranked(home.unionByName(self._scored(rest, k))), told

    def _scored(self, visits: DataFrame, k: int) -> DataFrame:
        """query_id, key, raw: the k best rows of each visited block for each of its queries."""
        key = self.key
        sizes = written(visits.groupBy("block").agg(F.ceil(F.count("*") / PACK).alias("packs")), "packs")
        packs = visits.join(sizes, "block").groupBy("block", F.pmod(F.xxhash64("query_id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    asked, rows = (batch.column(c).slice(i, 1).flatten() for c in ("asked", "rows"))
                    q, x = _matrix(asked.field("v")), _matrix(rows.field("v"))
                    own = rows.field("key").to_numpy(zero_copy_only=False)
                    scores = np.einsum("qd,nd->qn", q, x)
                    top = np.lexsort((np.broadcast_to(own, scores.shape), -scores))[:, :k]
                    yield pa.RecordBatch.from_arrays(
                        [asked.field("query_id").take(pa.array(np.repeat(np.arange(len(q)), top.shape[1]))), rows.field("key").take(pa.array(top.ravel())), pa.array(np.take_along_axis(scores, top, 1).ravel())],
                        ["query_id", key, "raw"],
                    )

        kinds = dict(visits.dtypes)["query_id"], dict(self.table.dtypes)["rows"].split("key:")[1].split(",")[0]
        return packs.join(self.table, "block").select("asked", "rows").mapInArrow(each, f"query_id {kinds[0]}, {key} {kinds[1]}, raw double")


def top_k_pruned(index: DataFrame | BlockIndex, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query_id, rank, score, key, as rag.top_k_batch gives them, by blocks."""
    found, _ = (index if isinstance(index, BlockIndex) else BlockIndex(index, key)).search(queries, k)
    return found.select("query_id", "rank", F.round("raw", 6).alias("score"), key)
