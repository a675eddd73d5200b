"""Substring search through an index of trigrams: texts are read only where all trigrams of the query stand."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

SIZE, _BITS = 3, 21


def folded(columns: tuple[str, ...]) -> Column:
    """The columns joined by spaces, in lower case: what is searched."""
    return F.lower(F.concat_ws(" ", *[F.col(f"`{c}`") for c in columns]))


def trigrams(text: str) -> np.ndarray:
    """The distinct runs of three code points as 63-bit numbers, so that equal numbers are equal runs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) < SIZE:
        return np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:])


@dataclass(frozen=True)
class Index:
    """rows with _row, their number; and (gram, _row), a row for each trigram of each text, ordered by gram."""

    rows: DataFrame
    grams: DataFrame
    columns: tuple[str, ...]


def build(rows: DataFrame, *columns: str) -> Index:
    """An index over the columns of rows.

    The postings are dealt out by ranges of (gram, _row) and written in that order: a trigram that stands in
    every text spans as many files as it needs, and a search reads only the row groups of its own trigrams.
    Nulls count as absent, texts of fewer than three characters have no postings, rows may repeat.
    """
    if "_row" in rows.columns:
        raise ValueError("column _row is the index's own")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "search-rows")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("_row").to_pylist(), batch.column("text"), strict=True):
                found = trigrams(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), number))], names=["gram", "_row"])

    grams = rows.select("_row", folded(columns).alias("text")).mapInArrow(each, "gram long, _row long")
    return Index(rows, written(grams.repartitionByRange("gram", "_row").sortWithinPartitions("gram", "_row"), "search-grams"), columns)


def candidates(index: Index, query: str) -> DataFrame | None:
    """_row of the texts that hold all trigrams of a query; None if it has none, and any text may hold it."""
    asked = trigrams(index.rows.sparkSession.range(1).select(F.lower(F.lit(query.strip()))).first()[0])
    if not len(asked):
        return None
    hits = index.grams.filter(F.col("gram").isin(asked.tolist()))
    return hits.groupBy("_row").agg(F.count("*").alias("n")).filter(F.col("n") == len(asked)).select("_row")


def search(index: Index, query: str) -> DataFrame:
    """The rows in which the columns, joined by spaces, hold the query, whatever the case: as conversation.search() gives.

    A query of fewer than three characters has no trigrams and is answered by a scan.
    """
    some = candidates(index, query)
    rows = index.rows if some is None else index.rows.join(some, "_row", "left_semi")
    return rows.filter(folded(index.columns).contains(F.lower(F.lit(query.strip())))).drop("_row")
