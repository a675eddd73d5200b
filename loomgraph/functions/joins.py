"""Joins that hash one side instead of sorting both, where that side's partitions are small."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_MOST, _ADVISED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def hashed_joins(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark hashes the side of a shuffled join whose partitions all came out within the advised size.

    It decides when the shuffle is written, by its figures; where a partition is larger, both sides are sorted as before.
    Only what is run inside counts, so it stands around a step that writes its rows.
    """
    before = spark.conf.get(_MOST)
    spark.conf.set(_MOST, spark.conf.get(_ADVISED))
    try:
        yield
    finally:
        spark.conf.set(_MOST, before)
