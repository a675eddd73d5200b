"""Ordered work without a single task: keep-first and running numbers inside large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def keep_first(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by order; combined before the shuffle, so repeated keys cost little."""
    rest = [c for c in rows.columns if c not in keys]
    if rest == [order]:  # a number a key is combined in a hash table; what holds texts must be sorted
        return rows.groupBy(*keys).agg(F.min(order).alias(order)).select(*rows.columns)
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*rows.columns)


def numbered(rows: DataFrame, by: list[str], order: str | list[str] = "ord", out: str = "n", total: str | None = None) -> DataFrame:
    """rows with their number from 1 in each group, by order (distinct in each group; a column or several).

    total names a column for the number of rows in the group, if it is wanted.

    The rows are dealt out once, by ranges of group and order, and written in that order with their place:
    a large group spans many ranges, a range holds many small groups. What a group has in the ranges before
    is a running sum over one row for each group and range, a table of its own: Spark sees its size and sends it
    to the rows where it is small, which then aren't shuffled again. A null group is a group.
    """
    keys = [*by, *([order] if isinstance(order, str) else order)]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = written(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    spans = written(ranged.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_size")), "spans")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    add = (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add")
    sums = [F.sum("_size").over(Window.partitionBy(*by)).alias(total)] if total else []
    starts = spans.select(F.col("_range").alias("_in"), *[F.col(c).alias(f"_of_{c}") for c in by], add, *sums)
    same = F.col("_range") == F.col("_in")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ranged.join(starts, same).withColumn(out, F.col("_at") + F.col("_add")).select(*rows.columns, out, *([total] if total else []))
