"""What the operators of this folder share: tables, the shared folder, filters before joins."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_ROWS, small_batches
from ..sources.tables import shared_dir, shared_path, written

FILTER_BITS = 1 << 24
__all__ = ["BATCH_ROWS", "FILTER_BITS", "WORD", "alone", "forget", "give_back", "give_back_plans", "maybe_in", "shared_dir", "shared_path", "small_batches", "table", "unused", "written"]
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.removeprefix("file://").rstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to differ from all names taken (in any case)."""
    low, found = {x.lower() for x in taken}, []
    for name in names:
        while (name := f"_{name}").lower() in low:
            pass
        found.append(name)
        low.add(name.lower())
    return found


def maybe_in(rows: DataFrame, keys: DataFrame, *key: str, flag: str | None = None) -> DataFrame:
    """The rows whose key has its bit set in a bitmap over keys: all that are in keys, and few others.

    Keeps most other rows out of the shuffle of the join that follows. With flag, all rows, and the
    answer as a column of that name. The bitmap is broadcast; its size is fixed: FILTER_BITS / 32768
    rows of 4 KB. With very many keys it lets more rows through, and the join after it stays exact.
    """
    bucket, bits = unused([*rows.columns, *keys.columns], "bucket", "bits")
    bit = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(maps), bucket, "left" if flag else "inner")
    return (joined.withColumn(flag, hit) if flag else joined.filter(hit)).drop(bucket, bits)


_HELD: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return what Arrow and the C library of this worker hold unused: other operators run in the same workers."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def give_back_plans(spark: SparkSession) -> None:
    """Drop what the driver still holds of ended queries: their plans, broadcast tables and generated classes.

    Frames that Python no longer uses keep their plans in the JVM until Python collects them and the gateway,
    which looks once a second, passes that on; the JVM returns memory only with a full collection, which it
    puts off until its heap is full.
    """
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.java.lang.System.gc()


def alone(name: str, drop: Callable[[], None] | None = None) -> None:
    """Drop what other operators have kept in this worker between tasks; drop does the same for this one, later."""
    others = [x for x in _HELD if x != name]
    for x in others:
        _HELD.pop(x)()
    if others:
        give_back()
    if drop:
        _HELD[name] = drop
