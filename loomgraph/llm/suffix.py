"""Removal of long strings that stand in two places or more.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or in
another; strings never cross texts, and are judged on the input.

The corpus's suffixes are shared out by anchors (see anchors.py): runs of neighbouring windows with one
anchor, cut out of their texts, go to one group wherever they stand, so equal strings of LENGTH bytes
always meet, and a group is of a bounded number of bytes. Runs of equal bytes (told by 64-bit hashes of
their anchor and of all their bytes) enter once, with their number. In a group, each shard of the
documents has its own Burrows-Wheeler transform of its runs; the transforms are merged by refining
their interleave (see transforms.py), and the strings that share LENGTH bytes are the repeated ones.
Anchors with more than CROWD different runs, more than a group should hold, have their windows counted by
a distributed sum of their hashes instead; so nothing is left out, whatever the sizes of groups of copies.

Defined results: a null text is empty; a text shorter than LENGTH bytes is kept whole; overlapping
occurrences count; equal rows are occurrences of each other (also with equal doc_id); a null doc_id is
an id of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import PIECE, Hashes, runs
from .runtime import forget, maybe_in, small_batches, unused, written
from .tokens import chunks
from .transforms import Shards

LENGTH, CROWD, GROUP_BYTES, SHARDS = 200, 2000, 1 << 20, 2
_NO_ID = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null) and id, th: what tells rows apart in joins."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("th", F.xxhash64("text"))


def window_runs(rows: DataFrame, length: int) -> DataFrame:
    """id, th, first, count, key, span: the runs of windows with one anchor of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            for a, b, data, offsets in chunks(batch, "text", PIECE):
                pieces = [(0, data, offsets)]
                if len(data) > 2 * PIECE:  # one long text: in pieces that share length - 1 bytes
                    pieces = [(at, piece, np.array([0, len(piece)])) for at in range(0, len(data), PIECE) for piece in [data[at : at + PIECE + length - 1]]]
                for at, piece, bounds in pieces:
                    text, first, count, key, span = runs(piece, bounds, length)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a:b][text], hashes[a:b][text], (first + at).astype(np.int32), count.astype(np.int16), key.view(np.int64), span.view(np.int64))], names=["id", "th", "first", "count", "key", "span"])

    return rows.select("id", "th", "text").mapInArrow(each, "id long, th long, first int, count short, key long, span long")


def _cut(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (id, th, first, count, key, span, n) with the shard of its text and the bytes under each run's windows."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("first", "count", "key", "span", "n")).alias("runs"))
    texts = maybe_in(rows.select("id", "th", "text"), lists, "id", "th").join(lists, ["id", "th"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                batch = whole.slice(k, 200)
                out = []
                for shard, text, some in zip(batch.column("shard").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                    out += [(r["key"], r["span"], r["n"], shard, text[r["first"] : r["first"] + r["count"] - 1 + length]) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["key", "span", "n", "shard", "data"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    # Rows with equal id and text are one text here: their runs are in lists once.
    texts = texts.select(F.pmod(F.xxhash64("id", "th"), F.lit(SHARDS)).cast("int").alias("shard"), "text", "runs")
    return texts.mapInArrow(each, "key long, span long, n long, shard int, data binary")


def _windows(data: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the string, place) of all windows of some strings."""
    sizes = np.array([len(x) for x in data])
    ends = np.cumsum(sizes)
    count = sizes - length + 1
    which = np.repeat(np.arange(len(data)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = place + (ends - sizes)[which]
    return Hashes(np.frombuffer(b"".join(data), np.uint8)).of(start, start + length), which, place


def _spread(which: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in ascending order as (which, start, end) of the stretches they cover together."""
    if not len(which):
        return which, place, place
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (place[1:] > place[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1
    return which[first], place[first], place[last] + length


def _merge(slices: DataFrame, groups: int, length: int) -> DataFrame:
    """key, span, start, end: the repeated stretches of the slices, by merging transforms in groups of whole keys."""

    def each(group: pd.DataFrame) -> pd.DataFrame:
        often = group["n"].to_numpy() > 1
        which, place = Shards(list(map(bytes, group["data"])), group["shard"].to_numpy(), length).repeated()
        which, start, end = _spread(which[~often[which]], place[~often[which]], length)
        # A run that stands in several places is repeated as a whole.
        size = group["data"].map(len).to_numpy()
        all_of = np.flatnonzero(often)
        which, start, end = np.concatenate([which, all_of]), np.concatenate([start, 0 * all_of]), np.concatenate([end, size[all_of]])
        return pd.DataFrame({"key": group["key"].to_numpy()[which], "span": group["span"].to_numpy()[which], "start": start, "end": end})

    number = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("number")
    return slices.groupBy(number).applyInPandas(each, "key long, span long, start long, end long")


def _count(slices: DataFrame, length: int) -> DataFrame:
    """The same for slices of crowded keys: every window a row, counted by its hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                hashes, which, place = _windows(batch.column("data").to_pylist(), length)
                take = lambda name, w=which, b=batch: b.column(name).take(pa.array(w))
                yield pa.RecordBatch.from_arrays([take("key"), take("span"), take("n"), pa.array(place), pa.array(hashes.view(np.int64))], names=["key", "span", "n", "start", "hash"])

    rows = slices.mapInArrow(each, "key long, span long, n long, start long, hash long")
    # Written, so that the join's sides can both be dealt anew where a hash has many rows.
    often = written(rows.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash"), "often")
    return rows.join(often, "hash", "left_semi").select("key", "span", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, th, starts, ends: of each text with repeated strings, byte stretches to remove (unordered, may overlap)."""
    spark = small_batches(docs).sparkSession
    rows = _keyed(docs)
    every = written(window_runs(rows, length), "runs")
    often = written(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    some = written(maybe_in(every, often, "key"), "some")
    forget(spark, every, often)
    kinds = written(some.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "first", "count")).alias("at")), "kinds")
    about = kinds.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1").drop("total")
    wanted = written(kinds.join(about, "key").select("key", "span", "n", "kinds", "at.*"), "wanted")
    size = wanted.agg(F.sum(F.col("count") + length - 1), F.max("kinds")).first()
    if not size[0]:
        return spark.createDataFrame([], "id long, th long, starts array<long>, ends array<long>")
    slices, crowded = _cut(rows, wanted.drop("kinds"), length), size[1] > CROWD
    if crowded:
        slices = written(slices, "slices")
        crowd = wanted.filter(F.col("kinds") > CROWD).select("key").distinct()
        told = _merge(slices.join(crowd, "key", "left_anti"), max(1, math.ceil(size[0] / GROUP_BYTES)), length).unionByName(_count(slices.join(crowd, "key", "left_semi"), length))
    else:
        told = _merge(slices, max(1, math.ceil(size[0] / GROUP_BYTES)), length)
    told = written(told, "told")
    found = some.join(told, ["key", "span"]).groupBy("id", "th").agg(F.collect_list(F.col("first") + F.col("start")).alias("starts"), F.collect_list(F.col("first") + F.col("end")).alias("ends"))
    out = written(found, "spans")
    forget(spark, some, kinds, wanted, told, *([slices] if crowded else []))
    return out


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The stretches as maximal runs, in order."""
    found: list[list[int]] = []
    for a, b in sorted(set(zip(starts, ends, strict=True))):
        if found and a <= found[-1][1]:
            found[-1][1] = max(b, found[-1][1])
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, left = 0, []
    for a, b in spans:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]])


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """op7's rows: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    spans = repeated_spans(docs, length)
    rows = maybe_in(_keyed(docs), spans, "id", "th", flag="maybe")
    clean = rows.filter(~F.col("maybe")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, data, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "data", "starts", "ends")), strict=True):
                spans = _merged(starts or [], ends or [])
                out.append((i, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    hit = rows.filter("maybe").join(spans, ["id", "th"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"), "starts", "ends")
    return hit.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(clean.withColumn("doc_id", F.col("doc_id").cast("long")))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated stretches cut out of text, in whole characters, and n_chars made to fit.

    A character goes if all its bytes go. Documents that lose all their text are dropped.
    """
    # Columns of this function's own get names that docs doesn't have.
    own = dict(zip(("id", "th", "starts", "ends", "maybe", "hit"), unused(docs.columns, "id", "th", "starts", "ends", "maybe", "hit"), strict=True))
    spans = repeated_spans(docs, length).withColumnsRenamed(own)
    rows = docs.withColumn(own["id"], F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(own["th"], F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = maybe_in(rows, spans, own["id"], own["th"], flag=own["maybe"])
    names = docs.columns
    clean = rows.filter(~F.col(own["maybe"])).select(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(own["hit"], T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", own["starts"], own["ends"])), strict=True):
                if starts:
                    data = text.encode()
                    inner = lambda at, step, d=data: next(i for i in range(at, at + 5 * step, step) if i >= len(d) or d[i] & 0xC0 != 0x80)
                    text = _kept(data, [(a, b) for a, b in ((inner(a, 1), inner(b, -1)) for a, b in _merged(starts, ends)) if a < b]).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(s) for s in batch.column(own["starts"]).to_pylist()])], names=schema.names)

    cut = rows.filter(own["maybe"]).join(spans, [own["id"], own["th"]], "left").select(*names, own["starts"], own["ends"]).mapInArrow(each, schema)
    cut = cut.filter(~(F.col(own["hit"]) & (F.length(F.trim("text")) == 0)))
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.when(F.col(own["hit"]), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(cut.select(*names))
