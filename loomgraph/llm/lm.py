"""Language-model scores from a log-frequency Bloom filter.

Texts become groups of about GROUP tokens, kept as numbers into the group's own list of words.

Training: a group sends the distinct words and pairs of neighbouring words of its training texts, with their
counts, to buckets by hash; the number of buckets follows the tokens, so a bucket stays small. A bucket sums the
counts and quantises them to levels (1, 2, 3, then steps of 25 %); an n-gram of level q puts its entries 1..q into
the bucket's segment of a Bloom filter. All n-grams are stored, those seen once too: a segment has the bits that
its own entries need. segments() writes the filter as a table, which is the model.

Scoring: a group sends the hashes of its n-grams, without counts, to the written segments: probing entry 1, 2, 3,
... until one is missing gives a level, never too low and seldom too high. The group has the answers back, in its
own order, and sums them per text. The filter grows with the n-grams, and no machine holds all of it. base_score
is about exact counts of words, so a bucket's words are kept beside its segment; the model's score doesn't use them.
The model is a Dirichlet-smoothed bigram over an add-one unigram, all counts from the filter:
p(w|h) = (c(h,w) + MU*p(w)) / (c(h) + MU), p(w) = (c(w)+1) / (N+V+1).

Defined results: a null or empty text is one end token; words that training has not seen count as 0; a
null doc_id is never held out; rows with equal doc_id are all scored; without training rows N and V are
0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .runtime import forget, small_batches, written
from .tokens import chunks, keys, mix, words

MU = 1000.0
#: Tokens of a group of texts, and of a bucket.
GROUP, BUCKET = 2_000_000, 2_000_000
PROBES, FILL, STEP = 4, 0.3, 1.25
END = np.uint64(0x0123456789ABCDEF)
WORD, PAIR = 1, 2
_PAIR = keys(1 << 23, 2)
_LEVEL = keys(1 << 24, 256)


def level(counts: np.ndarray) -> np.ndarray:
    """1, 2, 3 as they are; above, steps of 25 %."""
    counts = np.asarray(counts, dtype=np.int64)
    return np.where(counts <= 3, counts, 3 + np.floor(np.log(np.maximum(counts, 3) / 3) / math.log(STEP) + 1e-9)).astype(np.int64)


#: The count that a level stands for.
COUNT = np.array([0.0, 1.0, 2.0, 3.3, *(3 * STEP**q * (1 + STEP) / 2 for q in range(1, 250))])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts, each text followed by the end token; and their bounds."""
    hashes, bounds = words(data, offsets)
    n = len(bounds) - 1
    ends = bounds + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends[1:] - 1] = True
    out[is_end], out[~is_end] = END, hashes
    return out, ends


def pairs(some: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; before the first stands the end token."""
    before = np.empty_like(some)
    before[1:] = some[:-1]
    before[ends[:-1]] = END
    return mix(before * _PAIR[0] + some * _PAIR[1])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _cut(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes in the order of their buckets, and where each of the n buckets starts."""
    at = _bucket(hashes, n)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(n + 1))


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Hashes, their counts in a byte each, and in full those of 255 and more."""
    return np.array([len(hashes)], "<i8").tobytes() + hashes.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    counts = np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[8 + 9 * n :], "<i8")
    return np.frombuffer(data, np.uint64, n, 8), counts


def _zip(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, small when most of them are."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


_GROUPS = "g long, size long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, words binary, ids binary"


def groups(rows: DataFrame) -> DataFrame:
    """Rows of doc_id, held_out, text as groups: a list of words, most frequent first, and each token's number in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            nonlocal made
            kinds, of, n = np.unique(np.concatenate([x for x, _, _, _ in held]), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            ids, lists = rank[of], [[i for h in held for i in h[k]] for k in (1, 2, 3)]
            g = (TaskContext.get().partitionId() << 40) + made
            made += 1
            held.clear()
            types = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            values = [pa.array([g]), pa.array([len(ids)]), *[pa.array([x], t) for x, t in zip(lists, types, strict=True)], pa.array([kinds[order].tobytes()], pa.binary()), pa.array([_zip(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=[c.split()[0] for c in _GROUPS.split(", ")])

        held, size, made = [], 0, 0
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "text"):
                some, ends = tokens(data, offsets)
                held.append((some, batch.column("doc_id").slice(a, b - a).to_pylist(), batch.column("held_out").slice(a, b - a).to_pylist(), np.diff(ends).tolist()))
                size += len(some)
                if size >= GROUP:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.select("doc_id", "held_out", "text").mapInArrow(each, _GROUPS)


def _tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's words, its tokens' numbers, its texts' bounds, its distinct pairs and its tokens' numbers among those."""
    kinds, ids = np.frombuffer(row["words"], np.uint64), _unzip(row["ids"], row["size"])
    ends = np.append(0, np.cumsum(row["n_tokens"]))
    return kinds, ids, ends, *np.unique(pairs(kinds[ids], ends), return_inverse=True)


def _dealt(kind: int, hashes: np.ndarray, buckets: int, pack) -> pa.RecordBatch:
    """kind, bucket, data: hashes by bucket, as pack(their places) makes them."""
    order, cut = _cut(hashes, buckets)
    some = np.flatnonzero(cut[:-1] < cut[1:]).tolist()
    columns = [pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([pack(order[cut[b] : cut[b + 1]]) for b in some], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "data"])


def count_ngrams(parts: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, data: the distinct n-grams of each group's training texts, with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                kinds, ids, _, both, of = _tokens_of(row)
                train = ~np.repeat(np.array(row["held_out"], bool), row["n_tokens"])
                for kind, hashes, number in ((WORD, kinds, ids), (PAIR, both, of)):
                    counts = np.bincount(number[train], minlength=len(hashes))
                    hashes, counts = hashes[counts > 0], counts[counts > 0]
                    yield _dealt(kind, hashes, buckets, lambda some, h=hashes, c=counts: _pack(h[some], c[some]))

    return parts.mapInArrow(each, "kind int, bucket int, data binary")


def questions(parts: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, g, data: the hashes of each group's distinct n-grams."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                kinds, _, _, both, _ = _tokens_of(row)
                for kind, hashes in ((WORD, kinds), (PAIR, both)):
                    out = _dealt(kind, hashes, buckets, lambda some, h=hashes: h[some].tobytes())
                    yield out.append_column("g", pa.array([row["g"]] * len(out), pa.int64()))

    return parts.mapInArrow(each, "kind int, bucket int, data binary, g long")


def _bucket_sums(data: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's packed n-grams: the distinct ones in order, and their counts."""
    packs = [_unpack(bytes(x)) for x in data]
    hashes, of = np.unique(np.concatenate([h for h, _ in packs]), return_inverse=True)
    # Sums of whole numbers below 2**53 are exact.
    return hashes, np.bincount(of, weights=np.concatenate([c for _, c in packs]), minlength=len(hashes)).astype(np.int64)


class Filter:
    """A Bloom filter in segments, one for each bucket, of n-grams of one kind."""

    def __init__(self, buckets: int, bits: int):
        self.buckets, self.bits = buckets, max(64, -(-bits // buckets + 7) // 8 * 8)
        self.data = np.zeros(0, np.uint8)

    @classmethod
    def read(cls, bits: int, data: bytes) -> Filter:
        """One segment."""
        made = cls(1, 0)
        made.bits, made.data = bits, np.frombuffer(data, np.uint8)
        return made

    @staticmethod
    def _at(hashes: np.ndarray, q: int, probe: int, bits: int) -> np.ndarray:
        a = mix(hashes + _LEVEL[q])
        return ((a + np.uint64(probe) * (mix(a) | np.uint64(1))) % np.uint64(bits)).astype(np.int64)

    def segment(self, hashes: np.ndarray, levels: np.ndarray) -> bytes:
        """The bits of one bucket's n-grams."""
        bits = np.zeros(self.bits, bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            hashes, levels = hashes[levels >= q], levels[levels >= q]
            for probe in range(PROBES):
                bits[self._at(hashes, q, probe, self.bits)] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing 1, 2, 3, ... until an entry is missing."""
        found = np.zeros(len(hashes), np.int64)
        base = _bucket(hashes, self.buckets) * self.bits
        alive = np.arange(len(hashes))
        for q in range(1, 256):
            for probe in range(PROBES):
                at = base[alive] + self._at(hashes[alive], q, probe, self.bits)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            if not len(alive):
                break
            found[alive] = q
        return found


def build_filter(hashes: np.ndarray, counts: np.ndarray) -> Filter:
    """A segment that holds all n-grams with a count, in as many bits as they need."""
    seen = counts > 0
    levels = level(counts[seen])
    made = Filter(1, int(levels.sum() * PROBES / -math.log(1 - FILL)) + 1024)
    made.data = np.frombuffer(made.segment(hashes[seen], levels), np.uint8)
    return made


def log_probabilities(own: np.ndarray, end: float, both: np.ndarray, ends: np.ndarray, n_tokens: int, n_distinct: int) -> np.ndarray:
    """log10 p(token | token before it) of each token, by the counts of tokens, of the end token, and of pairs."""
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[ends[:-1]] = end
    plain = (own + 1) / (n_tokens + n_distinct + 1)
    return np.log10((np.minimum(both, before) + MU * plain) / (before + MU))


class Model:
    """The whole filter in one place."""

    def __init__(self, n_tokens: int, n_distinct: int, filters: dict[int, dict[int, Filter]], buckets: int):
        self.n_tokens, self.n_distinct, self.filters, self.buckets = n_tokens, n_distinct, filters, buckets

    def counts(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        some, at = np.unique(hashes, return_inverse=True)
        found = np.zeros(len(some), np.int64)
        order, cut = _cut(some, self.buckets)
        for bucket, segment in self.filters[kind].items():
            mine = order[cut[bucket] : cut[bucket + 1]]
            found[mine] = segment.levels(some[mine])
        return COUNT[found][at]

    def log_probabilities(self, some: np.ndarray, ends: np.ndarray) -> np.ndarray:
        end = float(self.counts(WORD, np.array([END]))[0])
        return log_probabilities(self.counts(WORD, some), end, self.counts(PAIR, pairs(some, ends)), ends, self.n_tokens, self.n_distinct)


def _n_buckets(parts: DataFrame) -> int:
    return max(16, math.ceil((parts.agg(F.sum("size")).first()[0] or 0) / BUCKET))


def segments(parts: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, n_tokens, n_distinct, n_bits, bits, words: the filter, written; words are a bucket's words with their exact counts."""

    def segment(group: pd.DataFrame) -> pd.DataFrame:
        kind = int(group["kind"].iloc[0])
        hashes, counts = _bucket_sums(group["data"])
        made = build_filter(hashes, counts)
        exact = _pack(hashes, counts) if kind == WORD else b""
        return pd.DataFrame([{"kind": kind, "bucket": int(group["bucket"].iloc[0]), "n_tokens": int(counts.sum()), "n_distinct": len(hashes), "n_bits": made.bits, "bits": made.data.tobytes(), "words": exact}])

    schema = "kind int, bucket int, n_tokens long, n_distinct long, n_bits long, bits binary, words binary"
    return written(count_ngrams(parts, buckets).groupBy("kind", "bucket").applyInPandas(segment, schema), "lm-filter")


def _sizes(filter_: DataFrame) -> tuple[int, int]:
    """The tokens of the training texts, and the distinct ones."""
    return tuple(x or 0 for x in filter_.filter(F.col("kind") == WORD).agg(F.sum("n_tokens"), F.sum("n_distinct")).first())


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model of all texts of docs on the driver, for tables whose model fits there (score needs no such model); and its segments."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    parts = written(groups(rows), "lm-groups")
    buckets = _n_buckets(parts)
    made = segments(parts, buckets)
    filters = {WORD: {}, PAIR: {}}
    for row in made.collect():
        filters[row["kind"]][row["bucket"]] = Filter.read(row["n_bits"], bytes(row["bits"]))
    model = Model(*_sizes(made), filters, buckets)
    forget(docs.sparkSession, parts)
    return model, made


def answers(asked: DataFrame, filter_: DataFrame) -> DataFrame:
    """kind, bucket, g, levels, counts (of words): what each written segment answers to each group's questions."""

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        packs = [np.frombuffer(bytes(x), np.uint64) for x in left["data"]]
        cut = np.append(0, np.cumsum([len(x) for x in packs])).astype(int)
        some, of = np.unique(np.concatenate(packs), return_inverse=True) if packs else (np.zeros(0, np.uint64), np.zeros(0, int))
        levels, counts = np.zeros(len(some), np.uint8), np.zeros(len(some), np.int64)
        if len(right):
            levels = Filter.read(int(right["n_bits"].iloc[0]), bytes(right["bits"].iloc[0])).levels(some).astype(np.uint8)
            if exact := bytes(right["words"].iloc[0]):
                known, n = _unpack(exact)
                at = np.minimum(np.searchsorted(known, some), len(known) - 1)
                counts = np.where(known[at] == some, n[at], 0)
        out = left[["kind", "bucket", "g"]].copy()
        out["levels"] = [levels[of[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        out["counts"] = [counts[of[a:b]].tobytes() if kind == WORD else b"" for kind, a, b in zip(left["kind"], cut[:-1], cut[1:], strict=True)]
        return out

    few = filter_.select("kind", "bucket", "n_bits", "bits", "words")
    return asked.groupBy("kind", "bucket").cogroup(few.groupBy("kind", "bucket")).applyInPandas(answer, "kind int, bucket int, g long, levels binary, counts binary")


def score(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """op3's rows: learned from the documents outside the fold, scored for all."""
    spark = small_batches(docs).sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    parts = written(groups(rows), "lm-groups")
    buckets = _n_buckets(parts)
    model = segments(parts, buckets)
    n_tokens, n_distinct = _sizes(model)
    told = written(answers(questions(parts, buckets), model), "lm-answers")
    floor = math.log10(n_tokens + n_distinct + 1)

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        def back(kind: int, column: str, dtype: type, hashes: np.ndarray) -> np.ndarray:
            """The buckets' answers in the order of hashes."""
            mine = sorted((b, x) for k, b, x in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column(column).to_pylist(), strict=True) if k == kind)
            out = np.empty(len(hashes), dtype)
            out[_cut(hashes, buckets)[0]] = np.frombuffer(b"".join(x for _, x in mine), dtype)
            return out

        row = left.to_pylist()[0]
        kinds, ids, ends, both, of = _tokens_of(row)
        n = back(WORD, "counts", np.int64, kinds)
        about = COUNT[back(WORD, "levels", np.uint8, kinds)]
        end = float(about[kinds == END][0])
        logs = log_probabilities(about[ids], end, COUNT[back(PAIR, "levels", np.uint8, both)][of], ends, n_tokens, n_distinct)
        total = lambda x: np.add.reduceat(x, ends[:-1])
        values = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"]), pa.array(np.diff(ends)), pa.array(total((n > 0).astype(np.int64)[ids])), pa.array(np.full(len(ends) - 1, n_tokens)), pa.array(total(np.log10(n + 1.0)[ids]) - floor * np.diff(ends)), pa.array(total(logs))]
        return pa.table(values, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    told_few = told.select("g", "kind", "bucket", "levels", "counts")
    out = parts.groupBy("g").cogroup(told_few.groupBy("g")).applyInArrow(each, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    done = written(out, "lm-scores")
    forget(spark, parts, model, told)
    return done
