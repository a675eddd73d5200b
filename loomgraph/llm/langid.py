"""Language identification by word-first backoff.

fit() counts words and character n-grams of 1 to 4 letters per language over a bounded sample of
labelled documents. predict() scores every word of a whole text: a word known to the model counts by
its smoothed log frequency in each language; an unseen word falls back to the longest of its character
n-grams that are known (4, then 3, 2, 1 letters), each position for itself.

The sample: at most MAX_ROWS labelled rows and MAX_CHARS bytes of their texts, in expectation, chosen by a
hash of doc_id and text (all rows, if there are no more). All words and n-grams of the sample are in the model, so
its size is bounded by the sample's, at every size of the input, and it can be broadcast. Prediction
covers all rows and whole texts.

A word is a run of letters and marks with a letter among them, each folded to its simple lower case; words
and n-grams are known by 64-bit hashes of their code points. A language's frequencies are kept only for
the units that it has; every other unit counts as half an occurrence there, so the model and the plans
that make it don't grow with the product of units and languages.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled row
every text is `und`; ties go to the language that sorts first; rows with equal doc_id are all kept;
an empty table gives an empty result; other columns are carried along and never looked at, whatever
their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import alone, forget, give_back, small_batches, unused, written
from .tokens import chunks, keys, mix

MAX_ROWS, MAX_CHARS, LONGEST = 20_000, 96 << 20, 4
UNKNOWN = "und"
_PLACE, _OPEN, _CLOSE = keys(1 << 26, 1 << 12), 0x110000, 0x110001
_CHARACTER = keys(1 << 27, 1)[0]


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, whether it belongs to words, and its lower case."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, every), bool, len(every))
    part = letter | np.fromiter((unicodedata.category(c)[0] == "M" for c in every), bool, len(every))
    lower = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        if len(c := every[i].lower()) == 1:
            lower[i] = ord(c)
    return letter, part, lower


def _hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points; runs may overlap."""
    n = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(n) - np.repeat(first, lengths)
    value = mix((codes[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)) * _CHARACTER)
    value *= _PLACE[place % len(_PLACE)]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)) if len(lengths) else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, starts, lengths, text of each word) of UTF-8 texts laid end to end."""
    letter, part, lower = _characters()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    # Where each text starts, in code points.
    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    inside = np.append(part[codes], False)
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    bounds = heads[:-1][heads[:-1] < len(codes)]
    begins[bounds] = inside[bounds]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return codes, starts, starts, starts
    # A word ends where its run does, or where the next word begins.
    stops = np.flatnonzero(np.append(~inside[:-1], True))
    ends = np.minimum(stops[np.searchsorted(stops, starts)], np.append(starts[1:], len(codes)))
    real = np.add.reduceat(letter[codes].astype(np.int64), np.stack([starts, ends], 1).ravel()[: None if ends[-1] < len(codes) else -1])[::2] > 0
    starts, ends = starts[real], ends[real]
    return lower[codes], starts, ends - starts, np.searchsorted(heads, starts, "right") - 1


def grams(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, place) of all n-grams of a size; words have a mark at either end, and no other n-gram."""
    padded = lengths + 2
    first = np.cumsum(padded) - padded
    flat = np.empty(int(padded.sum()), np.uint32)
    flat[first], flat[first + padded - 1] = _OPEN, _CLOSE
    inner = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    flat[np.repeat(first + 1 - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = codes[inner]
    n = np.maximum(padded - size + 1, 0)
    word = np.repeat(np.arange(len(lengths)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = first[word] + place
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        value += mix((flat[at + k].astype(np.uint64) + np.uint64(1)) * _CHARACTER) * _PLACE[k]
    return mix(value + np.uint64(size)), word, place


class Units:
    """Hashes of words or n-grams, each with the languages that have it and its weight there above an absent one."""

    def __init__(self, hashes: np.ndarray, languages: np.ndarray, weights: np.ndarray, absent: np.ndarray):
        order = np.lexsort((languages, hashes))
        hashes, self.language, self.weight, self.absent = hashes[order], languages[order].astype(np.int32), weights[order].astype(np.float32), absent
        self.hash, first = np.unique(hashes, return_index=True)
        self.first = np.append(first, len(hashes)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash among the known ones, -1 if it isn't."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def add(self, total: np.ndarray, text: np.ndarray, unit: np.ndarray, scale: np.ndarray) -> None:
        """Add the weights of units, times scale, to the totals of their texts."""
        rows, languages = total.shape
        total += np.bincount(text, weights=scale, minlength=rows)[:, None] * self.absent
        n = self.first[unit + 1] - self.first[unit]
        at = np.arange(int(n.sum())) + np.repeat(self.first[unit] - np.cumsum(n) + n, n)
        total += np.bincount(np.repeat(text, n) * languages + self.language[at], weights=self.weight[at] * np.repeat(scale, n), minlength=rows * languages).reshape(rows, languages)


class Model:
    """Log frequencies by language, of words and of n-grams."""

    def __init__(self, languages: list[str], words: Units, grams: Units, prior: np.ndarray):
        self.languages, self.words, self.grams, self.prior = languages, words, grams, prior

    def back_off(self, total: np.ndarray, text: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Add the log likelihood of unseen words: at each place of a word, its longest known n-gram."""
        taken = np.zeros(int((lengths + 2).sum()), bool)
        first = np.cumsum(lengths + 2) - lengths - 2
        found = []
        for size in range(LONGEST, 0, -1):
            hashes, word, place = grams(codes, starts, lengths, size)
            unit = self.grams.find(hashes)
            at = first[word] + place
            new = (unit >= 0) & ~taken[at]
            taken[at[new]] = True
            found.append((word[new], unit[new]))
        word, unit = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        n = np.bincount(word, minlength=len(lengths))
        self.grams.add(total, text[word], unit, 1 / np.sqrt(n[word]))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and chance of each text."""
        n = len(offsets) - 1
        if not self.languages or not len(data):
            return [UNKNOWN] * n, np.zeros(n)
        codes, starts, lengths, text = words(data, offsets)
        total = np.zeros((n, len(self.languages))) + self.prior
        unit = self.words.find(_hashes(codes, starts, lengths))
        known = unit >= 0
        self.words.add(total, text[known], unit[known], np.ones(int(known.sum())))
        if not known.all():
            self.back_off(total, text[~known], codes, starts[~known], lengths[~known])
        has = np.bincount(text, minlength=n) > 0
        best = total.argmax(axis=1)
        chance = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, chance, 0.0)


def _sums(unit: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (unit, of) with the sums of n, and a place of each."""
    order = np.lexsort((of, unit))
    unit, of, n = unit[order], of[order], n[order]
    first = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (of[1:] != of[:-1]))[: len(unit)])
    return unit[first], of[first], np.add.reduceat(n, first) if len(first) else n, order[first]


def _units(counts: DataFrame, kind: int, languages: list[str], smooth: float) -> Units:
    """Of (kind, unit, lang, n): log frequencies by language, counts smoothed by half an occurrence or so."""
    rows = counts.filter(F.col("kind") == kind).select("unit", "lang", "n").toArrow()
    number = {x: i for i, x in enumerate(languages)}
    n = rows.column("n").to_numpy().astype(float)
    lang = pa.compute.index_in(rows.column("lang").combine_chunks(), pa.array(list(number), pa.string())).to_numpy().astype(np.int64)
    hashes = rows.column("unit").to_numpy().view(np.uint64)
    every = len(np.unique(hashes))
    size = np.bincount(lang, weights=n, minlength=len(languages)) + smooth * max(1, every)
    return Units(hashes, lang, np.log((n + smooth) / smooth), np.log(smooth / size))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """A model learned from text and lang of rows that have both."""
    labelled = small_batches(docs).filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    n, size, languages = sum(r["n"] for r in share.values()), sum(r["size"] for r in share.values()), sorted(share)
    part = min(1.0, max_rows / max(1, n), max_chars / max(1, size))
    if part < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), "key", "text"), F.lit(1 << 30)) < int(part * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "text", 2 << 20):
                names, lang = np.unique(batch.column("lang").slice(a, b - a).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                codes, starts, lengths, at = words(data, offsets)
                unit, of, n, first = _sums(_hashes(codes, starts, lengths), lang[at], np.ones(len(starts), np.int64))
                # The n-grams of each distinct word, as often as the word stands there.
                starts, lengths = starts[first], lengths[first]
                short = [(h, of[word], n[word]) for h, word, _ in (grams(codes, starts, lengths, k) for k in range(1, LONGEST + 1))]
                for kind, (some, where, times) in enumerate([(unit, of, n), _sums(*(np.concatenate(x) for x in zip(*short, strict=True)))[:3]]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.view(np.int64)), pa.array(names[where].tolist(), pa.string()), pa.array(times)], names=["kind", "unit", "lang", "n"])
        give_back()

    counts = written(labelled.select("text", "lang").mapInArrow(count, "kind int, unit long, lang string, n long").groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n")), "langid-units")
    prior = np.log(np.array([(share[x]["n"] + 1) / (n + len(languages)) for x in languages])) if languages else np.zeros(0)
    model = Model(languages, _units(counts, 0, languages, 0.5), _units(counts, 1, languages, 2.0), prior)
    forget(docs.sparkSession, counts)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score (the chance of pred against the other languages), in place of any of these names."""
    names = [c for c in docs.columns if c not in (pred, score) or c == text]
    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    own = unused(names, "pred", "score")
    schema = T.StructType([*plain.schema.fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType())])
    most = max(1, (4 << 20) // max(1, len(model.languages)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        model = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, most):
                batch = whole.slice(k, most)
                found, chance = [], [np.zeros(0)]
                for _, _, data, offsets in chunks(batch, text, 2 << 20):
                    some, sure = model.scores(data, offsets)
                    found += some
                    chance.append(sure)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(np.concatenate(chance))], names=schema.names)
        give_back()

    return plain.mapInArrow(each, schema).withColumnsRenamed(dict(zip(own, (pred, score), strict=True)))


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """op9's rows: learned from two thirds of the documents, predicted for all."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a chance of at least `least`; their columns as they were."""
    model = fit(docs)
    pred, score = unused(docs.columns, "pred", "score")
    scored = predict(docs, model, pred=pred, score=score)
    return scored.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
