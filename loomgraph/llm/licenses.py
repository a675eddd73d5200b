"""License scans: phrases at word level, and an exact containment join with license templates.

A text's words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Phrases are found
wherever their words stand one after another, over the whole text.

The join: a template matches a run of words, whatever line ends stand in it, of at most SPREAD times the
template's own words, that holds at least `threshold` of the template's distinct words and, word for word, each
phrase that tells the template from its kin (its name and version, or how one clause follows the other: TELLING).
So a notice of one license never counts for another, however many words they share. All runs of that length are covered; labels and score follow from them. Besides, each line of a text is a block, the set
of its words, and `blocks` lists the templates met by single lines of any length. Words are ordered by
how many lines of the whole corpus hold them, rarest first. Of a template with t words and need n = ceil(threshold*t), one of the
first t-n+1 must be in every matching run or block (prefix filter), so that only words around those are
looked at; a block needs n words (length filter); a
shared word at place i of the template leaves at most the t-i-1 later ones (positional filter), so the
scan stops as soon as the need is out of reach. What passes is verified by counting. The filters only
ever drop what can't match, so the result is that of comparing every run and block with every template.

Defined results: a null text is empty; a text without words has no places, labels or score; the labels
are distinct, sorted and comma-joined ('' if none); rows with equal doc_id are all kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates by label: the bodies and usual notices of public licenses, from the files beside this module.
TEMPLATES = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: What a text must say word for word to be meant by a template, in words as words() splits them.
TELLING = {
    "apache-2.0": ["apache license version 2 0", "in compliance with the license"],
    "bsd-2-clause": ["provided with the distribution this software is provided by"],
    "bsd-3-clause": ["neither the name of", "endorse or promote products"],
    "cc-by-4.0": ["creative commons attribution 4 0"],
    "gpl-2.0-or-later": ["either version 2 of the license"],
    "gpl-3.0-or-later": ["either version 3 of the license"],
    "isc": ["permission to use copy modify and or distribute"],
    "mit": ["permission is hereby granted free of charge"],
    "mpl-2.0": ["mozilla public license v 2 0"],
    "short-apache-2.0": ["apache license version 2 0"],
    "short-gpl-3.0": ["general public license version 3"],
    "short-mit": ["the mit license"],
    "spdx-apache-2.0": ["license identifier apache 2 0"],
    "spdx-mit": ["license identifier mit"],
}
THRESHOLD = 0.8
#: The longest run that may match, as a multiple of the template's words.
SPREAD = 2

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same, with the line ends kept.
_LINES = _TABLE[:10] + b"\n" + _TABLE[11:]


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def template_words(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {label: frozenset(words(x)) for label, x in templates.items() if words(x)}


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """The batch's texts in UTF-8, null as the empty text."""
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def document_frequency(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many blocks of all documents each word of the templates stands.

    The result has a row for each distinct word of the templates, whose number is that of a parameter.
    """
    wanted = frozenset().union(*template_words(templates).values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in _texts(batch):
                for line in text.translate(_LINES).split(b"\n"):
                    found.update(wanted.intersection(line.split()))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in found], "n": list(found.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class Join:
    """The templates' side of the join, in the corpus's order of words."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float, telling: dict[str, list[str]] | None = None):
        self.threshold, self.ordered, self.prefix = threshold, {}, {}
        self.telling = {label: [words(x) for x in some] for label, some in (telling or {}).items()}
        for label, some in template_words(templates).items():
            line = sorted(some, key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(line) - 1e-9)
            self.ordered[label] = (line, need)
            for place, word in enumerate(line[: len(line) - need + 1]):
                self.prefix.setdefault(word, []).append((label, place))
        self.rare = frozenset(self.prefix)
        self.span = {label: SPREAD * len(words(templates[label])) for label in self.ordered}

    def matches(self, line_: list[bytes]) -> dict[str, float]:
        """label: containment, for each template that the block of these words meets."""
        block, joined = frozenset(line_), b" " + b" ".join(line_) + b" "
        first: dict[str, int] = {}
        for word in self.rare & block:
            for label, place in self.prefix[word]:
                first[label] = min(place, first.get(label, place))
        found = {}
        for label, place in first.items():
            line, need = self.ordered[label]
            if len(block) < need:
                continue
            have = 1
            for at in range(place + 1, len(line)):
                if have + len(line) - at < need:
                    break
                have += line[at] in block
            if have >= need and all(b" " + b" ".join(x) + b" " in joined for x in self.telling.get(label, ())):
                found[label] = have / len(line)
        return found

    def runs(self, split: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, label, containment) of the runs that templates match; of overlapping runs the fullest, then the shortest."""
        at: dict[bytes, list[int]] = {}
        for word in self.rare.intersection(split):
            for label, _ in self.prefix[word]:
                at.update((w, []) for w in self.ordered[label][0])
        for n, word in enumerate(split):
            if word in at:
                at[word].append(n)
        found = []
        for label, (line, need) in self.ordered.items():
            rare = sorted(n for word in line[: len(line) - need + 1] for n in at.get(word, ()))
            if not rare or sum(1 for word in line if at[word]) < need:
                continue
            span, hits = self.span[label], sorted((n, word) for word in line for n in at[word])
            places = [n for n, _ in hits]
            told = [[n for n in at[x[0]] if split[n : n + len(x)] == x] for x in self.telling.get(label, ())]
            ends = [len(x) for x in self.telling.get(label, ())]
            if not all(told):
                continue
            areas: list[list[int]] = []
            for n in rare:
                if areas and n - span < areas[-1][1]:
                    areas[-1][1] = n + span
                else:
                    areas.append([n - span, n + span])
            for start, end in areas:
                best, until = None, -1
                inside: Counter[bytes] = Counter()
                first = bisect_right(places, start)
                for last in range(first, bisect_left(places, end)):
                    n, word = hits[last]
                    inside[word] += 1
                    while places[first] <= n - span:
                        inside[hits[first][1]] -= 1
                        if not inside[hits[first][1]]:
                            del inside[hits[first][1]]
                        first += 1
                    if len(inside) < need or best and len(inside) < best[0] and places[first] <= until:
                        continue
                    # The last place of each telling phrase in reach; the run must begin before them all.
                    lasts = [some[k - 1] if (k := bisect_right(some, n - size + 1)) else -1 for some, size in zip(told, ends, strict=True)]
                    if lasts and min(lasts) < places[first]:
                        continue
                    # From the left, words that come again aren't needed.
                    more, head = Counter(inside), first
                    while more[hits[head][1]] > 1 and not (lasts and places[head] >= min(lasts)):
                        more[hits[head][1]] -= 1
                        head += 1
                    this = (len(inside), places[head] - n, places[head], n)
                    if best and places[head] > until:
                        found.append((best[2], best[3], label, best[0] / len(line)))
                        best = None
                    best, until = max(best or this, this, key=lambda x: x[:2]), n
                if best:
                    found.append((best[2], best[3], label, best[0] / len(line)))
        return sorted(found)


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which phrase starts; joined has a space before and after each word."""
    found, at, word, done = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", done, at)
        done = at
        found.append(word)
        at = joined.find(phrase, at + 1)
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, telling: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, runs.

    runs: the matching runs as (first word, last word, label, containment). score: the largest
    containment of a run, or 1 if a phrase was found, else 0. blocks: the lines that match by themselves,
    as (line, label, containment).
    """
    if templates is None:
        templates, telling = TEMPLATES, telling or TELLING
        if not templates:
            raise FileNotFoundError("no license texts beside the module")
    phrases = phrases or PHRASES
    join = docs.sparkSession.sparkContext.broadcast(Join(templates, document_frequency(docs, templates), threshold, telling))
    sought = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    block = pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
    run = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(block)), ("runs", pa.list_(run))])

    def row(doc_id: int, text: bytes, index: Join) -> tuple:
        lines = text.translate(_LINES)
        split = lines.split()
        joined = b" " + b" ".join(split) + b" "
        places, base = [], set()
        for phrase, label in sought:
            if phrase in joined:
                places += _places(joined, phrase)
                base.add(label)
        blocks, runs = [], []
        if not index.rare.isdisjoint(split):
            runs = [{"first": a, "last": b, "label": label, "containment": c} for a, b, label, c in index.runs(split)]
            for n, line in enumerate(lines.split(b"\n")):
                if not index.rare.isdisjoint(some := line.split()):
                    blocks += [{"line": n, "label": label, "containment": c} for label, c in sorted(index.matches(some).items())]
        labels = base | {r["label"] for r in runs}
        score = max([1.0 if base else 0.0, *(r["containment"] for r in runs)])
        return doc_id, len(split), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks, runs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = join.value
        for batch in batches:
            rows = [row(i, t, index) for i, t in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line int, label string, containment double>>, runs array<struct<first int, last int, label string, containment double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, out)
