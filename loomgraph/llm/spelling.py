"""Spelling variants: pairs of words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary's acceptor is cut by initial state: the state that a word's first half leads to. Words that
differ by one edit either share the half in front of it, or, read from the other end, the half behind it,
so both halves of a word give a key; an edit belongs to the window of places where the words' common prefix
ends, and to no other. Each partition holds the minimised acceptors of what is left of its words, of length l
and of length l + 1, composes acceptor, transducer and acceptor as far as states are reached, drops what
leads nowhere, and enumerates the accepted pairs. A partition of more than MOST words is cut again, its
window halved; a window of one place holds no more words than there are pairs of letters.

Defined results: a null text has no words; a null doc_id is written `null` where it is hashed; an empty
table gives no words; repeated rows are occurrences; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST, OFTEN, FACTOR, MOST = 6, 5, 5, 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- words ----


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """id, run: the lower-cased runs of letters of at least so many code points, one row for each occurrence."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0)))
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), found.alias("run")).filter(F.length("run") >= least)


def misspelt(doc_id: Column, run: Column, every: int = 199) -> Column:
    """run, with one code point deleted where `every` divides the crc32 of `<doc_id>:<run>`."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n of words (word) of so many code points (three at least) and occurrences; written."""
    if least < 3:
        raise ValueError("words of one or two code points have no half to be told by")
    return written(words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often), "vocabulary")


# ---- acceptors and their composition ----


class Acceptors:
    """Minimised acyclic acceptors that share their states: a state is its arcs, one number for equal ones."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]  # state 0: the end
        self._known: dict[tuple, int] = {}

    def add(self, words: list[str]) -> int | None:
        """The initial state of the acceptor of sorted distinct words of one length; None without words."""
        if not words:
            return None
        # Level by level from the ends: the words of one prefix lie side by side.
        level = [(w, 0) for w in words]
        for depth in range(len(words[0]) - 1, -1, -1):
            above, arcs, prefix = [], {}, None
            for w, state in level:
                if w[:depth] != prefix:
                    if arcs:
                        above.append((prefix, self._state(arcs)))
                    arcs, prefix = {}, w[:depth]
                arcs[w[depth]] = state
            above.append((prefix, self._state(arcs)))
            level = above
        return level[0][1]

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self._known[key]


def one_edit(acceptors: Acceptors, left: int, edited: bool, right: int, inserts: bool, last: bool) -> Iterator[tuple[str, str, tuple[int, bool, int]]]:
    """The arcs (input, output, target) of acceptor, transducer and acceptor composed, out of one of its states.

    The transducer copies until its one edit, and after it: a substitution by a later letter, or an insertion.
    Of the places in a run of equal letters that an insertion may have, it takes the last; with last False
    it doesn't insert behind the word's end.
    """
    mine, other = acceptors.arcs[left], acceptors.arcs[right]
    for a, p in mine.items():
        if a in other:
            yield a, a, (p, edited, other[a])
    if edited:
        return
    if inserts:
        for b, q in other.items():
            if mine or last:
                yield "", b, (left, True, q)
    else:
        for a, p in mine.items():
            for b, q in other.items():
                if a < b:
                    yield a, b, (p, True, q)


def composed(acceptors: Acceptors, left: int, right: int, inserts: bool, last: bool) -> list[tuple[str, str]]:
    """The pairs that the composition from these initial states accepts."""
    start = (left, False, right)
    out: dict[tuple[int, bool, int], list] = {}
    order, todo = [], [start]
    seen = {start}
    while todo:
        state = todo.pop()
        order.append(state)
        out[state] = list(one_edit(acceptors, *state, inserts, last))
        for _, _, target in out[state]:
            if target not in seen:
                seen.add(target)
                todo.append(target)
    # From the end: a state is alive if it is final, or an arc leads to one that is.
    back = defaultdict(list)
    for state in order:
        for _, _, target in out[state]:
            back[target].append(state)
    alive, todo = set(), [s for s in order if s == (0, True, 0)]
    while todo:
        state = todo.pop()
        if state not in alive:
            alive.add(state)
            todo += back[state]
    found, stack = [], [(start, "", "", "")] if start in alive else []
    while stack:
        state, a, b, put = stack.pop()
        if state == (0, True, 0):
            found.append((a, b))
            continue
        for x, y, target in out[state]:
            # Directly behind an inserted letter the same one can't follow: that place wasn't the run's last.
            if target in alive and not (put and x == put):
                stack.append((target, a + x, b + y, y if not x else ""))
    return found


def pairs_of(short: list[str], long: list[str], last: bool) -> Iterator[tuple[str, str]]:
    """The pairs one edit apart of sorted words: two of short (of one length), or one of short and one of long (one longer)."""
    acceptors = Acceptors()
    p, q = acceptors.add(short), acceptors.add(long)
    if p is not None:
        yield from composed(acceptors, p, p, False, last)
        if q is not None:
            yield from composed(acceptors, p, q, True, last)


# ---- partitions ----


def _windows(rows: DataFrame) -> DataFrame:
    """rows (word, n, l, a, b) with their window, from place a to place l - b of the shorter word, cut in two."""
    m = F.floor((F.col("l") - F.col("a") - F.col("b") + F.when(F.col("b") == 0, 1).otherwise(0)) / 2).cast("int")
    front = F.struct((F.col("a") + m).alias("a"), F.col("b").alias("b"))
    back = F.struct(F.col("a").alias("a"), (F.col("l") - F.col("a") - m).alias("b"))
    cut = rows.select("word", "n", "l", F.explode(F.array(front, back)).alias("w"))
    return cut.select("word", "n", "l", F.col("w.a").alias("a"), F.col("w.b").alias("b"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the partition: what stands around the window."""
    outside = F.concat(F.left("word", F.col("a")), F.lit(" "), F.when(F.col("b") > 0, F.right("word", F.col("b"))).otherwise(""))
    return rows.withColumn("key", F.concat_ws(" ", "l", "a", "b", outside))


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """l, a, b, words: the words of lengths l and l + 1 that are alike outside a window, two or more and at most `most` of them."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("l"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    done = None
    while rows is not None:
        cut = _keyed(_windows(rows))
        sizes = written(cut.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        wide = (F.col("size") > most) & (F.col("l") - F.col("a") - F.col("b") > 1)
        met = cut.join(sizes, "key")
        some = met.filter(~wide).groupBy("key", "l", "a", "b").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("words")).drop("key")
        done = some if done is None else done.unionByName(some)
        rows = written(met.filter(wide).select("word", "n", "l", "a", "b"), "wide") if sizes.filter(F.col("size") > most).head(1) else None
        if rows is not None and not rows.head(1):
            rows = None
    return done


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, other, other_n: both orders of every pair of words (word, n) one edit apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], []]
            for i in range(len(batch)):
                size, a, b = (batch.column(c)[i].as_py() for c in ("l", "a", "b"))
                rows = batch.column("words").slice(i, 1).flatten()
                texts = rows.field("word").to_pylist()
                number = dict(zip(texts, rows.field("n").to_pylist(), strict=True))
                front, back = texts[0][:a], texts[0][len(texts[0]) - b :]
                middle = [sorted(w[a : len(w) - b] for w in texts if len(w) == some) for some in (size, size + 1)]
                for u, v in pairs_of(*middle, last=b == 0):
                    u, v = front + u + back, front + v + back
                    for column, x in zip(found, (u, number[u], v, number[v]), strict=True):
                        column.append(x)
            u, nu, v, nv = found
            columns = [pa.array(u + v, pa.string()), pa.array(nu + nv, pa.int64()), pa.array(v + u, pa.string()), pa.array(nv + nu, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other", "other_n"])

    return partitions(words, most).select("l", "a", "b", "words").mapInArrow(each, "word string, n long, other string, other_n long")


# ---- forms and roots ----


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form, ...) with root: the last of the forms that follow from a word; its own word without one.

    A form is FACTOR times as frequent as its word, so chains are short; each round doubles the steps taken.
    """
    longest = math.log(max(2, forms.agg(F.max("n")).first()[0] or 2), FACTOR) + 1
    links = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(math.ceil(math.log2(longest + 1))):
        links = written(links, "links")
        links = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("word", F.col("next").alias("root"))
    return forms.join(links, "word")


def variants(words: DataFrame, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n)."""
    near = near_pairs(words, most)
    first = Window.partitionBy("word").orderBy(F.desc("other_n"), "other")
    told = near.withColumn("pick", F.row_number().over(first) == 1)
    one = lambda c: F.max(F.when(F.col("pick"), F.col(c)))
    told = told.groupBy("word").agg(F.count("*").alias("n_near"), one("other").alias("form"), one("other_n").alias("form_n"))
    rows = words.join(told, "word", "left")
    fits = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    return roots(written(rows, "forms"))


def spelling(docs: DataFrame) -> DataFrame:
    """op12's rows: the variants of the vocabulary of documents, planted misspellings included."""
    found = runs(docs)
    return variants(vocabulary(found.select(misspelt(F.col("id"), F.col("run")).alias("word"))))
