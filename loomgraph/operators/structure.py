"""Structure of texts: pattern boundaries, nearest enclosing titles, structure clues."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of
from .lines import lines

BOUNDARY = "array<struct<title:string,start:int,end:int>>"


@lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern, re.MULTILINE) if pattern else None
    except re.error:
        return None


def boundaries(text: Column, patterns: list[str] | Column, most_title: int = fixed.TITLE_LENGTH) -> Column:
    """Matches of any pattern in the whole text, where ^ and $ stand at line ends, by start and end.

    Patterns are Python's and may come from users, one list for all texts or a column of lists, so they run
    in an Arrow batch UDF; a pattern that doesn't compile is skipped, blank and over-long titles too, and
    equal spans count once.
    """

    def one(value: str | None, some: Iterable[str]) -> list[dict]:
        found = {}
        for p in filter(None, map(_compiled, some)):
            for m in p.finditer(value or ""):
                title = m.group().strip()
                if title and len(title) <= most_title:
                    found.setdefault((m.start(), m.end()), title)
        return [{"title": found[span], "start": span[0], "end": span[1]} for span in sorted(found)]

    @F.pandas_udf(BOUNDARY)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: one(value, patterns))

    @F.pandas_udf(BOUNDARY)
    def scan_own(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([one(value, () if some is None else some) for value, some in zip(texts, lists, strict=True)], dtype=object)

    return scan_own(text, patterns) if isinstance(patterns, Column) else scan(text)


def spans(docs: DataFrame, found: str = "bounds", key: str = "doc_id") -> DataFrame:
    """key, i (from 1), title, start, stop: each boundary with the start of the next one (null at the end)."""
    rows = docs.select(key, F.posexplode(found).alias("i", "b")).select(key, (F.col("i") + 1).alias("i"), "b.title", "b.start")
    return rows.withColumn("stop", F.lead("start").over(Window.partitionBy(key).orderBy("i")))


def last_before(kind: str, value: str, key: str = "doc_id", order: str = "start") -> Column:
    """As-of lookup over a union of boundaries: the value of the latest row of a kind at or before this one."""
    so_far = Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(F.col("kind") == kind, F.col(value)), ignorenulls=True).over(so_far)


def clue_categories(line: Column) -> Column:
    """The categories a line belongs to."""
    flags = [F.when(any_of(line, patterns), F.lit(name)) for name, patterns in fixed.CLUES.items()]
    word = any_of(line, fixed.CLUE_WORDS, flags="") & (F.length(line) <= fixed.CLUE_LENGTH)
    return F.array_compact(F.array(*flags, F.when(word, F.lit("keyword_structure_lines"))))


def structure_clues(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, category, n, preview (the first 100 lines of the category joined by line ends)."""
    rows = lines(docs, key).select(key, "pos", "line", F.explode(clue_categories(F.col("line"))).alias("category"))
    rank = F.row_number().over(Window.partitionBy(key, "category").orderBy("pos"))
    ranked = rows.withColumn("rank", rank)
    some = F.array_sort(F.collect_list(F.when(F.col("rank") <= fixed.CLUE_PREVIEW, F.struct("pos", "line"))))
    return ranked.groupBy(key, "category").agg(F.count("*").alias("n"), F.array_join(F.transform(some, lambda x: x["line"]), "\n").alias("preview"))


def text_size(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(key, F.length(text).alias("total_chars"), F.size(F.split(text, "\n", -1)).alias("total_lines"))


def preview(text: Column, most: int = fixed.PREVIEW_CHARS) -> Column:
    """The whole text, or its first, middle and last thirds of the limit under labels."""
    third = most // 3
    n = F.length(text)
    middle = F.greatest(F.lit(0), F.floor(n / 2) - third // 2).cast("int")
    parts = [("head", F.substring(text, 1, third)), ("middle", F.substr(text, middle + 1, F.lit(third))), ("tail", F.right(text, F.lit(third)))]
    labelled = F.concat_ws("\n\n", *[F.concat(F.lit(f"[{label}]\n"), part) for label, part in parts])
    return F.when(n <= most, text).otherwise(labelled)
