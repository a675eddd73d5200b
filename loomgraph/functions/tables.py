"""Splitters as table functions, for callers that write SQL.

register(spark) makes them known to a session. Each takes a table with doc_id and text, and is called as

    SELECT * FROM sentence_rows(TABLE(docs) PARTITION BY (doc_id))
    SELECT * FROM window_rows(TABLE(docs) PARTITION BY (doc_id), 3000, 300)
    SELECT * FROM heading_rows(TABLE(docs) PARTITION BY (doc_id), array('^#+ .*$'))

analyze() takes doc_id's type from the table and refuses tables without these columns, and settings that make no
sense, when the query is planned. Null texts are empty. Results equal those of the operators named in each docstring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from . import fixed

_SENTENCE = re.compile(f"(?<={fixed.SENTENCE_BREAK})\\s*")


def _result(table: AnalyzeArgument, *columns: tuple[str, T.DataType]) -> AnalyzeResult:
    if not table.isTable or not {"doc_id", "text"} <= set(table.dataType.names):
        raise ValueError("the first argument must be TABLE(...) with columns doc_id and text")
    kind = table.dataType["doc_id"].dataType
    return AnalyzeResult(schema=T.StructType([T.StructField("doc_id", kind), *[T.StructField(*c) for c in columns]]))


def _whole(argument: AnalyzeArgument, least: int, name: str) -> None:
    if argument.value is None or int(argument.value) < least:
        raise ValueError(f"{name} must be a constant of {least} or more")


class SentenceRows:
    """doc_id, pos (from 0), sentence: the pieces that rag.sentences() gives."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, ("pos", T.IntegerType()), ("sentence", T.StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        pieces = (x.strip() for x in _SENTENCE.split(row["text"] or ""))
        for pos, piece in enumerate(x for x in pieces if x):
            yield row["doc_id"], pos, piece


class WindowRows:
    """doc_id, i (from 1), start_char, end_char, content: the windows of chunking.fixed_length(), blank ones included."""

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _whole(size, 1, "size")
        _whole(overlap, 0, "overlap")
        return _result(table, ("i", T.IntegerType()), ("start_char", T.IntegerType()), ("end_char", T.IntegerType()), ("content", T.StringType()))

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        text, step = row["text"] or "", size - min(overlap, size - 1)
        for i, start in enumerate(range(0, max(1, len(text) - size + step), step), 1):
            yield row["doc_id"], i, start, min(len(text), start + size), text[start : start + size]


class HeadingRows:
    """doc_id, i (from 1), title, start, stop: the boundaries and spans of structure.boundaries() and spans()."""

    @staticmethod
    def analyze(table: AnalyzeArgument, patterns: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(patterns.dataType, T.ArrayType):
            raise ValueError("patterns must be an array of strings")
        return _result(table, ("i", T.IntegerType()), ("title", T.StringType()), ("start", T.IntegerType()), ("stop", T.IntegerType()))

    def eval(self, row: Row, patterns: list[str]) -> Iterator[tuple]:
        found, text = {}, row["text"] or ""
        for pattern in patterns or []:
            try:
                matches = re.finditer(pattern, text, re.MULTILINE) if pattern else ()
            except re.error:
                continue
            for m in matches:
                title = m.group().strip()
                if title and len(title) <= fixed.TITLE_LENGTH:
                    found.setdefault(m.span(), title)
        at = sorted(found)
        for i, (start, _) in enumerate(at):
            yield row["doc_id"], i + 1, found[at[i]], start, at[i + 1][0] if i + 1 < len(at) else None


FUNCTIONS = {"sentence_rows": SentenceRows, "window_rows": WindowRows, "heading_rows": HeadingRows}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
