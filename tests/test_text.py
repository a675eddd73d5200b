"""Lines, structure, chunks and their quality on small hand-made cases."""

import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions.json import json_candidate
from loomgraph.functions.text import meaningful_chars, normalize_characters, normalize_name, uni_trim
from loomgraph.operators import chunking, lines, quality, rag, structure


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_characters(spark):
    assert one(spark, normalize_characters(F.col("t")), t="ＡＢ１２ｚ　ＩＳＢＮ､｡") == "AB12z ISBN，。"
    assert one(spark, normalize_name(F.col("t")), t="3.5 mm") == "5 mm"
    assert one(spark, uni_trim(F.col("t")), t="　\t a b \xa0") == "a b"
    assert one(spark, meaningful_chars(F.col("t")), t="甲a1 -。") == 3


@pytest.mark.parametrize("reply, found", [('```json\n{"a":1}\n```', '{"a":1}'), ('note {"a":1} end', '{"a":1}'), ("none", None), (None, None)])
def test_json(spark, reply, found):
    rows = spark.createDataFrame([(reply,)], "t string")
    assert rows.select(json_candidate(F.col("t")).alias("x")).first()["x"] == found


def test_toc_block(spark):
    text = "目录\n第一节 甲 ........ 1\n第二节 乙 ........ 2\n第三节 丙 ........ 3\n杂项\n第一章 X"
    rows = lines.without_toc(lines.lines(docs(spark, text))).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["第一章 X"]


def test_toc_block_closes_early(spark):
    rows = lines.without_toc(lines.lines(docs(spark, "目 录\n甲 ........ 1\n正文\n正文二"))).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["正文", "正文二"]


@pytest.mark.parametrize("pages, on, removed", [(4, 3, True), (20, 4, False)])
def test_repeated_lines(spark, pages, on, removed):
    rows = [(1, p, p * 2, f"own {p}") for p in range(pages)] + [(1, p, p * 2 + 1, "HDR") for p in range(on)]
    table = spark.createDataFrame(rows, "doc_id long, page int, pos int, line string")
    left = {r["line"] for r in lines.without_repeated(table).collect()}
    assert ("HDR" not in left) == removed and len(left) == pages + (not removed)


def test_merge(spark):
    rows = lines.merged_lines(lines.lines(docs(spark, "甲\n乙。\n丙\n第一章 丁\n戊"))).orderBy("pos").collect()
    assert [r["line"] for r in rows] == ["甲乙。", "丙", "第一章 丁", "戊"]


def test_cleaned_for_chunking(spark):
    got = {r["doc_id"]: r["text"] for r in lines.cleaned_for_chunking(docs(spark, " a—b \r\n\r\n\r\n\r\n c ", None, "")).collect()}
    assert got == {0: "a-b\n\nc", 1: "", 2: ""}


def test_boundaries_skip_bad_patterns(spark):
    got = docs(spark, "abcd").select(structure.boundaries(F.col("text"), ["(", "^ab", "^abc", ""]).alias("b")).first()["b"]
    assert [(b["start"], b["end"]) for b in got] == [(0, 2), (0, 3)]
    chunks = chunking.by_headings(docs(spark, "abcd"), ["^ab", "^abc"]).collect()
    assert [c["chunk_id"] for c in chunks] == ["heading_regex_0002_abc"]


def test_headings_drop_the_preface(spark):
    got = chunking.by_headings(docs(spark, "前言\n第一章 甲\nA\n第二章 乙\nB"), ["^第[一二]章.*$"]).orderBy("start_char").collect()
    assert [c["content"] for c in got] == ["第一章 甲\nA", "第二章 乙\nB"]


def test_two_level(spark):
    text = "前\n一、甲\n1. x\naa\n2. y\nbb\n二、乙\ncc"
    got = chunking.two_level(docs(spark, text), [r"^[一二]、.$"], [r"^\d\. .$"]).orderBy("start_char").collect()
    assert [(c["split_type"], c["parent_title"], c["title"], c["content"]) for c in got] == [("two_level_regex", "一、甲", "1. x", "1. x\naa"), ("two_level_regex", "一、甲", "2. y", "2. y\nbb"), ("primary_only", None, "二、乙", "二、乙\ncc")]
    assert all(text[c["start_char"] : c["end_char"]].strip() == c["content"] for c in got)


def test_questions(spark):
    text = "0. 早了吗？\n第一章 甲甲\n第一节 节节\n1. 问题一？\n答\n2. 问题二？\n答\n第二章 乙乙\n3. 问题三？\n答"
    got = chunking.by_questions(docs(spark, text)).orderBy("start_char").collect()
    assert [(c["title"], c["chapter_title"], c["section_title"]) for c in got] == [("1. 问题一？", "第一章 甲甲", "第一节 节节"), ("2. 问题二？", "第一章 甲甲", "第一节 节节"), ("3. 问题三？", "第二章 乙乙", "第一节 节节")]
    assert got[1]["content"] == "2. 问题二？\n答"


@pytest.mark.parametrize("n, size, overlap, spans", [(10, 4, 1, [(0, 4), (3, 7), (6, 10)]), (4, 4, 9, [(0, 4)]), (5, 4, 9, [(0, 4), (1, 5)]), (0, 4, 1, [])])
def test_fixed_length(spark, n, size, overlap, spans):
    got = chunking.fixed_length(docs(spark, "abcdefghij"[:n]), size, overlap).orderBy("start_char").collect()
    assert [(c["start_char"], c["end_char"]) for c in got] == spans


def test_fallback(spark):
    got = chunking.split(docs(spark, "no headings here", "第一章 有\n正文"), chunking.SplitConfig("heading_regex", ["^第.章.*$"])).collect()
    assert {(c["doc_id"], c["split_type"]) for c in got} == {(0, "fixed_length"), (1, "heading_regex")}
    assert chunking.split(docs(spark, "x"), chunking.SplitConfig("unknown", fallback_method="unknown")).count() == 0


def checked(spark, title, content):
    table = spark.createDataFrame([(title, content)], "title string, content string")
    return quality.with_quality(table).first()


@pytest.mark.parametrize(
    "title, content, issues, score, level, suggestion",
    [
        ("T", "字" * 78 + "。", ["too_short"], 70, "good", "review_or_merge"),
        ("T", "", ["missing_content"], 0, "bad", "discard"),
        ("T", "因此" + "字" * 98, ["possible_incomplete_start", "end_without_clear_punctuation"], 77, "good", "review_or_merge_with_previous"),
        (None, "字" * 99 + "。", [], 100, "excellent", "keep"),
        (" ", "字" * 6001 + "。", ["missing_title", "too_long"], 55, "warning", "split_again"),
        ("T", "字" * 4001 + "。", ["slightly_long"], 90, "excellent", "keep"),
        ("T", "字" * 99 + "\n1\n2\n3。", [], 100, "excellent", "keep"),
    ],
)
def test_quality(spark, title, content, issues, score, level, suggestion):
    got = checked(spark, title, content)
    assert (got["issues"], got["score"], got["level"], got["suggestion"]) == (issues, score, level, suggestion)


def test_quality_report(spark):
    table = spark.createDataFrame([("T", "字" * 99 + "。")] * 7 + [("T", "字" * 69 + "。")] * 4, "title string, content string")
    row = quality.quality_report(quality.with_quality(table)).first()
    assert (row["average_score"], row["problem_ratio"]) == (89.09, 0.0)


def test_sentences_and_windows(spark):
    assert one(spark, rag.sentences(F.col("t")), t="甲。 乙！丙;丁") == ["甲。", "乙！", "丙;", "丁"]
    text = "一二三。四五六。\n\n" + "七八九。" * 3 + "\n\n尾"
    got = one(spark, rag.windows(F.col("t"), 10, 3), t=text)
    assert all(text[w["start"] : w["end"]].strip().endswith(w["content"][-1:]) for w in got)
    assert "".join(re.sub(r"\s", "", w["content"]) for w in one(spark, rag.windows(F.col("t"), 10, 0), t=text)) == re.sub(r"\s", "", text)
    assert one(spark, rag.windows(F.col("t"), 10, 3), t="") == []


def test_parts(spark):
    got = one(spark, rag.extraction_parts(F.col("t"), 10, 2), t="aaaa\n\nbbbb\n\n" + "c" * 25)
    assert got == ["aaaa\n\nbbbb", "c" * 10, "c" * 10, "c" * 9]


def test_clamp():
    assert [rag.clamp_k(k) for k in (0, 99, None)] == [1, 20, 5]


def test_title_chain(spark):
    assert one(spark, rag.title_chain(F.lit("a"), F.lit(" "), F.lit("a"), F.lit("b"))) == "a > b"
