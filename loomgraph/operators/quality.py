"""Chunk quality: issues, score, level, suggestion, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of, normalize_breaks, uni_trim


def content_density(content: Column) -> Column:
    """The share of non-blank lines that say something."""
    rows = F.filter(F.transform(F.split(content, "\n", -1), uni_trim), lambda x: x != "")

    def useful(x: Column) -> Column:
        empty = x.rlike(r"(?U)^\d+\z") | x.rlike(r"(?U)^[\W_]+\z") | x.rlike(r"(?U)\.{3,}\s*\d+\z")
        return ~(empty | ((F.length(x) <= 8) & any_of(x, fixed.GENERIC_HEADINGS)))

    return F.when(F.size(rows) > 0, F.size(F.filter(rows, useful)) / F.size(rows)).otherwise(0.0)


def with_quality(chunks: DataFrame) -> DataFrame:
    """chunks (title, content, ...) with score, level, issues, suggestion, quality_chars, content_density.

    A null title is the text "None", as it is for callers that turn it into text first.
    """
    content = normalize_breaks(F.coalesce("content", F.lit("")))
    rows = chunks.withColumn("_text", content).withColumn("_title", uni_trim(F.coalesce("title", F.lit("None")))).withColumn("quality_chars", F.length("_text"))
    text, n = F.col("_text"), F.col("quality_chars")
    rows = rows.withColumn("_density", content_density(text))
    has = n > 0
    end = F.right(text, F.lit(80))
    flags = {
        "missing_content": ~has,
        "missing_title": F.col("_title") == "",
        "too_short": has & (n < fixed.MIN_CHARS),
        "too_long": has & (n > fixed.MAX_CHARS),
        "slightly_long": has & (n > fixed.IDEAL_CHARS) & (n <= fixed.MAX_CHARS),
        "possible_incomplete_start": has & any_of(F.left(text, F.lit(80)), fixed.INCOMPLETE_STARTS),
        "possible_incomplete_end": has & any_of(end, fixed.INCOMPLETE_ENDS),
        "end_without_clear_punctuation": has & ~any_of(end, [fixed.CLEAR_ENDS]),
        "low_content_density": has & (F.col("_density") < fixed.MIN_DENSITY),
    }
    rows = rows.withColumns({"issues": F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()])), "content_density": F.when(has, F.round("_density", 3)).otherwise(0.0)})
    holds = lambda name: F.array_contains("issues", name)
    lost = sum((F.when(holds(name), points).otherwise(0) for name, points in fixed.PENALTIES.items()), F.lit(0))
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))
    level = F.lit("bad")
    for least, name in reversed(fixed.LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    rows = rows.withColumn("level", level)
    suggestion = (
        F.when(holds("missing_content"), "discard")
        .when(holds("too_long"), "split_again")
        .when(holds("too_short"), "review_or_merge")
        .when(holds("possible_incomplete_start"), "review_or_merge_with_previous")
        .when(holds("possible_incomplete_end"), "review_or_merge_with_next")
        .when(holds("low_content_density"), "review_or_discard")
        .when(F.col("level").isin("excellent", "good"), "keep")
        .otherwise("review")
    )
    # A filter on these columns must not be pushed below them: it would hold each column's whole expression for
    # every mention of it, thousands of patterns a row. Nothing is pushed through a generator's own columns.
    found = ["quality_chars", "issues", "content_density", "score", "level", "suggestion"]
    return rows.withColumn("suggestion", suggestion).select(*(F.col(c) for c in chunks.columns if c not in found), F.inline(F.array(F.struct(*found))))


def problems(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("level").isin("warning", "bad"))


def quality_report(checked: DataFrame, *by: str) -> DataFrame:
    """Totals of a set of chunks (or of each group)."""
    return checked.groupBy(*by).agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("level").isin("warning", "bad")).alias("problem_chunks"),
        F.round(F.count_if(F.col("level").isin("warning", "bad")) / F.count("*"), 4).alias("problem_ratio"),
        F.round(F.avg("score"), 2).alias("average_score"),
    )


def quality_counts(checked: DataFrame, *by: str) -> DataFrame:
    """Counts of levels, issues and suggestions as (kind, name, n)."""
    named = F.concat(F.array(F.struct(F.lit("level").alias("kind"), F.col("level").alias("name")), F.struct(F.lit("suggestion").alias("kind"), F.col("suggestion").alias("name"))), F.transform("issues", lambda x: F.struct(F.lit("issue").alias("kind"), x.alias("name"))))
    return checked.select(*by, F.inline(named)).groupBy(*by, "kind", "name").agg(F.count("*").alias("n"))


def skip_reason(content: Column, level: Column, suggestion: Column) -> Column:
    """Why a chunk is left out of extraction; null if it isn't."""
    text = normalize_breaks(F.coalesce(content, F.lit("")))
    return F.when(text == "", "chunk 内容为空，跳过抽取").when(suggestion == "discard", "chunk 质量建议为 discard，跳过抽取").when((level == "bad") & (F.length(text) < fixed.MIN_CHARS), "chunk 内容过短且质量为 bad，跳过抽取")
