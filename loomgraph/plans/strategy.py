"""Split strategies as providers reply with them: read, completed with defaults, and carried out document by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.json import json_candidate
from ..operators import chunking
from ..sources.tables import written

PATTERNS = ["primary", "secondary", "chapter", "section", "question"]
_PATTERNS = ", ".join(f"{p}_start_patterns array<string>" for p in PATTERNS) + ", parent_context_patterns array<string>"
_SPLIT = f"executable_split_config struct<split_mode string, {_PATTERNS}, end_boundary_rule string, keep_parent_context boolean, fallback struct<enabled boolean, method string, max_chars int, overlap int>>"
_RAG = f"executable_rag_split_config struct<split_mode string, {_PATTERNS}, semantic_window struct<target_chars int, max_chars int, min_chars int, overlap_chars int>, context_injection struct<prepend_title_chain_to_embedding_text boolean, title_chain_separator string>, fallback struct<max_chars int, overlap_chars int>>"
#: Fixed value: the fallback of strategies that name none.
GENERIC_THEN_FIXED = "generic_heading_then_fixed_length"


def _or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def _lists(config: Column) -> list[Column]:
    none = F.array().cast("array<string>")
    return [F.coalesce(config[c], none).alias(c) for c in [*(f"{p}_start_patterns" for p in PATTERNS), "parent_context_patterns"]]


def repaired(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, split_mode, lists of patterns, and the fallback: replies (key, reply) with all that is missing made up.

    A reply that isn't JSON or has no configuration stands for windows of fixed length.
    """
    got = F.from_json(json_candidate(F.col("reply")), _SPLIT)["executable_split_config"]
    rows = replies.select(key, got.alias("c"))
    c = F.col("c")
    rule = F.when(c.isNull(), "document_end").otherwise(_or(c["end_boundary_rule"], "next_same_level_start"))
    return rows.select(key, _or(c["split_mode"], "fixed_length").alias("split_mode"), *_lists(c), rule.alias("end_boundary_rule"), F.when(c.isNull(), False).otherwise(_or(c["keep_parent_context"], True)).alias("keep_parent_context"), _or(c["fallback"]["enabled"], True).alias("fallback_enabled"), _or(c["fallback"]["method"], GENERIC_THEN_FIXED).alias("fallback_method"), _or(c["fallback"]["max_chars"], fixed.CHUNK_CHARS).alias("max_chars"), _or(c["fallback"]["overlap"], fixed.CHUNK_OVERLAP).alias("overlap"))


def rag_repaired(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for retrieval: the mode resolved to the finest splitter that has patterns, and the window's sizes besides."""
    got = F.from_json(json_candidate(F.col("reply")), _RAG)["executable_rag_split_config"]
    c = F.col("c")
    some = lambda p: F.coalesce(F.size(c[f"{p}_start_patterns"]) > 0, F.lit(False))
    asked = _or(c["split_mode"], "structure_then_window")
    finest = F.when(some("chapter") & some("question"), "chapter_section_question").when(some("secondary"), "two_level_regex").when(some("primary"), "heading_regex").otherwise("fixed_length")
    window, over = _or(c["semantic_window"]["max_chars"], fixed.WINDOW_CHARS), _or(c["semantic_window"]["overlap_chars"], fixed.WINDOW_OVERLAP)
    # A fallback without sizes has the window's; zero counts as none.
    size = lambda name, other: F.coalesce(F.nullif(c["fallback"][name], F.lit(0)), F.nullif(other, F.lit(0)))
    return replies.select(key, got.alias("c")).select(
        key, F.when(asked == "structure_then_window", finest).otherwise(asked).alias("split_mode"), *_lists(c), F.lit(True).alias("fallback_enabled"), F.lit(GENERIC_THEN_FIXED).alias("fallback_method"),
        _or(size("max_chars", window), fixed.WINDOW_CHARS).alias("max_chars"), _or(size("overlap_chars", over), fixed.WINDOW_OVERLAP).alias("overlap"), window.alias("window_chars"), over.alias("window_overlap"),
        _or(c["context_injection"]["prepend_title_chain_to_embedding_text"], True).alias("chain"), _or(c["context_injection"]["title_chain_separator"], " > ").alias("separator"),
    )


def split(docs: DataFrame, strategies: DataFrame, last: tuple[str, str] = ("max_chars", "overlap")) -> DataFrame:
    """Chunks of docs (doc_id, text), each by its own strategy; documents left without any go on to their fallback.

    last: the columns with the sizes of the windows that the fallback ends in.
    """
    rows = docs.select("doc_id", "text").join(strategies, "doc_id")
    mode = F.col("split_mode")
    found = chunking.by_headings(rows.filter(mode == "heading_regex"), F.col("primary_start_patterns"), parents=F.col("parent_context_patterns"))
    found = found.unionByName(chunking.two_level(rows.filter(mode == "two_level_regex"), F.col("primary_start_patterns"), F.col("secondary_start_patterns")))
    found = found.unionByName(chunking.by_questions(rows.filter(mode.isin("chapter_section_question", "three_level_regex")), *[F.col(f"{p}_start_patterns") for p in ("chapter", "section", "question")]))
    found = found.unionByName(chunking.fixed_length(rows.filter(mode == "fixed_length"), F.col("max_chars"), F.col("overlap")))
    # Read three times below.
    found = written(found, "chunks")
    left = rows.filter("fallback_enabled").join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    generic = chunking.generic_headings(left.filter(F.col("fallback_method") == GENERIC_THEN_FIXED))
    generic = written(generic, "generic-chunks")
    rest = left.filter(F.col("fallback_method").isin(GENERIC_THEN_FIXED, "fixed_length")).join(generic.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(generic).unionByName(chunking.fixed_length(rest, *map(F.col, last)))


def rag_units(docs: DataFrame, strategies: DataFrame) -> DataFrame:
    """The structural units that retrieval windows are cut from."""
    return split(docs, strategies, ("window_chars", "window_overlap"))
