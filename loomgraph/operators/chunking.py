"""Chunks: (doc, chunk_id, split_type, title, parent_title, start_char, end_char, char_count, content)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.batches import small_batches
from ..functions.text import slug, uni_trim
from .structure import boundaries, last_before, spans

COLUMNS = ["doc_id", "chunk_id", "split_type", "title", "parent_title", "chapter_title", "section_title", "start_char", "end_char", "char_count", "content"]


@dataclass(frozen=True)
class SplitConfig:
    """How to split; the fields that no splitter reads are carried for callers that keep them."""

    split_mode: str = "heading_regex"
    primary_patterns: list[str] = field(default_factory=list)
    secondary_patterns: list[str] = field(default_factory=list)
    chapter_patterns: list[str] = field(default_factory=list)
    section_patterns: list[str] = field(default_factory=list)
    question_patterns: list[str] = field(default_factory=list)
    parent_context_patterns: list[str] = field(default_factory=list)
    fallback_enabled: bool = True
    fallback_method: str = "generic_heading"
    max_chars: int = fixed.CHUNK_CHARS
    overlap: int = fixed.CHUNK_OVERLAP
    end_boundary_rule: str = ""
    keep_parent_context: bool = True
    metadata_fields: list[str] = field(default_factory=list)


def _chunks(rows: DataFrame, split_type: str | Column, chunk_id: Column) -> DataFrame:
    """rows (doc_id, title, start, stop, raw, and titles above) as chunks; blank ones are dropped."""
    have = set(rows.columns)
    above = {c: F.col(c) if c in have else F.lit(None).cast("string") for c in ("parent_title", "chapter_title", "section_title")}
    kind = split_type if isinstance(split_type, Column) else F.lit(split_type)
    out = rows.withColumn("content", uni_trim(F.col("raw"))).filter("content <> ''").withColumns(above)
    return out.withColumns({"chunk_id": chunk_id, "split_type": kind, "start_char": F.col("start"), "end_char": F.col("stop"), "char_count": F.length("content")}).select(*COLUMNS)


Patterns = list[str] | Column


def _any(patterns: Patterns | None) -> bool:
    return isinstance(patterns, Column) or bool(patterns)


def _pieces(docs: DataFrame, patterns: Patterns, parents: Patterns | None = None) -> DataFrame:
    """doc_id, i, title, start, stop, raw (and parent_title): the text from each boundary to the next."""
    found = small_batches(docs).select("doc_id", "text", boundaries(F.col("text"), patterns).alias("bounds"))
    rows = spans(found).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("stop", F.coalesce("stop", F.length("text"))).withColumn("raw", F.expr("substr(text, start + 1, stop - start)")).drop("text")
    if _any(parents):
        above = spans(docs.select("doc_id", boundaries(F.col("text"), parents).alias("bounds"))).select("doc_id", "title", "start", F.lit("parent").alias("kind"))
        both = rows.withColumn("kind", F.lit("own")).unionByName(above, allowMissingColumns=True)
        rows = both.withColumn("parent_title", last_before("parent", "title")).filter("kind = 'own'").drop("kind")
    return rows


def fixed_length(docs: DataFrame, max_chars: int | Column = fixed.CHUNK_CHARS, overlap: int | Column = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Sliding windows of max_chars; the overlap is held below max_chars."""
    size = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    over = F.greatest(F.lit(0), F.least(overlap if isinstance(overlap, Column) else F.lit(overlap), size - 1))
    n = F.length("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), size.alias("size"), (size - over).alias("step"))
    last = F.greatest(F.lit(0), F.ceil((n - F.col("size")) / F.col("step"))).cast("int")
    rows = rows.select("doc_id", "text", "size", "step", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("k"))
    rows = rows.select("doc_id", (F.col("k") + 1).alias("i"), (F.col("k") * F.col("step")).alias("start"), F.least("n", F.col("k") * F.col("step") + F.col("size")).alias("stop"), F.expr("substr(text, k * step + 1, size)").alias("raw"))
    rows = rows.withColumn("title", F.format_string("fixed_chunk_%04d", "i"))
    return _chunks(rows, "fixed_length", F.format_string("fixed_%04d", "i"))


def by_headings(docs: DataFrame, patterns: Patterns, kind: str = "heading_regex", parents: Patterns | None = None) -> DataFrame:
    """From each heading to the next; text before the first is left out."""
    rows = _pieces(docs, patterns, parents)
    return _chunks(rows, kind, F.concat(F.format_string(f"{kind}_%04d_", "i"), slug(F.col("title"))))


def generic_headings(docs: DataFrame) -> DataFrame:
    return by_headings(docs, fixed.GENERIC_HEADINGS, "generic_heading")


def two_level(docs: DataFrame, primary: Patterns, secondary: Patterns) -> DataFrame:
    """Primary headings, cut again by secondary ones inside their trimmed text; those without stay whole."""
    outer = _pieces(docs, primary).withColumn("content", uni_trim(F.col("raw"))).filter("content <> ''")
    if not _any(secondary):
        return _chunks(outer.drop("content"), "two_level_regex", F.concat(F.format_string("two_level_%04d_", "i"), slug(F.col("title"))))
    if isinstance(secondary, Column):
        outer = outer.join(docs.select("doc_id", secondary.alias("_secondary")), "doc_id")
        secondary = F.col("_secondary")
    inner = outer.withColumn("bounds", boundaries(F.col("content"), secondary))
    whole = inner.filter(F.size("bounds") == 0)
    alone = _chunks(whole.drop("content"), "primary_only", F.concat(F.format_string("two_level_%04d_", "i"), slug(F.col("title"))))
    cut = inner.filter(F.size("bounds") > 0)
    rows = cut.select("doc_id", F.col("i").alias("p"), F.col("title").alias("parent_title"), F.col("start").alias("base"), "content", "bounds", F.posexplode("bounds").alias("at", "b"))
    stop = F.coalesce(F.try_element_at("bounds", F.col("at") + 2)["start"], F.length("content"))
    rows = rows.withColumn("raw", F.substr("content", F.col("b.start") + 1, stop - F.col("b.start")))
    rows = rows.select("doc_id", "p", (F.col("at") + 1).alias("i"), "parent_title", F.col("b.title").alias("title"), (F.col("base") + F.col("b.start")).alias("start"), (F.col("base") + stop).alias("stop"), "raw")
    return _chunks(rows, "two_level_regex", F.concat(F.format_string("two_level_%04d_%04d_", "p", "i"), slug(F.col("title")))).unionByName(alone)


def by_questions(docs: DataFrame, chapters: Patterns | None = None, sections: Patterns | None = None, questions: Patterns | None = None) -> DataFrame:
    """Questions under chapters and sections: each ends at the next boundary of any kind.

    Only documents with a chapter and a question; a question before the first chapter is left out but
    keeps its number; a section stays the context of later questions until the next section.
    """
    given = {"chapter": (chapters, fixed.CHAPTERS), "section": (sections, fixed.SECTIONS), "question": (questions, fixed.QUESTIONS)}
    usual = lambda p, d: F.when(F.size(p) > 0, p).otherwise(F.array(*map(F.lit, d))) if isinstance(p, Column) else p or d
    kinds = {k: usual(p, d) for k, (p, d) in given.items()}
    parts = [spans(small_batches(docs).select("doc_id", boundaries(F.col("text"), p).alias("bounds"))).select("doc_id", "i", "title", "start", F.lit(k).alias("kind")) for k, p in kinds.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    after = F.expr("min(start) over (partition by doc_id order by start range between 1 following and unbounded following)")
    rows = rows.withColumns({"stop": after, "chapter_title": last_before("chapter", "title"), "section_title": last_before("section", "title")})
    rows = rows.filter("kind = 'question' and chapter_title is not null").join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("stop", F.coalesce("stop", F.length("text"))).withColumn("raw", F.expr("substr(text, start + 1, stop - start)")).withColumn("parent_title", F.coalesce("section_title", "chapter_title"))
    return _chunks(rows, "chapter_section_question", F.concat(F.format_string("question_%04d_", "i"), slug(F.col("title"))))


def split(docs: DataFrame, config: SplitConfig) -> DataFrame:
    """Chunks by the configured mode; documents that it leaves without any go on to the fallback."""
    modes = {
        "heading_regex": lambda d: by_headings(d, config.primary_patterns, parents=config.parent_context_patterns),
        "two_level_regex": lambda d: two_level(d, config.primary_patterns, config.secondary_patterns),
        "chapter_section_question": lambda d: by_questions(d, config.chapter_patterns, config.section_patterns, config.question_patterns),
        "fixed_length": lambda d: fixed_length(d, config.max_chars, config.overlap),
    }
    modes["three_level_regex"] = modes["chapter_section_question"]
    fallbacks = {"generic_heading": [generic_headings, modes["fixed_length"]], "fixed_length": [modes["fixed_length"]]}
    steps = [modes[config.split_mode]] if config.split_mode in modes else []
    steps += fallbacks.get(config.fallback_method, []) if config.fallback_enabled else []
    found, left = None, docs
    for step in steps:
        some = step(left)
        found = some if found is None else found.unionByName(some)
        left = left.join(some.select("doc_id").distinct(), "doc_id", "left_anti")
    return found if found is not None else docs.sparkSession.createDataFrame([], ", ".join(f"{c} {'long' if c == 'doc_id' else 'int' if c.endswith(('char', 'count')) else 'string'}" for c in COLUMNS))


def split_report(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, split types, whole average, largest and smallest size, the first five ids."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("start_char", "chunk_id"))), 1, 5)
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"),
        F.array_join(F.array_sort(F.collect_set("split_type")), ",").alias("split_types"),
        F.expr("sum(char_count) div count(*)").alias("average_chars"),
        F.max("char_count").alias("max_chars"),
        F.min("char_count").alias("min_chars"),
        F.array_join(F.transform(first, lambda x: x["chunk_id"]), ",").alias("first_chunks"),
    )
