"""Line-level cleaning, as tables of lines: (doc, page, pos, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import any_of, meaningful_chars, normalize_characters, uni_trim
from ..sources.tables import written


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_blank: bool = False) -> DataFrame:
    """key, pos (from 0), line (trimmed) of each text."""
    rows = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", uni_trim(F.col("line")))
    return rows if keep_blank else rows.filter("line <> ''")


def joined(rows: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """The lines of each key in order as one text."""
    by = [key] if isinstance(key, str) else key
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("all")).select(*by, F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))


def is_page_furniture(line: Column) -> Column:
    """Page numbers and publisher's lines."""
    keyword = any_of(line, fixed.USELESS_KEYWORDS, flags="")
    return any_of(line, fixed.PAGE_NUMBER_LINES, whole=True) | keyword


def is_noise(line: Column) -> Column:
    """Rules of dashes or dots, and long lines of capitals."""
    return any_of(line, fixed.NOISE_LINES, whole=True) | (any_of(line, [fixed.CAPITALS_LINE], whole=True) & (F.length(line) > fixed.CAPITALS_LONGER_THAN))


def is_toc_line(line: Column, dotted: bool = False) -> Column:
    """A line of a table of contents; dotted: also short lines of many dots."""
    dots = F.translate(line, "…·", "..")
    # What few lines hold is asked first.
    found = any_of(dots, [fixed.TOC_TITLE], whole=True) | (any_of(dots, [fixed.TOC_LEADER]) & any_of(dots, [fixed.TOC_PAGE_AT_END]))
    if dotted:
        found = found | ((F.length(dots) <= fixed.TOC_DOTTED_LENGTH) & (F.length(dots) - F.length(F.replace(dots, F.lit("."))) >= fixed.TOC_DOTS))
    return (line != "") & found


def page_filter(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_page_furniture(F.col("line")))


def noise_filter(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_noise(F.col("line")))


def without_toc(rows: DataFrame, key: str = "doc_id", dotted: bool = True) -> DataFrame:
    """Lines outside tables of contents.

    A title line opens a block; up to TOC_BLOCK entries an ordinary line closes it, after that only a
    chapter line does. A line's state is told by three things before it: the last title line, the entries since
    then, and whether a line that closes came since then. Each is a running sum or maximum, so a document's lines
    are dealt out by ranges and a long document is several tasks; what ranges owe each other is a row for each
    range and document. pos tells the order and is distinct in a document. Lines are written once with what they
    match: they are read by each of these steps, and rows may be costly to make.
    """
    line = F.col("line")
    marked = rows.withColumns({"title": any_of(line, [fixed.TOC_TITLE], whole=True), "entry": is_toc_line(line, dotted), "chapter": any_of(line, [fixed.CHAPTER_START])})
    marked = written(marked, "marked-lines")
    # Only documents with a title line have blocks; the others need no order, and no shuffle while those are few.
    titled = written(marked.filter("title").select(key).distinct(), "titled")
    plain = marked.join(titled, key, "left_anti").filter("not entry").select(*rows.columns)

    ranged = written(marked.join(titled, key, "left_semi").repartitionByRange(key, "pos").withColumn("_range", F.spark_partition_id()), "toc-lines")
    part = ["_range", key]
    here = Window.partitionBy(*part).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last_title = F.max(F.when(F.col("title"), F.struct("pos", "_entries")))
    counted = ranged.withColumn("_entries", F.count_if(F.col("entry") & ~F.col("title")).over(here))
    sums = counted.groupBy(*part).agg(F.max("_entries").alias("_n"), last_title.alias("_last"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    whole = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["pos"].alias("pos"), (F.col(c)["_entries"] + F.col("_before")).alias("entries")))
    starts = sums.select(*part, "_before", F.max(whole("_last")).over(earlier).alias("_head_before"))
    state = counted.withColumn("_last", last_title.over(here)).join(starts, part).withColumn("_head", F.coalesce(whole("_last"), F.col("_head_before")))
    few = F.col("_entries") + F.col("_before") - F.col("_head")["entries"] < fixed.TOC_BLOCK
    state = state.withColumn("_closes", F.when(~F.col("title") & ~F.col("entry") & F.col("_head").isNotNull() & (F.col("chapter") | few), F.col("pos")))
    closed = state.groupBy(*part).agg(F.max("_closes").alias("_last_closed"))
    closed = closed.select(*part, F.max("_last_closed").over(earlier).alias("_closed_before"))
    state = state.withColumn("_closed", F.max("_closes").over(here)).join(closed, part)
    outside = F.col("_head").isNull() | F.coalesce(F.greatest("_closed", "_closed_before") > F.col("_head")["pos"], F.lit(False))
    return plain.unionByName(state.filter(~F.col("title") & ~F.col("entry") & outside).select(*rows.columns))


def repeated_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, pages) of short lines on at least max(3, a quarter) of the pages."""
    pages = rows.groupBy(key).agg(F.count_distinct("page").alias("all_pages"))
    short = rows.filter(F.length("line") <= fixed.REPEATED_LENGTH).groupBy(key, "line").agg(F.count_distinct("page").alias("pages"))
    least = F.greatest(F.lit(float(fixed.REPEATED_PAGES)), F.col("all_pages") * fixed.REPEATED_SHARE)
    return short.filter(F.col("pages") >= fixed.REPEATED_PAGES).join(pages, key).filter(F.col("pages") >= least).select(key, "line", "pages")


def without_repeated(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(repeated_lines(rows, key), [key, "line"], "left_anti")


def is_standalone(line: Column) -> Column:
    return any_of(line, fixed.STANDALONE_STARTS)


def merged_lines(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Wrapped lines joined: key, pos (from 0), line, n_lines.

    A line starts a new one if it is the first, stands alone, follows one that does, or follows the end
    of a sentence; a running sum of starts numbers the groups.
    """
    order = Window.partitionBy(key).orderBy("pos")
    before = F.lag("line").over(order)
    ended = before.rlike(f"[{fixed.SENTENCE_ENDS}]\\z")
    starts = before.isNull() | is_standalone(F.col("line")) | is_standalone(before) | ended
    grouped = rows.withColumn("start", starts.cast("int")).withColumn("g", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = grouped.groupBy(key, "g").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("all"))
    return parts.select(key, (F.col("g") - 1).cast("int").alias("pos"), F.array_join(F.transform("all", lambda x: x["line"]), "").alias("line"), F.size("all").alias("n_lines"))


def cleaned_for_chunking(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text: unix line ends, plain dashes, at most one blank line, trimmed lines, no table of contents."""
    body = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "－—–", "---")
    folded = docs.select(key, F.regexp_replace(body, "\n{3,}", "\n\n").alias("text"))
    each = F.transform(F.split("text", "\n", -1), uni_trim)
    titled = F.exists(each, lambda x: any_of(x, [fixed.TOC_TITLE], whole=True))
    # A document without a title line loses single lines only: it stays a row.
    plain = folded.filter(~titled).select(key, uni_trim(F.array_join(F.filter(each, lambda x: ~is_toc_line(x, dotted=True)), "\n")).alias("text"))
    some = written(folded.filter(titled), "titled-documents")
    out = joined(without_toc(lines(some, key, keep_blank=True), key), key).withColumn("text", uni_trim(F.col("text")))
    return plain.unionByName(some.select(key).join(out, key, "left").withColumn("text", F.coalesce("text", F.lit(""))))


def page_text(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text, ocr_text): the text to use, how it was got, and its meaningful characters.

    OCR counts for pages below 20 meaningful characters, and only if it has more of them.
    """
    own, other = meaningful_chars(F.col("text")), meaningful_chars(F.col("ocr_text"))
    use = (own < fixed.OCR_BELOW) & (other > own)
    text = F.when(use, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit("")))
    return pages.select("doc_id", "page", normalize_characters(text).alias("text"), F.when(use, "ocr").otherwise("text").alias("method"), F.greatest(own, F.when(use, other).otherwise(own)).alias("meaningful_chars"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) to one clean text per document: furniture, repeated lines, contents, wraps, noise."""
    rows = pages.select("doc_id", "page", normalize_characters(F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.select("doc_id", "page", F.posexplode(F.split("text", "\r\n?|\n", -1)).alias("at", "line")).withColumn("line", uni_trim(F.col("line"))).filter("line <> ''")
    # Read three times by the next step. Page and place in it tell the order, so lines need no numbers.
    rows = without_repeated(written(page_filter(rows), "page-lines"))
    rows = rows.select("doc_id", "page", F.struct("page", "at").alias("pos"), "line")
    rows = merged_lines(without_toc(rows, dotted=False))
    return joined(noise_filter(rows.select("doc_id", "pos", "line")))


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the texts of edits (doc_id, text); blank edits are refused (kept apart by accepted)."""
    new = edits.select("doc_id", uni_trim(F.col("text")).alias("new"))
    both = docs.join(new, "doc_id", "left")
    accepted = F.coalesce(F.col("new") != "", F.lit(False))
    text = F.when(accepted, F.col("new")).otherwise(F.col("text"))
    return both.select("doc_id", text.alias("text"), F.length(text).alias("text_length"), accepted.alias("text_manually_edited"))


def compact(text: Column, most: int = fixed.CONTEXT_CHARS, marker: str = "\n…") -> Column:
    """Lines with white space folded, blank ones dropped, cut at `most` characters with a marker."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n?|\n", -1), lambda x: uni_trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    whole = F.array_join(F.filter(each, lambda x: x != ""), "\n")
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit(marker))).otherwise(whole)
