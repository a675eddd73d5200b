"""Reports over the stages of graphs: a row a graph, and long tables of counts and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import plain
from .graph import final_counts, graph_report

SKIPPED_CHUNKS, SKIPPED_EDGES = 20, 50


def _counts(rows: DataFrame, **aggregates) -> DataFrame:
    return rows.groupBy("graph_id").agg(*[c.alias(name) for name, c in aggregates.items()])


def _together(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "graph_id", "full"), tables).fillna(0)


def histograms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, kind (entity_type, relation_type), name, n, place: most frequent first, ties by first appearance."""
    both = nodes.select("graph_id", "ord", F.lit("entity_type").alias("kind"), F.coalesce("type", F.lit(fixed.OTHER_TYPE)).alias("name")).unionByName(edges.select("graph_id", "ord", F.lit("relation_type").alias("kind"), F.coalesce("relation", F.lit(fixed.VAGUE_RELATION)).alias("name")))
    counts = both.groupBy("graph_id", "kind", "name").agg(F.count("*").alias("n"), F.min("ord").alias("_first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("graph_id", "kind").orderBy(F.desc("n"), "_first"))).drop("_first")


def extraction_report(chunks: DataFrame, parts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, chunk_count, skipped_chunks, processed_parts, warning_count, node_count, edge_count.

    chunks: graph_id, reason (null, or why it was skipped); parts: graph_id, warnings (an array).
    """
    told = _counts(chunks, chunk_count=F.count("*"), skipped_chunks=F.count("reason"))
    asked = _counts(parts, processed_parts=F.count("*"), warning_count=F.sum(F.coalesce(F.size("warnings"), F.lit(0))))
    return _together(told, asked, _counts(nodes, node_count=F.count("*")), _counts(edges, edge_count=F.count("*")))


def skipped_preview(rows: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """The first `most` rows with a reason of each graph."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(order))
    return rows.filter("reason is not null").withColumn("place", place).filter(F.col("place") <= most)


def relation_clean_report(before: DataFrame, after: DataFrame, renames: DataFrame) -> DataFrame:
    """graph_id, edge_count, removed_edge_count, renamed_relation_count; renames: graph_id, old_relation, new_relation."""
    rows = _together(_counts(before, _before=F.count("*")), _counts(after, edge_count=F.count("*")), _counts(renames, renamed_relation_count=F.count_if(F.col("old_relation") != F.col("new_relation"))))
    return rows.select("graph_id", "edge_count", (F.col("_before") - F.col("edge_count")).alias("removed_edge_count"), "renamed_relation_count")


def stage_counts(stages: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """graph_id, stage, node_count, edge_count of each stage's nodes and edges: counted anew, never carried on."""
    each = [_together(_counts(nodes, node_count=F.count("*")), _counts(edges, edge_count=F.count("*"))).withColumn("stage", F.lit(name)) for name, (nodes, edges) in stages.items()]
    return reduce(DataFrame.unionByName, each)


def cleaning_summary(values: DataFrame, groups: DataFrame, relation_groups: DataFrame, relations: DataFrame) -> DataFrame:
    """A row a graph of what the cleaning stages did.

    values: what distinct_values() tells; groups: accepted merges (node_ids); relation_groups: accepted
    groups of relations; relations: relation_clean_report().
    """
    exact = _counts(values, removed_duplicate_values=F.sum("removed"), deduped_key_count=F.count_if(F.col("removed") > 0))
    merges = _counts(groups, merge_group_count=F.count("*"), merged_node_count=F.sum(F.size("node_ids") - 1))
    names = _counts(relation_groups, relation_group_count=F.count("*"))
    return _together(exact, merges, names, relations.select("graph_id", "renamed_relation_count", "removed_edge_count"))


def final_report(nodes: DataFrame, edges: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """graph_id, node_count, edge_count, skipped_edge_count of the final graph, with score and level of the report on it if there is one."""
    ids = nodes.select("graph_id", plain(F.col("id")).alias("id")).filter("id <> ''").distinct()
    rows = _together(_counts(ids, node_count=F.count("*")), final_counts(edges, nodes))
    report = graph_report(nodes, edges) if source is None else source
    return rows.join(report.select("graph_id", "score", "level"), "graph_id", "left")
