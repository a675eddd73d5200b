"""Documents to graphs, end to end: chunk, check, extract, repair, number, merge, report.

Tables that several later steps read are written to the shared folder: a provider is asked once, and no
step is planned on top of all steps before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chunking, graph, quality
from ..sources.tables import shared_path, written
from . import providers


def extract(docs: DataFrame, provider: providers.Provider) -> tuple[DataFrame, DataFrame]:
    """Raw nodes and edges (graph_id, part_id, ord, ...) of the chunks worth asking about."""
    return from_chunks(quality.with_quality(chunking.fixed_length(docs, fixed.PART_CHARS, fixed.PART_OVERLAP)), provider)


def from_chunks(checked: DataFrame, provider: providers.Provider) -> tuple[DataFrame, DataFrame]:
    """The same of chunks with their quality; a part whose request fails has no nodes and no edges."""
    kept = checked.filter(quality.skip_reason(F.col("content"), F.col("level"), F.col("suggestion")).isNull())
    asked = kept.select(F.col("doc_id").cast("string").alias("graph_id"), F.concat_ws("/", "doc_id", "chunk_id").alias("part_id"), "content")
    decided = providers.decide(asked, provider, "extract", "content", shared_path(checked.sparkSession, "replies"))
    nodes, edges = providers.extracted(decided, ["graph_id", "part_id"])
    # Order over a graph: by chunk, then by place in the reply.
    order = F.coalesce(F.nullif(F.regexp_extract("part_id", r"_(\d{4,})(?:_|$)", 1), F.lit("")).cast("long"), F.lit(0)) * 100_000 + F.col("ord")
    return nodes.withColumn("ord", order), edges.withColumn("ord", order)


def build(docs: DataFrame, provider: providers.Provider | None = None, types: list[str] = (), relations: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Merged nodes and deduplicated edges of each document's graph."""
    nodes, edges = extract(docs, provider or providers.Offline())
    nodes = written(graph.repaired_nodes(nodes).withColumn("source_chunk_id", F.col("part_id")), "nodes")
    edges = written(graph.repaired_edges(edges, nodes), "edges")
    nodes, edges = graph.constrained(nodes, edges, types, relations, by=["part_id"])
    nodes, edges = graph.global_ids(nodes, edges)
    nodes, edges = written(nodes, "numbered-nodes"), written(edges, "numbered-edges")
    groups = written(graph.validated_groups(graph.proposed_merges(nodes), "node_ids", "canonical_name"), "groups")
    merged = written(graph.merged_nodes(nodes, groups), "merged")
    links = written(graph.deduplicated_edges(graph.remapped_edges(edges, groups)), "links")
    return merged, links
