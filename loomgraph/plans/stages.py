"""The ten stages from pages to final graphs, registered in order.

Each stage reads the tables of those before it from the context and returns its own; graphs are a pair of
tables, {"nodes": ..., "edges": ...}. Options of the caller (allow-lists) go before an ontology's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, lines, ontology, quality, reports
from ..sources.tables import written
from . import document_graph, providers, strategy
from .workflow import Stage, Workflow

Graph = dict[str, DataFrame]


def _provider(context: dict) -> providers.Provider:
    return context.get("provider") or providers.Offline()


def pdf_to_text(context: dict) -> DataFrame:
    """doc_id, text: of pages (doc_id, page, text, ocr_text), cleaned as a whole; or of docs as they are."""
    if "docs" in context:
        return context["docs"].select("doc_id", "text")
    return lines.clean_pages(lines.page_text(context["pages"]))


def ontology_draft(context: dict) -> DataFrame:
    """graph_id, ord, name: the entity types that the provider proposes for each document."""
    asked = context["pdf_to_text"].select(F.col("doc_id").cast("string").alias("graph_id"), "text")
    told = providers.decide(asked, _provider(context), "ontology", "text")
    types = F.from_json(F.col("reply"), "entity_types array<string>")["entity_types"]
    return ontology.names(told.select("graph_id", F.posexplode(types).alias("ord", "name")).withColumn("ord", F.col("ord").cast("long")), 12)


def split_strategy(context: dict) -> DataFrame:
    return strategy.repaired(providers.decide(context["pdf_to_text"], _provider(context), "strategy", "text").select("doc_id", "reply"))


def chunking(context: dict) -> DataFrame:
    """Chunks of the cleaned texts, with their quality."""
    return quality.with_quality(strategy.split(lines.cleaned_for_chunking(context["pdf_to_text"]), context["split_strategy"]))


def graph_extraction(context: dict) -> Graph:
    """Raw nodes and edges, repaired, held to the allow-lists, with ids of the whole graph."""
    nodes, edges = document_graph.from_chunks(context["chunking"], _provider(context))
    nodes = written(graph.repaired_nodes(nodes).withColumn("source_chunk_id", F.col("part_id")), "nodes")
    edges = written(graph.repaired_edges(edges, nodes), "edges")
    types = context.get("allowed_entity_types") or []
    if not types and context.get("use_ontology"):
        known = context["ontology_draft"].select("graph_id", F.col("name").alias("type"))
        nodes = nodes.join(known, ["graph_id", "type"], "left_semi")
    nodes, edges = graph.constrained(nodes, edges, types, context.get("allowed_relation_types") or [], context.get("relations") or [], by=["part_id"])
    nodes, edges = graph.global_ids(nodes, edges)
    return {"nodes": nodes, "edges": edges}


def exact_cleaning(context: dict) -> Graph:
    some = context["graph_extraction"]
    return {kind: graph.distinct_values(some[kind])[0] for kind in ("nodes", "edges")}


def semantic_node_merge(context: dict) -> Graph:
    nodes, edges = (context["exact_cleaning"][kind] for kind in ("nodes", "edges"))
    groups = written(graph.validated_groups(graph.proposed_merges(nodes), "node_ids", "canonical_name"), "groups")
    return {"nodes": graph.merged_nodes(nodes, groups), "edges": graph.deduplicated_edges(graph.remapped_edges(edges, groups))}


def relation_cleaning(context: dict) -> Graph:
    """Without renames, as extraction from an ontology leaves nothing to rename; renames: graph_id, old_relation, new_relation."""
    some = context["semantic_node_merge"]
    return {"nodes": some["nodes"], "edges": graph.cleaned_relations(some["edges"], context.get("renames"))}


def quality_report(context: dict) -> DataFrame:
    some = context["relation_cleaning"]
    return graph.graph_report(some["nodes"], some["edges"])


def final_graph(context: dict) -> dict[str, DataFrame]:
    some = context["relation_cleaning"]
    nodes, edges = some["nodes"], some["edges"]
    skipped = reports.skipped_preview(graph.split_edges(edges, nodes), reports.SKIPPED_EDGES)
    return {"nodes": graph.final_nodes(nodes, edges), "edges": graph.final_edges(edges, nodes), "skipped": skipped, "report": reports.final_report(nodes, edges, context["quality_report"])}


_ORDER = [pdf_to_text, ontology_draft, split_strategy, chunking, graph_extraction, exact_cleaning, semantic_node_merge, relation_cleaning, quality_report, final_graph]
_NEEDS = {"ontology_draft": "pdf_to_text", "split_strategy": "pdf_to_text", "chunking": "split_strategy", "graph_extraction": "chunking", "exact_cleaning": "graph_extraction", "semantic_node_merge": "exact_cleaning", "relation_cleaning": "semantic_node_merge", "quality_report": "relation_cleaning", "final_graph": "quality_report"}


def workflow() -> Workflow:
    return Workflow([Stage(f.__name__, f, (_NEEDS[f.__name__],) if f.__name__ in _NEEDS else ()) for f in _ORDER])
