"""Ontologies of many graphs as tables of names and of triples, in the order in which they were given (ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ordering import keep_first, numbered
from ..functions.text import collapse_space, normalize_name, truncated

TRIPLE = ["from", "relation", "to"]


def _name(column: str):
    return truncated(collapse_space(F.coalesce(column, F.lit(""))), fixed.TYPE_TEXT)


def _capped(rows: DataFrame, most: int) -> DataFrame:
    return numbered(rows, ["graph_id"], "ord", "place").filter(F.col("place") <= most).drop("place")


def allowed_names(names: DataFrame) -> DataFrame:
    """graph_id, ord, name of an allow-list: enumerators dropped, white space folded, blanks and repeats left out."""
    return keep_first(names.select("graph_id", "ord", normalize_name(F.coalesce("name", F.lit(""))).alias("name")).filter("name <> ''"), ["graph_id", "name"])


def allowed_triples(triples: DataFrame) -> DataFrame:
    """graph_id, ord, from, relation, to of an allow-list: as names; triples with a blank part are left out."""
    rows = triples.select("graph_id", "ord", *[normalize_name(F.coalesce(c, F.lit(""))).alias(c) for c in TRIPLE])
    return keep_first(rows.filter(" and ".join(f"`{c}` <> ''" for c in TRIPLE)), ["graph_id", *TRIPLE])


def names(rows: DataFrame, most: int) -> DataFrame:
    """graph_id, ord, name: folded names, the first `most` different ones of each graph."""
    return _capped(keep_first(rows.select("graph_id", "ord", _name("name").alias("name")).filter("name <> ''"), ["graph_id", "name"]), most)


def triples(rows: DataFrame, types: DataFrame, relations: DataFrame, most: int = fixed.ONTOLOGY_CAPS["relations"]) -> DataFrame:
    """graph_id, ord, from, relation, to: the first `most` different triples of known entity and relation types."""
    rows = rows.select("graph_id", "ord", *[_name(c).alias(c) for c in TRIPLE])
    for column, known in (("from", types), ("to", types), ("relation", relations)):
        rows = rows.join(known.select("graph_id", F.col("name").alias(column)), ["graph_id", column], "left_semi")
    return _capped(keep_first(rows.select("graph_id", "ord", *TRIPLE), ["graph_id", *TRIPLE]), most)


def normalized(types: DataFrame, relations: DataFrame, links: DataFrame, notes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The four parts of an ontology, bounded and consistent, and errors (graph_id, error) of graphs that lack one.

    types, relations, notes: graph_id, ord, name. links: graph_id, ord, from, relation, to.
    """
    caps = fixed.ONTOLOGY_CAPS
    kept = {"entity_types": names(types, caps["entity_types"]), "relation_types": names(relations, caps["relation_types"])}
    kept["relations"] = triples(links, kept["entity_types"], kept["relation_types"], caps["relations"])
    if notes is not None:
        kept["design_notes"] = names(notes, caps["design_notes"])
    graphs = types.select("graph_id").union(relations.select("graph_id")).union(links.select("graph_id")).distinct()
    for part in ("entity_types", "relation_types", "relations"):
        graphs = graphs.join(kept[part].select("graph_id", F.lit(True).alias(part)).distinct(), "graph_id", "left")
    first = F.coalesce(*[F.when(F.col(part).isNull(), f"no {part}") for part in ("entity_types", "relation_types", "relations")])
    return {**kept, "errors": graphs.select("graph_id", first.alias("error")).filter("error is not null")}
