"""Knowledge graphs as vertex and edge tables of many graphs at once.

nodes: graph_id, ord, id, name, canonical_name, aliases, type, description, source_chunk_id,
source_part_id, evidence. edges: graph_id, ord, id, source, target, relation, description, ... ord, a
distinct number for each row of a graph, gives the order in which "first" is meant. Operators need only
the columns that they name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.joins import hashed_joins
from ..functions.ordering import keep_first, numbered
from ..functions.text import collapse_space, nonblank_or, normalize_name, plain, trimmed, truncated, uni_trim
from ..sources.tables import written
from .packing import IN_ONE, packed

# ---- repair and constraints ----


def repaired_nodes(nodes: DataFrame, part: str = "part_id") -> DataFrame:
    """Nodes with a name, the first of each (part, name, type), with defaults and bounded texts."""
    have = set(nodes.columns)
    text = lambda c: plain(F.col(c)) if c in have else F.lit("")
    rows = nodes.withColumn("name", normalize_name(F.coalesce("name", F.lit("")))).filter("name <> ''")
    rows = rows.withColumns({"type": nonblank_or(F.col("type"), fixed.OTHER_TYPE), "canonical_name": nonblank_or(normalize_name(F.col("canonical_name")), F.col("name")) if "canonical_name" in have else F.col("name"), "description": truncated(text("description"), fixed.SHORT_TEXT), "evidence": truncated(text("evidence"), fixed.EVIDENCE_TEXT)})
    rows = rows.withColumn("id", nonblank_or(F.col("id"), F.concat(F.lit("n"), (F.col("ord") + 1).cast("string"))))
    return keep_first(rows, [part, "name", "type"])


def repaired_edges(edges: DataFrame, nodes: DataFrame, part: str = "part_id") -> DataFrame:
    """Edges whose two different ends are nodes of the same part."""
    have = set(edges.columns)
    rows = edges.withColumns({"source": plain(F.col("source")), "target": plain(F.col("target")), "relation": nonblank_or(F.col("relation"), fixed.VAGUE_RELATION), "id": nonblank_or(F.col("id"), F.concat(F.lit("e"), (F.col("ord") + 1).cast("string")))})
    if "description" in have:
        rows = rows.withColumn("description", truncated(plain(F.col("description")), fixed.SHORT_TEXT))
    return with_both_ends(rows.filter("source <> target"), nodes, [part])


def with_both_ends(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    # Ids stand before by in keys: what is sorted for the joins is then told apart by its first bytes, which few graphs aren't.
    columns, ids = edges.columns, nodes.select("id", *by).distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), [end, *by], "left_semi")
    return edges.select(*columns)


def constrained(nodes: DataFrame, edges: DataFrame, types: list[str] = (), relations: list[str] = (), triples: list[tuple[str, str, str]] = (), by: list[str] = ("graph_id",)) -> tuple[DataFrame, DataFrame]:
    """Nodes of allowed types; edges between them of allowed relations and triples. An empty list allows all."""
    by = list(by)
    kept = nodes.filter(F.col("type").isin(*types)) if types else nodes
    rows = with_both_ends(edges, kept, by)
    if relations:
        rows = rows.filter(F.col("relation").isin(*relations))
    if triples:
        kinds = kept.select(*by, "id", "type")
        for end in ("source", "target"):
            rows = rows.join(kinds.withColumnsRenamed({"id": end, "type": f"_{end}_type"}), [*by, end])
        allowed = edges.sparkSession.createDataFrame(sorted(set(triples)), "_source_type string, relation string, _target_type string")
        # The caller's list is broadcast as long as it is a list that a person may write.
        allowed = F.broadcast(allowed) if len(triples) <= 10_000 else allowed
        rows = rows.join(allowed, ["_source_type", "relation", "_target_type"], "left_semi")
    return kept, rows.select(*edges.columns)


def ontology(names: Column, cap: int) -> Column:
    """Folded, distinct, non-blank names, at most cap of them."""
    each = F.transform(names, lambda x: truncated(collapse_space(F.coalesce(x, F.lit(""))), fixed.TYPE_TEXT))
    return F.slice(F.array_distinct(F.filter(each, lambda x: x != "")), 1, cap)


def renumbered(rows: DataFrame, prefix: str, by: str = "graph_id", order: str = "ord") -> DataFrame:
    """id as prefix and number in each graph."""
    return numbered(rows, [by], order, "_n").withColumn("id", F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def global_ids(nodes: DataFrame, edges: DataFrame, part: str = "part_id") -> tuple[DataFrame, DataFrame]:
    """Ids that are local to a part made global (rn.., re..), ends of edges mapped along."""
    local = nodes.withColumn("_local", F.col("id"))
    new = renumbered(local, "rn")
    ids = new.select("graph_id", part, F.col("_local").alias("_old"), F.col("id").alias("_new"))
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnsRenamed({"_old": end, "_new": f"_{end}"}), ["graph_id", part, end]).drop(end).withColumnRenamed(f"_{end}", end)
    return new.drop("_local"), renumbered(rows, "re").select(*edges.columns)


def _distinct(value: Column, kind: T.DataType, path: str, key: str) -> tuple[Column, list[tuple[str, str, Column, Column]]]:
    """value with repeated elements of the array fields in it dropped, and (key, path, before, after) of each such field."""
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.ArrayType, T.StructType)):
            return value, []
        clean = F.transform(value, lambda x: _distinct(x, kind.elementType, "", "")[0])
        found = []
        for i, (k, at, _, _) in enumerate(_distinct(F.lit(None), kind.elementType, f"{path}[]", key)[1]):
            total = lambda n, i=i: F.aggregate(F.transform(value, lambda x: _distinct(x, kind.elementType, "", "")[1][i][n]), F.lit(0), lambda s, y: s + F.coalesce(y, F.lit(0)))
            found.append((k, at, total(2), total(3)))
        return clean, found
    if isinstance(kind, T.StructType):
        fields, found = [], []
        for f in kind.fields:
            clean, inner = _field(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, f.name)
            fields.append(clean.alias(f.name))
            found += inner
        return F.when(value.isNotNull(), F.struct(*fields)), found
    return value, []


def _field(value: Column, kind: T.DataType, path: str, key: str) -> tuple[Column, list[tuple[str, str, Column, Column]]]:
    clean, found = _distinct(value, kind, path, key)
    if isinstance(kind, T.ArrayType):
        once = F.array_distinct(clean)
        return once, [*found, (key, path, F.coalesce(F.size(value), F.lit(0)), F.coalesce(F.size(once), F.lit(0)))]
    return clean, found


def distinct_values(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Array fields, at any depth, with repeated values dropped (first kept), and per graph and field what was removed.

    Elements are compared as wholes, after the fields inside them are cleaned. A field is named by its key
    and its path, where [] stands for any element.
    """
    clean, stats = {}, []
    for f in rows.schema.fields:
        clean[f.name], found = _field(F.col(f.name), f.dataType, f.name, f.name)
        stats += [F.struct(F.lit(k).alias("key"), F.lit(at).alias("path"), before.alias("before"), after.alias("after")) for k, at, before, after in found]
    if not stats:
        return rows, rows.sparkSession.createDataFrame([], "graph_id string, key string, path string, before long, after long, removed long")
    long = rows.select("graph_id", F.inline(F.array(*stats)))
    return rows.withColumns(clean), long.groupBy("graph_id", "key", "path").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum(F.col("before") - F.col("after")).alias("removed"))


def edited_instances(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a user edited them: label for a missing name, from/to/label for edges' fields."""
    have_n, have_e = set(nodes.columns), set(edges.columns)
    pick = lambda have, *names: F.coalesce(*[F.nullif(plain(F.col(n)), F.lit("")) for n in names if n in have], F.lit(""))
    rows = nodes.select("graph_id", "ord", pick(have_n, "id").alias("id"), pick(have_n, "name", "label").alias("name"), nonblank_or(F.col("type"), fixed.OTHER_TYPE).alias("type")).filter("id <> '' and name <> ''")
    rows = keep_first(rows, ["graph_id", "id"])
    links = edges.select("graph_id", "ord", pick(have_e, "source", "from").alias("source"), pick(have_e, "target", "to").alias("target"), nonblank_or(pick(have_e, "relation", "label"), fixed.VAGUE_RELATION).alias("relation"))
    links = keep_first(with_both_ends(links.filter("source <> target"), rows, ["graph_id"]), ["graph_id", "source", "target", "relation"])
    return rows, links


def without_node(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes in gone (graph_id, id) and the edges at them."""
    for end in ("source", "target"):
        edges = edges.join(gone.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_anti")
    return nodes.join(gone, ["graph_id", "id"], "left_anti"), edges


def without_type(triples: DataFrame, types: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Ontology triples (graph_id, from, relation, to) without those of removed entity types (graph_id, type) or relation types (graph_id, relation)."""
    if types is not None:
        for end in ("from", "to"):
            triples = triples.join(types.select("graph_id", F.col("type").alias(end)), ["graph_id", end], "left_anti")
    return triples if relations is None else triples.join(relations.select("graph_id", "relation"), ["graph_id", "relation"], "left_anti")


# ---- merging nodes ----


def merge_batches(nodes: DataFrame, size: int = fixed.MERGE_BATCH) -> DataFrame:
    """graph_id, type, batch, id, ...: nodes of a type in their order in batches; types of one node are left out."""
    rows = nodes.withColumn("type", nonblank_or(truncated(F.col("type"), fixed.TYPE_TEXT), fixed.OTHER_TYPE))
    rows = numbered(rows, ["graph_id", "type"], "ord", "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("int"))
    sizes = rows.groupBy("graph_id", "type", "batch").agg(F.count("*").alias("batch_size")).filter("batch_size > 1")
    return rows.drop("_n").join(sizes, ["graph_id", "type", "batch"])


def proposed_merges(nodes: DataFrame) -> DataFrame:
    """The offline provider's groups: nodes with equal folded canonical name and type."""
    name = F.lower(collapse_space(F.coalesce(F.nullif(plain(F.col("canonical_name")), F.lit("")), F.col("name")) if "canonical_name" in nodes.columns else F.col("name")))
    groups = nodes.groupBy("graph_id", "type", name.alias("_name")).agg(F.min("ord").alias("group_ord"), F.min_by("name", "ord").alias("canonical_name"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("all")).filter(F.size("all") > 1)
    return groups.select("graph_id", "group_ord", "canonical_name", F.transform("all", lambda x: x["id"]).alias("node_ids"), F.lit("same name").alias("reason"))


def validated_groups(groups: DataFrame, members: str, names: str, single_differs: bool = False, in_one: int = IN_ONE) -> DataFrame:
    """Groups with members of earlier accepted groups dropped, if two or more are left.

    Groups that share no member with another are judged one by one, those that do by packing.packed(), where
    no graph's groups are one task's. single_differs: a group of one member stays if it differs from the
    group's name. Null members don't count.
    """
    rows = written(groups.withColumns({names: truncated(collapse_space(F.coalesce(names, F.lit(""))), fixed.NAME_TEXT), members: F.array_compact(F.array_distinct(members))}), "groups")
    each_one = rows.select("graph_id", "group_ord", F.col(names).alias("name"), F.posexplode(members).alias("pos", "member"))
    shared = each_one.groupBy("graph_id", "member").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    clash = written(each_one.join(shared, ["graph_id", "member"], "left_semi").select("graph_id", "group_ord").distinct(), "clashes")
    own = rows.join(clash, ["graph_id", "group_ord"], "left_anti")
    size = F.size(members)
    sound = (F.col(names) != "") & ((size > 1) | ((size == 1) & (F.get(members, F.lit(0)) != F.col(names)) if single_differs else F.lit(False)))
    if not clash.head(1):
        return own.filter(sound).select(*rows.columns)
    left = packed(each_one.join(clash, ["graph_id", "group_ord"], "left_semi"), single_differs, in_one).withColumnRenamed("members", "_left")
    late = rows.join(left, ["graph_id", "group_ord"]).withColumn(members, F.col("_left")).select(*rows.columns)
    return own.filter(sound).select(*rows.columns).unionByName(late)


def merge_map(groups: DataFrame) -> DataFrame:
    """graph_id, id, rep, pos, canonical_name, reason: each member of a group with its representative."""
    return groups.select("graph_id", F.col("node_ids")[0].alias("rep"), "canonical_name", "reason", F.posexplode("node_ids").alias("pos", "id"))


def merged_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with each group as one: the first member, under the group's name, with the others' texts."""
    have = set(nodes.columns)
    text = lambda c: plain(F.col(c)) if c in have else F.lit("")
    none = F.array().cast("array<string>")
    members = merge_map(groups).withColumnRenamed("canonical_name", "_name")
    rows = nodes.join(members, ["graph_id", "id"], "left")
    aliases = F.concat(F.array(text("name"), text("canonical_name")), F.coalesce("aliases", none) if "aliases" in have else none)
    texts = ["description", "evidence", "source_chunk_id", "source_part_id"]
    inside = rows.filter("rep is not null").select("graph_id", "rep", "_name", "reason", F.struct("pos", "id", "ord", "type", aliases.alias("alias"), *[text(c).alias(c) for c in texts]).alias("member"))
    every = inside.groupBy("graph_id", "rep", "_name", "reason").agg(F.array_sort(F.collect_list("member")).alias("all")).filter(F.size("all") > 1)
    all_of = lambda c: F.transform("all", lambda x: x[c])
    told = lambda a: F.array_distinct(F.filter(a, lambda x: x != ""))
    one = every.select(
        "graph_id",
        F.col("all")[0]["ord"].alias("ord"),
        F.col("rep").alias("id"),
        F.col("_name").alias("name"),
        F.col("_name").alias("canonical_name"),
        F.col("all")[0]["type"].alias("type"),
        F.filter(told(F.flatten(all_of("alias"))), lambda x: x != F.col("_name")).alias("aliases"),
        *[truncated(F.array_join(told(all_of(c)), "；"), 240).alias(c) for c in texts[:2]],
        *[F.array_join(told(all_of(c)), ",").alias(c) for c in texts[2:]],
        all_of("id").alias("merged_from_node_ids"),
        F.col("reason").alias("merge_reason"),
    )
    return rows.filter("rep is null").select(*nodes.columns).unionByName(one, allowMissingColumns=True)


def remapped_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges with the ends of merged nodes at their representatives."""
    ids = merge_map(groups).select("graph_id", "id", "rep")
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnsRenamed({"id": end, "rep": "_rep"}), ["graph_id", end], "left").withColumn(end, F.coalesce("_rep", end)).drop("_rep")
    return rows.select(*edges.columns)


def first_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (source, target, relation), without blank ends and self-loops."""
    rows = edges.withColumns({"source": plain(F.col("source")), "target": plain(F.col("target")), "relation": nonblank_or(truncated(plain(F.col("relation")), fixed.NAME_TEXT), fixed.VAGUE_RELATION)})
    rows = rows.filter("source <> '' and target <> '' and source <> target")
    return keep_first(rows, ["graph_id", "source", "target", "relation"])


def deduplicated_edges(edges: DataFrame, prefix: str = "me") -> DataFrame:
    """first_edges, renumbered."""
    return renumbered(first_edges(edges), prefix)


# ---- relations ----


def relation_summary(edges: DataFrame, nodes: DataFrame | None = None, examples: int = fixed.RELATION_EXAMPLES) -> DataFrame:
    """graph_id, relation, n, examples: the counts and the first examples as 'source -> target'."""
    rows = edges.withColumn("relation", nonblank_or(F.col("relation"), fixed.VAGUE_RELATION))
    counts = rows.groupBy("graph_id", "relation").agg(F.count("*").alias("n"))
    # The first few of each part of a relation's edges, then of all: no task sees all edges of one.
    part = Window.partitionBy("graph_id", "relation", F.pmod(F.xxhash64("ord"), F.lit(64))).orderBy("ord")
    some = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= examples)
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("graph_id", "relation").orderBy("ord"))).filter(F.col("_r") <= examples)
    for end in ("source", "target"):
        if nodes is not None:
            names = nodes.select("graph_id", F.col("id").alias(end), F.col("name").alias("_name"))
            some = some.join(names, ["graph_id", end], "left").withColumn(f"_{end}", nonblank_or(F.col("_name"), F.col(end))).drop("_name")
        else:
            some = some.withColumn(f"_{end}", F.col(end))
    shown = some.groupBy("graph_id", "relation").agg(F.array_sort(F.collect_list(F.struct("_r", F.concat("_source", F.lit(" -> "), "_target").alias("x")))).alias("all"))
    return counts.join(shown, ["graph_id", "relation"]).select("graph_id", "relation", "n", F.array_join(F.transform("all", lambda x: x["x"]), "; ").alias("examples"))


def relation_batches(summary: DataFrame, size: int = fixed.RELATION_BATCH) -> DataFrame:
    """The relations of each graph, most frequent first, in batches."""
    order = Window.partitionBy("graph_id").orderBy(F.desc("n"), "relation")
    return summary.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def relation_map(groups: DataFrame) -> DataFrame:
    """graph_id, old_relation, new_relation of groups (canonical_relation, relation_names); later groups win."""
    rows = groups.select("graph_id", "group_ord", "canonical_relation", F.explode("relation_names").alias("old_relation"))
    return rows.groupBy("graph_id", "old_relation").agg(F.max_by("canonical_relation", "group_ord").alias("new_relation"))


def renamed_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Edges with their relation renamed through a map."""
    names = renames.select("graph_id", F.col("old_relation").alias("relation"), "new_relation")
    rows = edges.join(names, ["graph_id", "relation"], "left").withColumn("relation", F.coalesce("new_relation", "relation"))
    return rows.select(*edges.columns)


def cleaned_relations(edges: DataFrame, renames: DataFrame | None, prefix: str = "rce") -> DataFrame:
    """Edges renamed through a map, then deduplicated; without a map (ontology mode) only the latter."""
    return deduplicated_edges(edges if renames is None else renamed_edges(edges, renames), prefix)


# ---- reports ----


def histogram(rows: DataFrame, column: str, default: str) -> DataFrame:
    return rows.groupBy("graph_id", nonblank_or(F.col(column), default).alias(column)).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def source_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_source_chunk_count, edge_source_chunk_count."""
    count = lambda rows, out: rows.groupBy("graph_id").agg(F.count_distinct(F.nullif(plain(F.col("source_chunk_id")), F.lit(""))).alias(out))
    return count(nodes, "node_source_chunk_count").join(count(edges, "edge_source_chunk_count"), "graph_id", "full").fillna(0)


def _named(nodes: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(plain(F.col("canonical_name")), F.lit("")), plain(F.col("name"))) if "canonical_name" in nodes.columns else plain(F.col("name"))
    return nodes.select("graph_id", "ord", name.alias("name"), nonblank_or(F.col("type"), fixed.OTHER_TYPE).alias("type"), plain(F.col("id")).alias("id")).filter("name <> '' and id <> ''")


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """graph_id, name, type, n, place: names that stand on several nodes of a type, most frequent first, ties by first appearance."""
    found = _named(nodes).groupBy("graph_id", "name", "type").agg(F.count("*").alias("n"), F.min("ord").alias("_first")).filter("n > 1")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("n"), "_first"))).drop("_first")


def duplicate_name_nodes(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """The nodes of duplicate_names, a row each (graph_id, name, type, n, place, ord, id); most: of the first names only."""
    found = duplicate_names(nodes) if most is None else duplicate_names(nodes).filter(F.col("place") <= most)
    return _named(nodes).join(found, ["graph_id", "name", "type"]).select("graph_id", "name", "type", "n", "place", "ord", "id")


KEY = ["graph_id", "source", "target", "relation"]


def _ends_told(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges with invalid and self_loop; ids: graph_id, id, each once."""
    rows = edges
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnsRenamed({"id": end}).withColumn(f"_{end}", F.lit(True)), ["graph_id", end], "left")
    rows = rows.withColumn("invalid", F.col("_source").isNull() | F.col("_target").isNull()).drop("_source", "_target")
    return rows.withColumn("self_loop", ~F.col("invalid") & (F.col("source") == F.col("target")))


def edge_flags(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with missing_relation, invalid, self_loop, duplicate: later tests only where earlier ones let pass."""
    plain_edges = edges.withColumns({c: plain(F.col(c)) for c in KEY[1:]})
    # Whether an edge repeats another doesn't depend on the nodes: nodes are joined once, to the edges, and not to what counts them.
    twice = plain_edges.filter("source <> target").groupBy(*KEY).agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = _ends_told(plain_edges, nodes.select("graph_id", "id").distinct()).withColumn("missing_relation", F.col("relation") == "").join(twice, KEY, "left")
    again = ~F.col("invalid") & ~F.col("self_loop") & F.coalesce(F.col("ord") > F.col("_first"), F.lit(False))
    return rows.select(*edges.columns, "missing_relation", "invalid", "self_loop", again.alias("duplicate"))


def edge_groups(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """graph_id, source, target, relation, n, invalid, self_loop: equal edges as one row, counted before anything is joined."""
    rows = edges.select("graph_id", *[plain(F.col(c)).alias(c) for c in KEY[1:]])
    return _ends_told(rows.groupBy(*KEY).agg(F.count("*").alias("n")), ids)


def isolated_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no edge with two known ends touches (a self-loop touches its node)."""
    ids = nodes.select("graph_id", "id").distinct()
    sound = edge_groups(edges, ids).filter("not invalid")
    touched = sound.select("graph_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    return ids.join(touched, ["graph_id", "id"], "left_anti")


#: Kinds of the rows that edge_counts() counts: a node that a sound edge touches, and edges by what they are.
_TOUCHED, _SOUND, _INVALID, _LOOP = range(4)


def edge_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_analysis with vague_edge_count and relation_types, in one pass over the edges.

    An edge is counted under its relation, and its ends under their ids; both are combined before the shuffle.
    """
    ids = nodes.select("graph_id", "id").distinct()
    kind = F.when(F.col("invalid"), _INVALID).when(F.col("self_loop"), _LOOP).otherwise(_SOUND)
    item = lambda kind, name, n: F.struct(kind.alias("kind"), F.col(name).alias("name"), n.alias("n"))
    own, ends = item(kind, "relation", F.col("n")), [item(F.lit(_TOUCHED), end, F.lit(0).cast("long")) for end in ("source", "target")]
    each = edge_groups(edges, ids).select("graph_id", F.inline(F.when(F.col("invalid"), F.array(own)).otherwise(F.array(own, *ends))))
    each = each.groupBy("graph_id", "kind", "name").agg(F.sum("n").alias("n"), F.count("*").alias("groups"))
    of = lambda test, what="n": F.sum(F.when(test, F.col(what)).otherwise(0))
    edge, sound = F.col("kind") != _TOUCHED, F.col("kind") == _SOUND
    counted = each.groupBy("graph_id").agg(
        F.sum("n").alias("edge_count"), of(edge & (F.col("name") == "")).alias("missing_relation_edge_count"), of(F.col("kind") == _INVALID).alias("invalid_edge_count"),
        of(F.col("kind") == _LOOP).alias("self_loop_edge_count"), (of(sound) - of(sound, "groups")).alias("duplicate_edge_count"), F.count_if(~edge).alias("_touched"),
        of(edge & F.col("name").isin(*fixed.VAGUE_WORDS)).alias("vague_edge_count"), F.count_distinct(F.when(edge, nonblank_or(F.col("name"), fixed.VAGUE_RELATION))).alias("relation_types"),
    )
    size = ids.groupBy("graph_id").agg(F.count("id").alias("node_count"), F.count("*").alias("_ids"))
    rows = size.join(counted, "graph_id", "left").fillna(0)
    alone = F.when(F.col("graph_id").isNull(), 0).otherwise(F.col("_ids") - F.col("_touched"))
    return rows.select("graph_id", "node_count", *counted.columns[1:6], alone.alias("isolated_node_count"), "vague_edge_count", "relation_types")


def edge_analysis(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph: edges, missing relations, invalid ends, self-loops, duplicates, isolated nodes."""
    return edge_counts(edges, nodes).drop("vague_edge_count", "relation_types")


def _sparse_nodes(nodes: DataFrame) -> DataFrame:
    """Per graph: vague nodes, nodes without description or evidence."""
    have = set(nodes.columns)
    blank = lambda c: plain(F.col(c)) == "" if c in have else F.lit(True)
    vague = plain(F.col("name")).isin(*fixed.VAGUE_WORDS) | plain(F.col("type")).isin(*fixed.VAGUE_WORDS)
    return nodes.groupBy("graph_id").agg(F.count_if(blank("description")).alias("missing_description_node_count"), F.count_if(blank("evidence")).alias("missing_evidence_node_count"), F.count_if(vague).alias("vague_node_count"))


def sparse_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: vague nodes and edges, nodes without description or evidence."""
    e = edges.groupBy("graph_id").agg(F.count_if(plain(F.col("relation")).isin(*fixed.VAGUE_WORDS)).alias("vague_edge_count"))
    return _sparse_nodes(nodes).join(e, "graph_id", "left").fillna(0)


#: What lowers the score, the points an item (or the share of isolated nodes), the most, and the reason given.
DEDUCTIONS = {
    "invalid_edge_count": (8, 30, "存在指向不存在节点的边"),
    "self_loop_edge_count": (4, 30, "存在自环边"),
    "duplicate_edge_count": (3, 30, "存在重复边"),
    "missing_relation_edge_count": (2, 30, "存在关系名称缺失的边"),
    "isolated_node_count": (40, 20, "孤立节点占比较高"),
    "vague_edge_count": (2, 10, "存在宽泛关系"),
    "no_edges": (30, 30, "图谱没有关系边"),
}


def quality_score(analysis: DataFrame) -> DataFrame:
    """analysis (edge_analysis with vague_edge_count) with deductions (reason, count, penalty; in fixed order), score and level."""
    count = {c: F.col(c) for c in DEDUCTIONS if c != "no_edges"} | {"no_edges": ((F.col("node_count") > 0) & (F.col("edge_count") == 0)).cast("long")}
    parts = []
    for c, (points, most, reason) in DEDUCTIONS.items():
        lost = F.when(F.col("node_count") > 0, F.least(F.lit(float(most)), count[c] / F.col("node_count") * points).cast("int")).otherwise(0) if c == "isolated_node_count" else F.least(F.lit(most), count[c] * points).cast("int")
        parts.append(F.struct(F.lit(reason).alias("reason"), count[c].cast("long").alias("count"), lost.alias("penalty")))
    rows = analysis.withColumn("deductions", F.filter(F.array(*parts), lambda x: x["penalty"] > 0))
    rows = rows.withColumn("score", F.greatest(F.lit(0), 100 - F.aggregate("deductions", F.lit(0), lambda s, x: s + x["penalty"])))
    return rows.withColumn("level", F.when(F.col("score") >= 85, "good").when(F.col("score") >= 65, "review").otherwise("poor"))


#: The sentences of the recommendations.
RECOMMENDATIONS = {
    "invalid_edge_count": "先删除或修复 source/target 指向不存在节点的边。",
    "self_loop_edge_count": "检查自环边是否有业务含义；无明确含义时建议删除。",
    "duplicate_edge_count": "继续执行边去重，按 source、target、relation 合并重复边。",
    "isolated_node_count": "人工复核孤立节点：重要概念可保留，泛化或噪声节点建议删除。",
    "vague_edge_count": "进一步清洗“相关”等宽泛关系，尽量替换为更明确的关系。",
}
MANY_RELATIONS = "关系类型数量偏多，建议继续做关系归一化。"
NOTHING_TO_DO = "当前图谱结构质量较稳定，可以进入最终导出或可视化阶段。"


def recommendations(report: DataFrame) -> DataFrame:
    """report (with the counts above and relation_types) with recommendations, an array in fixed order."""
    some = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(text)) for c, text in RECOMMENDATIONS.items()], F.when(F.col("relation_types") > 30, F.lit(MANY_RELATIONS))))
    return report.withColumn("recommendations", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(NOTHING_TO_DO))))


def graph_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a graph: sizes, issues, score, level, recommendations."""
    return recommendations(quality_score(edge_counts(edges, nodes).join(_sparse_nodes(nodes), "graph_id")))


# ---- the final graph ----


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, id, in_degree, out_degree, total."""
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("graph_id", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("total"))


def _related(edges: DataFrame) -> DataFrame:
    """edges with plain ends and a bounded relation, the vague one for none.

    They stand behind a generator: a filter on them, or a join, would trim them again.
    """
    rows = edges.withColumns({c: trimmed(c) for c in KEY[1:]})
    bounded = F.when(F.length("relation") > fixed.NAME_TEXT, uni_trim(truncated(F.col("relation"), fixed.NAME_TEXT))).otherwise(F.col("relation"))
    relation = F.coalesce(F.nullif(bounded, F.lit("")), F.lit(fixed.VAGUE_RELATION))
    told = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "target")], relation.alias("relation"))
    return rows.select(*[c for c in edges.columns if c not in KEY[1:]], F.inline(F.array(told))).select(*edges.columns)


def split_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with reason: null for those to keep, else why they are skipped."""
    flagged = edge_flags(_related(edges), nodes)
    reason = F.when(F.col("invalid") | F.col("self_loop"), "invalid_endpoint_or_self_loop").when(F.col("duplicate"), "duplicate_edge")
    return flagged.withColumn("reason", reason).drop("missing_relation", "invalid", "self_loop", "duplicate")


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that split_edges keeps: equal ones are made one before nodes are joined."""
    return with_both_ends(keep_first(_related(edges).filter("source <> target"), KEY), nodes, ["graph_id"])


def final_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, edge_count, skipped_edge_count: how many edges split_edges keeps and skips."""
    sound = ~F.col("invalid") & ~F.col("self_loop")
    rows = edge_groups(_related(edges), nodes.select("graph_id", "id").distinct()).groupBy("graph_id").agg(F.count_if(sound).alias("edge_count"), F.sum("n").alias("_all"))
    return rows.select("graph_id", "edge_count", (F.col("_all") - F.col("edge_count")).alias("skipped_edge_count"))


def skipped_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, source, target, relation, reason, n: how many equal edges split_edges skips, and why."""
    bad = F.col("invalid") | F.col("self_loop")
    rows = edge_groups(_related(edges), nodes.select("graph_id", "id").distinct()).filter(bad | (F.col("n") > 1))
    return rows.select(*KEY, F.when(bad, "invalid_endpoint_or_self_loop").otherwise("duplicate_edge").alias("reason"), F.when(bad, F.col("n")).otherwise(F.col("n") - 1).alias("n"))


def final_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Kept edges as fe1, fe2, ... in their order: graph_id, id, from, to, label, relation, title."""
    with hashed_joins(edges.sparkSession):
        kept = renumbered(kept_edges(edges, nodes), "fe")
    title = nonblank_or(F.col("description"), F.col("relation")) if "description" in kept.columns else F.col("relation")
    return kept.select("graph_id", "id", F.col("source").alias("from"), F.col("target").alias("to"), F.col("relation").alias("label"), "relation", title.alias("title"))


def final_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The first node of each id with label, type, title and degrees among the kept edges."""
    have = set(nodes.columns)
    rows = keep_first(nodes.withColumn("id", plain(F.col("id"))).filter("id <> ''"), ["graph_id", "id"])
    label = truncated(nonblank_or(F.col("name"), nonblank_or(F.col("canonical_name"), F.col("id")) if "canonical_name" in have else F.col("id")), 120)
    rows = rows.select("graph_id", "id", label.alias("label"), truncated(nonblank_or(F.col("type"), fixed.OTHER_TYPE), fixed.TYPE_TEXT).alias("type"), (truncated(nonblank_or(F.col("description"), label), 240) if "description" in have else label).alias("title"))
    kept = kept_edges(edges.select("ord", *KEY), nodes)
    return rows.join(degrees(kept), ["graph_id", "id"], "left").fillna(0, ["in_degree", "out_degree", "total"])


def render(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a viewer needs: labels, types and ends under one name each."""
    have = set(edges.columns)
    points = nodes.select("graph_id", "id", nonblank_or(F.col("label") if "label" in nodes.columns else F.col("name"), F.col("id")).alias("label"), nonblank_or(F.col("type"), "未分类").alias("type"))
    end = lambda a, b: F.col(a) if a in have else F.col(b)
    numbered_id = nonblank_or(F.col("id"), F.concat(F.lit("edge-"), F.col("ord").cast("string"))) if "ord" in have else F.col("id")
    return points, edges.select("graph_id", numbered_id.alias("id"), end("from", "source").alias("source"), end("to", "target").alias("target"), end("label", "relation").alias("label"))
