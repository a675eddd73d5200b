"""What makes work grow faster than the input: plans and pieces that must stay small."""

import re

from pyspark.sql import functions as F

from loomgraph.functions import batches
from loomgraph.functions.joins import hashed_joins
from loomgraph.functions.ordering import keep_first, numbered
from loomgraph.functions.text import nonblank_or, plain, trimmed, truncated, uni_trim
from loomgraph.operators import chunking, graph, lines, quality, rag, reports
from loomgraph.plans import providers
from loomgraph.sources import star_graph


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_quality_do_not_repeat_its_patterns(spark):
    chunks = spark.createDataFrame([("t", "该 text."), ("u", "因此 " * 50)], "title string, content string")
    checked = quality.with_quality(chunks)
    kept = checked.filter(quality.skip_reason(F.col("content"), F.col("level"), F.col("suggestion")).isNull())
    for rows in (kept, quality.problems(checked)):
        assert optimized(rows).count("RLIKE") <= optimized(checked).count("RLIKE")
    assert quality.problems(checked).count() == checked.filter("level = 'warning' or level = 'bad'").count()


def test_trim_is_what_the_pattern_trims(spark):
    codes = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    rows = codes.select(F.explode(F.array(F.concat("c", F.lit("a"), "c", F.lit("b"), "c"), F.concat("c", F.lit(" 　"), "c"))).alias("x"))
    old = F.regexp_replace("x", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert rows.filter(~uni_trim(F.col("x")).eqNullSafe(old)).count() == 0
    assert "regexp" not in optimized(rows.select(uni_trim(F.col("x"))))


def counted(rows):
    """rows, and an accumulator of how many of them were made."""
    made = rows.sparkSession.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return rows.mapInPandas(each, rows.schema), made


def test_lines_are_made_once_for_removing_contents(spark):
    texts = ["目录", "某章 ........ 1", "第一章 起", "正文", "某章 ........ 2"]
    rows = spark.createDataFrame([(d, i, x) for d in (1, 2) for i, x in enumerate(texts[d - 1 :])], "doc_id int, pos int, line string")
    rows, made = counted(rows)
    kept = {tuple(r) for r in lines.without_toc(rows).collect()}
    assert kept == {(1, 2, "第一章 起"), (1, 3, "正文"), (2, 1, "第一章 起"), (2, 2, "正文")}
    assert made.value == 9


def test_documents_without_contents_stay_rows(spark):
    docs = spark.createDataFrame([(1, " a \r\n\r\n\r\n\r\nb ..... 3\r c "), (2, None), (3, "目录\na ..... 1\n第一章 x\ny"), (4, "目 录")], "doc_id int, text string")
    out = lines.cleaned_for_chunking(docs)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\n\nc", 2: "", 3: "第一章 x\ny", 4: ""}
    assert "Union" in optimized(out)


def test_pages_are_made_once_for_cleaning(spark):
    rows, made = counted(spark.createDataFrame([(1, p, f"页眉\n正文{p}。\n12") for p in range(4)] + [(2, 1, "a"), (2, 0, "c\nb")], "doc_id int, page int, text string"))
    assert {r.doc_id: r.text for r in lines.clean_pages(rows).collect()} == {1: "正文0。\n正文1。\n正文2。\n正文3。", 2: "cba"}
    assert made.value == 6


def test_texts_come_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "第一章 起\n文。")], "doc_id int, text string")
    chunks = chunking.fixed_length(docs)
    for use in (lambda: rag.rag_chunks(chunks), lambda: chunking.by_headings(docs, ["^第.*$"]), lambda: chunking.by_questions(docs), lambda: providers.decide(docs, providers.Offline(), "strategy", "text")):
        spark.conf.set(key, "10000")
        assert use().count() >= 0
        assert int(spark.conf.get(key)) <= batches.BATCH_ROWS


def test_scores_of_a_block_are_held_in_slices(spark, monkeypatch):
    index = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = index.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, rag.top_k_batch(index, asked, 4, block=16).collect()))
    monkeypatch.setattr(rag, "SCORES", 40)
    assert sorted(map(tuple, rag.top_k_batch(index, asked, 4, block=16).collect())) == whole and len(whole) == 240


def test_first_of_a_key_without_other_columns_is_not_sorted(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("b", None, None), (None, "x", 3)], "graph_id string, source string, ord long")
    first = keep_first(rows, ["graph_id", "source"])
    assert first.columns == rows.columns
    assert {tuple(r) for r in first.collect()} == {("a", "x", 1), ("b", None, None), (None, "x", 3)}
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()


EDGES = [("g", 1, "a", "b", "r"), ("g", 2, "a", "b", "r"), ("g", 2, " a", "b ", "r"), ("g", 4, "a", "a", "相关"), ("g", 5, "a", "z", ""), ("g", 6, "b", "a", "s"), ("g", 7, None, "b", None), ("h", 8, "a", "b", "r"), (None, 9, "a", "b", "r")]
NODES = [("g", 1, "a", "A", "T"), ("g", 2, "b", "B", "T"), ("g", 3, "c", "C", "T"), ("g", 4, None, "D", "T"), ("h", 5, "x", "X", "T"), (None, 6, "a", "A", "T")]


def star(spark):
    return spark.createDataFrame(NODES, "graph_id string, ord long, id string, name string, type string"), spark.createDataFrame(EDGES, "graph_id string, ord long, source string, target string, relation string")


def test_edges_are_made_once_for_reports_on_graphs(spark):
    nodes, edges = star(spark)
    for report in (graph.edge_analysis, lambda e, n: graph.graph_report(n, e)):
        rows, made = counted(edges)
        got = {r["graph_id"]: r for r in report(rows, nodes).collect()}
        assert made.value == len(EDGES)
        row = got["g"]
        assert [row[f"{c}edge_count"] for c in ("", "missing_relation_", "invalid_", "self_loop_", "duplicate_")] == [7, 2, 2, 1, 2]
        assert (row["node_count"], row["isolated_node_count"], got["h"]["isolated_node_count"]) == (3, 2, 1)
    assert (row["vague_edge_count"], row["relation_types"]) == (1, 3)
    assert {(r["graph_id"], r["id"]) for r in graph.isolated_nodes(edges, nodes).collect()} == {("g", "c"), ("g", None), ("h", "x"), (None, "a")}


def test_edges_are_made_once_for_the_final_counts(spark):
    nodes, edges = star(spark)
    rows, made = counted(edges)
    got = {r["graph_id"]: tuple(r)[1:4] for r in reports.final_report(nodes, rows, nodes.select("graph_id", F.lit(1).alias("score"), F.lit("good").alias("level")).distinct()).collect() if r["graph_id"]}
    assert made.value == len(EDGES)
    assert got == {"g": (3, 2, 5), "h": (1, 0, 1)}


def test_edges_are_made_once_for_final_nodes_and_skipped_edges(spark):
    nodes, edges = star(spark)
    rows, made = counted(edges)
    assert {(r["id"], r["total"]) for r in graph.final_nodes(nodes, rows).collect() if r["graph_id"] == "g"} == {("a", 2), ("b", 2), ("c", 0)}
    assert made.value == len(EDGES)
    rows, made = counted(edges)
    skipped = {(r["source"], r["target"], r["relation"], r["reason"]): r["n"] for r in graph.skipped_counts(rows, nodes).collect() if r["graph_id"] == "g"}
    bad = "invalid_endpoint_or_self_loop"
    assert skipped == {("a", "b", "r", "duplicate_edge"): 2, ("a", "a", "相关", bad): 1, ("a", "z", "相关", bad): 1, ("", "b", "相关", bad): 1}
    assert made.value == len(EDGES)


def test_groups_are_made_once_for_validation(spark):
    made_of = [("g", 1, "x", ["a", "b"]), ("g", 2, "y", ["c", "d"]), ("g", 3, "z", ["e"])]
    rows, made = counted(spark.createDataFrame(made_of, "graph_id string, group_ord long, canonical_name string, node_ids array<string>"))
    assert sorted(r["group_ord"] for r in graph.validated_groups(rows, "node_ids", "canonical_name").collect()) == [1, 2]
    assert made.value == len(made_of)


def test_parts_are_dealt_out_before_they_become_nodes(spark):
    nodes, _ = star_graph.graph(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in optimized(nodes)


def test_tasks_that_make_nodes_follow_the_parts(spark, monkeypatch):
    monkeypatch.setattr(star_graph, "PARTS_A_TASK", 20)
    nodes, _ = star_graph.graph(spark, "/root/testdata/sf0.001")
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert parts > 20 and re.search(rf"RepartitionByExpression \[p_partkey#\d+L?\], {-(-parts // 20)}\b", optimized(nodes))


def test_ends_are_trimmed_once_for_the_final_graph(spark):
    nodes, edges = star(spark)
    long = spark.createDataFrame([("g", 10, "\u3000a", "b\xa0", " " + "x" * 119 + "  y "), ("g", 11, "a", None, "   ")], edges.schema)
    edges = edges.union(long)
    old = edges.select("graph_id", "ord", *[plain(F.col(c)).alias(c) for c in ("source", "target")], nonblank_or(truncated(plain(F.col("relation")), 120), "相关").alias("relation"))
    assert sorted(map(str, graph._related(edges).collect())) == sorted(map(str, old.collect()))
    plan = optimized(graph.kept_edges(edges, nodes))
    assert not [line for line in plan.splitlines() if re.match(r"[\s:+-]*(Filter|Join)", line) and "trim(" in line]


def test_trimmed_by_its_ends_is_what_is_trimmed(spark):
    codes = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    rows = codes.select(F.explode(F.array("c", F.concat("c", F.lit("a")), F.concat(F.lit("a"), "c"), F.lit(""), F.lit(None))).alias("x"))
    assert rows.filter(~trimmed("x").eqNullSafe(uni_trim(F.col("x")))).count() == 0


def test_numbers_reach_rows_without_a_shuffle_where_few_ranges_are(spark):
    rows = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("ord"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        plan = numbered(rows, ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_customers_meet_orders_before_their_lines(spark):
    _, edges = star_graph.graph(spark, "/root/testdata/sf0.001")
    joins = [line for line in optimized(edges).splitlines() if "Join" in line]
    assert "l_orderkey" in joins[0] and "o_custkey" in joins[1]
    same = spark.sql(star_graph.EDGES, **{n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("lineitem", "orders", "customer")})
    assert edges.exceptAll(same).count() == same.exceptAll(edges).count() == 0


def test_joins_are_hashed_only_while_it_is_asked_for(spark):
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before = spark.conf.get(key)
    with hashed_joins(spark):
        assert spark.conf.get(key) == spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != before
    assert spark.conf.get(key) == before
