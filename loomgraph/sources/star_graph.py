"""A graph per market segment over the star schema: customers and parts, joined by what was ordered.

It has planted self-loops, missing and vague relations, and ends that aren't nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGE = """
SELECT c.c_mktsegment AS graph_id,
       l.l_orderkey * 1000000000 + l.l_linenumber * 100000000 + l.l_partkey * 1000 + l.l_suppkey AS ord,
       concat('c', cast(c.c_custkey AS string)) AS source,
       CASE WHEN l.l_partkey % 50 = 7 THEN concat('c', cast(c.c_custkey AS string)) ELSE concat('p', cast(l.l_partkey AS string)) END AS target,
       CASE WHEN l.l_linenumber = 7 THEN '' WHEN l.l_returnflag = 'A' THEN 'accepts' WHEN l.l_returnflag = 'N' THEN 'orders' ELSE '相关' END AS relation,
       concat('o', cast(l.l_orderkey % 1000 AS string)) AS source_chunk_id
FROM {lineitem} l """
EDGES = f"""{EDGE}JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{customer}} c ON o.o_custkey = c.c_custkey
"""
#: Customers meet the orders, which are fewer than their lines.
PLACED = "SELECT o.o_orderkey, c.c_custkey, c.c_mktsegment FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"

NODES = """
SELECT c_mktsegment AS graph_id, c_custkey AS ord, concat('c', cast(c_custkey AS string)) AS id, c_name AS name, 'customer' AS type,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('balance ', cast(cast(floor(c_acctbal) AS int) AS string)) END AS description
FROM {customer}
UNION ALL
SELECT s.graph_id, 1000000000 + p_partkey, concat('p', cast(p_partkey AS string)), p_name, p_type, p_brand
FROM {part} CROSS JOIN (SELECT DISTINCT c_mktsegment AS graph_id FROM {customer}) s WHERE p_partkey % 97 <> 0
"""
NAMES = ("lineitem", "orders", "customer", "part")
#: Parts that a task turns into nodes of every segment.
PARTS_A_TASK = 20_000


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES}
    # A small file of parts is one task's, and each part becomes a node of every segment: parts are dealt out before that,
    # in a number of tasks that follows theirs (the footers tell it), as small shuffles are joined again where it is left open.
    tasks = max(1, -(-tables["part"].count() // PARTS_A_TASK))
    tables["part"] = tables["part"].repartition(tasks, "p_partkey")
    placed = spark.sql(PLACED, orders=tables["orders"], customer=tables["customer"])
    edges = spark.sql(EDGE + "JOIN {placed} c ON l.l_orderkey = c.o_orderkey", lineitem=tables["lineitem"], placed=placed)
    return spark.sql(NODES, **{n: tables[n] for n in ("customer", "part")}), edges


#: The same for an engine where the tables are views of their names.
SQL = {"edges": EDGES.format(**{n: n for n in NAMES}), "nodes": NODES.format(**{n: n for n in NAMES})}
