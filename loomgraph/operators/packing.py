"""The lexicographically first packing of ordered groups, by frontier rounds of joins.

A group keeps the members that no earlier accepted group holds; it is accepted if enough of them are left, and
a group that isn't accepted uses nothing up. Whether a group is accepted depends on earlier groups with one of
its members, so in a chain each waits for the one before. Three things settle groups long before their turn:

- a member's first open group has it for certain, and enough certain members settle a group at once;
- a group that can't have enough members left, whatever earlier groups do, is settled as well;
- a group all of whose doubts are about one earlier group is a function of that group's outcome, and
  functions are composed by doubling, so a chain of n such groups takes about log2(n) joins, not n.

The first open group of every graph is always settled, so every round makes progress. Rounds work on the open
rows only. Once a round has at most IN_ONE of them left, the rest is finished in order by one task for each graph.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

IN_ONE = 100_000
GROUP = ["graph_id", "group_ord"]


def _fits(count: Column, single: Column, single_differs: bool) -> Column:
    """Whether a group with so many members left, or with this one alone, is accepted."""
    alone = (count == 1) & F.coalesce(single != F.col("name"), F.lit(False)) if single_differs else F.lit(False)
    return (F.col("name") != "") & ((count > 1) | alone)


def _frontier(open_rows: DataFrame) -> DataFrame:
    """open_rows with the first open group of their member, and the second."""
    first = written(open_rows.groupBy("graph_id", "member").agg(F.min("group_ord").alias("first")), "first")
    rows = open_rows.join(first, ["graph_id", "member"])
    second = written(rows.filter("group_ord > first").groupBy("graph_id", "member").agg(F.min("group_ord").alias("second")), "second")
    return rows.join(second, ["graph_id", "member"], "left")


def _judged(open_rows: DataFrame, single_differs: bool) -> DataFrame:
    """graph_id, group_ord, on, if_on, if_off: the outcome as a function of group `on`; constant (both alike) where `on` is null; unknown (both null) otherwise."""
    sure, doubt = F.col("group_ord") == F.col("first"), F.col("group_ord") > F.col("first")
    told = _frontier(open_rows).groupBy(*GROUP, "name").agg(
        F.count_if(sure).alias("sure"), F.max(F.when(sure, F.col("member"))).alias("sure_one"), F.count_if(doubt).alias("doubts"), F.max(F.when(doubt, F.col("member"))).alias("doubt_one"),
        F.count_if(doubt & (F.col("group_ord") == F.col("second"))).alias("near"), F.min(F.when(doubt, F.col("first"))).alias("on"), F.max(F.when(doubt, F.col("first"))).alias("also"),
    )
    none = F.col("doubts") == 0
    least = _fits(F.col("sure"), F.col("sure_one"), single_differs)
    most = _fits(F.col("sure") + F.col("doubts"), F.coalesce("sure_one", "doubt_one"), single_differs)
    certain = none | (F.col("sure") > 1) | ~most
    one = (F.col("doubts") == F.col("near")) & (F.col("on") == F.col("also"))
    known = F.when(none, least).otherwise(most)
    return told.select(*GROUP, F.when(~certain & one, F.col("on")).alias("on"), F.when(certain, known).when(one, least).alias("if_on"), F.when(certain, known).when(one, most).alias("if_off"))


def _composed(judged: DataFrame) -> DataFrame:
    """graph_id, group_ord, ok of the groups whose outcome is known, chains of functions included."""
    known = judged.filter("on is null and if_on is not null").select(*GROUP, F.col("if_on").alias("ok"))
    links = judged.filter("on is not null")
    while links.head(1):
        links = written(links, "links")
        # What the group that a link leads to is itself: known, a function of one before, or unknown.
        ends = known.select("graph_id", F.col("group_ord").alias("on"), "ok")
        met = links.join(written(ends, "ends"), ["graph_id", "on"], "left")
        fresh = met.filter("ok is not null").select(*GROUP, F.when(F.col("ok"), F.col("if_on")).otherwise(F.col("if_off")).alias("ok"))
        before = links.select("graph_id", F.col("group_ord").alias("on"), F.col("on").alias("then"), F.col("if_on").alias("on1"), F.col("if_off").alias("off1"))
        far = met.filter("ok is null").drop("ok").join(before, ["graph_id", "on"])
        through = lambda c: F.when(F.col(c), F.col("if_on")).otherwise(F.col("if_off"))
        known, links = written(known.unionByName(fresh), "known"), far.select(*GROUP, F.col("then").alias("on"), through("on1").alias("if_on"), through("off1").alias("if_off"))
    return known


def _in_order(open_rows: DataFrame, single_differs: bool) -> DataFrame:
    """graph_id, group_ord, ok of all groups of few open rows, each graph's in a task."""

    def each(graph: pd.DataFrame) -> pd.DataFrame:
        used, told = set(), []
        for (at, name), some in graph.groupby(["group_ord", "name"], sort=True)["member"]:
            left = [x for x in some if x not in used]
            ok = bool(name) and (len(left) > 1 or (single_differs and len(left) == 1 and left[0] != name))
            if ok:
                used.update(left)
            told.append((graph["graph_id"].iloc[0], at, ok))
        return pd.DataFrame(told, columns=[*GROUP, "ok"])

    kinds = dict(open_rows.dtypes)
    return open_rows.select(*GROUP, "name", "member").groupBy("graph_id").applyInPandas(each, f"graph_id {kinds['graph_id']}, group_ord {kinds['group_ord']}, ok boolean")


def packed(rows: DataFrame, single_differs: bool = False, in_one: int = IN_ONE) -> DataFrame:
    """graph_id, group_ord, members of the accepted groups, the members that are left in the order of pos.

    rows: graph_id, group_ord (distinct in a graph), name, pos, member (not null, once a group), one for each
    member. single_differs: a group with one member left is accepted if that differs from its name.
    """
    rows = written(rows.select(*GROUP, "name", "pos", "member"), "members")
    open_rows, accepted = rows.drop("pos"), []
    while n := open_rows.count():
        ok = _in_order(open_rows, single_differs) if n <= in_one else _composed(_judged(open_rows, single_differs))
        ok = written(ok, "settled")
        accepted.append(ok.filter("ok").drop("ok"))
        taken = open_rows.join(accepted[-1], GROUP, "left_semi").groupBy("graph_id", "member").agg(F.min("group_ord").alias("at"))
        left = open_rows.join(ok, GROUP, "left_anti").join(written(taken, "taken"), ["graph_id", "member"], "left")
        # A group that loses all its members to earlier ones is settled too: nothing is left of it.
        open_rows = written(left.filter("at is null or at > group_ord").drop("at"), "open")
    groups = rows.select(*GROUP).limit(0)
    for some in accepted:
        groups = groups.unionByName(some)
    held = rows.join(written(groups, "accepted"), GROUP, "left_semi")
    first = written(held.groupBy("graph_id", "member").agg(F.min("group_ord").alias("at")), "holders")
    own = held.join(first, ["graph_id", "member"]).filter("at = group_ord")
    return own.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("members"))
