"""Repeated values dropped from JSON of any shape: no schema, a level of the values at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

REPORT = "_row long, key string, path string, before int, after int, removed int"


def _quoted(text: Column) -> Column:
    """text as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _children(level: DataFrame) -> DataFrame:
    """The values directly in the nested values of a level, each with its place, its key and its path."""
    spark = level.sparkSession
    inner = level.filter("nested").select("_row", F.col("at").alias("up"), F.col("path").alias("over"), "v")
    found = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("_row", "up", "over", "pos", "key", F.col("value").alias("v"))
    below = F.when(F.col("key").isNull(), F.concat("over", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.size("up") == 0, F.col("key")).otherwise(F.concat_ws(".", "over", "key"))
    return _marked(found.select("_row", "up", F.concat("up", F.array("pos")).alias("at"), "pos", "key", below.alias("path"), "v"))


def _marked(rows: DataFrame) -> DataFrame:
    """rows with what a value is; a value without parts has its text, and is itself not carried on."""
    kind = F.schema_of_variant("v")
    rows = rows.withColumns({"nested": F.coalesce(kind.rlike("^(OBJECT|ARRAY)<"), F.lit(False)), "object": F.coalesce(kind.startswith("OBJECT<"), F.lit(False))})
    plain = F.when(~F.col("nested"), F.coalesce(F.to_json("v"), F.lit("null")))
    return rows.withColumn("plain", plain).withColumn("v", F.when(F.col("nested"), F.col("v")))


def _folded(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """level with json, the text of each value after what is in it is clean, and the sizes of its lists."""
    if below is None:
        return level.withColumns({"json": F.coalesce("plain", F.when(F.col("object"), F.lit("{}")).otherwise(F.lit("[]"))), "before": F.lit(0), "after": F.lit(0)})
    parts = below.groupBy("_row", F.col("up").alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "json"))).alias("parts"))
    rows = level.join(parts, ["_row", "at"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<pos:int,key:string,json:string>>")))
    texts = F.transform("parts", lambda x: x["json"])
    rows = rows.withColumn("kept", F.when(F.col("key").isNotNull(), F.array_distinct(texts)).otherwise(texts))
    members = F.transform(F.array_sort(F.transform("parts", lambda x: F.struct(x["key"], x["json"]))), lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["json"]))
    json = F.when(F.col("object"), F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), F.array_join("kept", ","), F.lit("]")))
    listed = F.col("nested") & ~F.col("object")
    return rows.withColumns({"json": F.coalesce("plain", json), "before": F.when(listed, F.size("parts")).otherwise(0), "after": F.when(listed, F.size("kept")).otherwise(0)}).drop("parts", "kept")


def distinct_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """rows with _row (their number here) and _clean, and _row, key, path, before, after, removed of each list that lost values.

    A list that is the value of a key keeps the first of equal values, compared as wholes after what is in them is
    clean, whatever the order of their keys; lists directly in lists, and a list as the whole text, stay as they are.
    Paths are those of the text: keys joined by dots, places in lists (from 0) in brackets.

    The values are walked down a level at a time, each level a table with only the objects and lists of the one
    above taken apart, and folded up again, one join a level: as many jobs as the deepest text has levels, and
    a task holds a list of one text at most. _clean has keys in code-point order and no white space; it is null where
    the text is null, isn't JSON, or has a key twice in an object. Numbers are equal by value (1, 1.0), as the
    variant type keeps them. Rows may repeat; an empty table gives empty results; columns are carried along.
    """
    spark = rows.sparkSession
    if clash := {"_row", "_clean"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are this operator's own")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "json-rows")
    top = rows.select("_row", F.try_parse_json(F.col(f"`{column}`")).alias("v")).filter("v is not null")
    none = F.array().cast("array<int>")
    levels = [written(_marked(top.select("_row", none.alias("up"), none.alias("at"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.lit("$").alias("path"), "v")), "json-level")]
    while not levels[-1].filter("nested").isEmpty():
        levels.append(written(_children(levels[-1]).filter("pos is not null"), "json-level"))
    below, report = None, spark.createDataFrame([], REPORT)
    for level in reversed(levels):
        below = written(_folded(level, below), "json-folded")
        lost = below.filter(F.col("key").isNotNull() & (F.col("after") < F.col("before")))
        report = report.unionByName(lost.select("_row", "key", "path", "before", "after", (F.col("before") - F.col("after")).alias("removed")))
    return rows.join(below.select("_row", F.col("json").alias("_clean")), "_row", "left"), report
