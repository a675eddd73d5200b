"""Exact dedup by skew-safe combining, with SQL functions alone.

identities() writes a narrow row for each document: a 128-bit xxhash digest of its text, and its SHA-256.
Digests that stand once are settled. For the others combined() compares whole texts three times over: each
task combines its own rows of equal text (the partial aggregate), then rows of equal digest, salt and text
meet, and then the winners of the salts of equal digest and text. Only digests with more than 1/HOT of all
rows, fewer than HOT of them, are salted (by the task that read them), so all other texts are shuffled once.

A group of texts is told by its digest if all rows of the digest have the same text, which the
combined numbers show. If some digest holds different texts, its rows are grouped by their bytes.

Defined results: a null text is the empty text; a null doc_id is smaller than any other; of rows with the
same text and the same largest doc_id one stays, whichever; an empty table gives an empty result; further
columns of the input are ignored by groups() and kept by deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import maybe_in, unused, written

HOT = 1000
SECOND = "second half"


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: Column) -> Column:
    """128 bits as a pair of longs."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(SECOND), text).alias("b"))


def identities(docs: DataFrame, *keep: str) -> DataFrame:
    """uid, doc_id, digest, text_sha256 and the columns to keep of each row, written: the texts are read once for it."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", digest(whole("text")).alias("digest"), F.sha2(whole("text"), 256).alias("text_sha256"), *keep), "identities")


def _combine(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def combined(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """digest, text, keep_id, n: the groups of equal texts among rows whose digest is in repeated (digest, n, hot).

    A bitmap keeps most texts of other digests out; those that pass come back as groups of one.
    """
    # As many salts as the square root of the tasks: a salt's group and the last one then get about as many rows.
    tasks = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    salts = max(1, round((tasks + 1) ** 0.5))
    hot = repeated.filter("hot").select("digest", F.lit(True).alias("hot"))
    rows = docs.select(F.col("doc_id").alias("keep_id"), whole("text").alias("text"), digest(whole("text")).alias("digest"), F.spark_partition_id().alias("task"), F.lit(1).cast("long").alias("n"))
    rows = maybe_in(rows, repeated, "digest").join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod("task", F.lit(salts))).otherwise(-1))
    met = _combine(rows, "digest", "salt", "text")
    winners = _combine(met.filter("salt >= 0"), "digest", "text")
    return met.filter("salt < 0").select(*winners.columns).unionByName(winners)


def _told_by_digest(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups of digests that hold one text: digest, keep_id, group_size, hot; digests that hold several)."""
    n = ids.count()
    repeated = written(ids.groupBy("digest").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("hot", F.col("rows") * HOT > n), "repeated")
    groups = written(combined(docs, repeated).drop("text"), "groups").join(repeated, "digest")
    mixed = groups.filter("n < rows").select("digest").distinct()
    return groups.filter("n = rows").select("digest", "keep_id", F.col("n").alias("group_size"), "hot"), mixed


def _told_by_text(docs: DataFrame, ids: DataFrame, mixed: DataFrame) -> DataFrame:
    """uid, keep_id, group_size of the rows whose digest is in mixed: rows meet their group by the whole text."""
    sha = F.sha2(whole("text"), 256)
    rows = docs.select("doc_id", whole("text").alias("text"), digest(whole("text")).alias("digest"), sha.alias("text_sha256"))
    rows = written(maybe_in(rows, mixed, "digest").join(mixed, "digest", "left_semi"), "mixed")
    groups = rows.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("text_sha256").alias("text_sha256"))
    same = groups.select("digest", "text_sha256", "keep_id", "group_size")
    return ids.join(mixed, "digest", "left_semi").join(same, ["digest", "text_sha256"]).select("uid", "keep_id", "group_size")


def _with_groups(ids: DataFrame, groups: DataFrame) -> DataFrame:
    """ids left-joined with groups: hot digests, fewer than HOT, by broadcast; the others have few rows each."""
    few = groups.filter("hot").select("digest", F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    rows = ids.join(F.broadcast(few), "digest", "left").withColumn("_met", F.col("_size").isNotNull())
    rest = rows.filter("not _met").join(groups.filter("not hot").drop("hot"), "digest", "left")
    return rest.unionByName(rows.filter("_met").withColumns({"keep_id": F.col("_keep"), "group_size": F.col("_size")})).drop("_keep", "_size", "_met")


def groups(docs: DataFrame, *keep: str) -> DataFrame:
    """uid, doc_id, text_sha256, keep_id, group_size, kept and the columns to keep of every row of docs (doc_id, text)."""
    ids = identities(docs, *keep)
    told, mixed = _told_by_digest(docs, ids)
    rows = _with_groups(ids, told)
    if mixed.head(1):  # a boolean: no digest of 128 bits is expected to hold two texts
        other = _told_by_text(docs, ids, mixed).withColumnsRenamed({"keep_id": "_keep", "group_size": "_size"})
        rows = rows.join(other, "uid", "left").withColumns({"keep_id": F.coalesce("keep_id", "_keep"), "group_size": F.coalesce("group_size", "_size")}).drop("_keep", "_size")
    rows = written(rows.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}), "grouped")
    # Rows that share the largest doc_id: one of them stays. Combined before the shuffle, so any number may.
    last = rows.filter((F.col("group_size") > 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = last.groupBy("digest", "text_sha256").agg(F.max("uid").alias("uid")).select("uid", F.lit(True).alias("_one"))
    return rows.join(one, "uid", "left").withColumn("kept", (F.col("group_size") == 1) | F.coalesce("_one", F.lit(False))).drop("_one", "digest")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: the one with the largest doc_id."""
    uid, *kept = unused(docs.columns, "uid", "kept")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    found = groups(rows.select("doc_id", "text", uid), uid).filter("kept").select(uid)
    return rows.join(found, uid, "left_semi").drop(uid)
