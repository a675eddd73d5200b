"""Document fingerprints: a canonical exact digest, made with SQL functions alone.

canonical() normalises to NFKC, folds case and folds runs of white space into one space, through the
ICU library that Spark ships, called by the SQL function reflect. fingerprint() is two chained 64-bit
xxhash values of the canonical text (128 bits). exact_groups() groups by that digest and then compares
the canonical bytes themselves inside each digest, so that a collision can't join different texts.

Defined results: a null text is the empty text; empty texts share one fingerprint; rows with equal
doc_id are all kept, and are ordered among themselves by a hash of their text; a null doc_id sorts
first; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import maybe_in

SALT = "second half"
_LOWEST = -(2**63)


def _icu_nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def _icu_fold(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, case folding, NFKC again (folding may undo it), white space folded and trimmed."""
    plain = F.coalesce(text, F.lit(""))
    folded = F.when(plain.rlike(r"[^\x00-\x7F]"), _icu_nfkc(_icu_fold(_icu_nfkc(plain)))).otherwise(F.lower(plain))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}\x1C-\x1F]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of chained xxhash, as 32 lower-case hex digits."""
    part = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(SALT), canon))]
    return F.concat(*part)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column out. The canonical text is a column of its own so that it is made once."""
    return df.withColumn("_canon", canonical(F.col(text))).withColumn(out, digest(F.col("_canon"))).drop("_canon")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents with equal canonical texts: doc_id, fingerprint, group_id, group_size.

    docs: doc_id, text. One row for each pair (doc_id, fingerprint) that stands in a group of two or
    more; group_id is the smallest doc_id of the group. A digest's members are compared with one
    representative, never with each other; members that differ from it although the digest is equal
    are grouped by their bytes.
    """
    canon = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("canon", canonical(F.col("text"))).drop("text").withColumn("fingerprint", digest(F.col("canon")))
    sizes = canon.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    members = maybe_in(canon, sizes, "fingerprint").join(sizes, "fingerprint")
    reps = members.filter(F.col("doc_id").eqNullSafe(F.col("rep"))).groupBy("fingerprint").agg(F.min("canon").alias("rep_canon"))
    compared = members.join(reps, "fingerprint", "left").withColumn("same", F.coalesce(F.col("canon") == F.col("rep_canon"), F.lit(False)))
    rest = compared.filter(~F.col("same")).groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("other"), F.collect_set("doc_id").alias("ids"))
    rest = rest.select("fingerprint", F.explode("ids").alias("doc_id"), "other", F.size("ids").cast("long").alias("n"))
    same = compared.filter("same").groupBy("doc_id", "fingerprint").agg(F.min("rep").alias("group_id"), F.max("n").alias("group_size"))
    return same.unionByName(rest.select("doc_id", "fingerprint", F.col("other").alias("group_id"), F.col("n").alias("group_size")))


def _splits(docs: DataFrame, key: Column, rows_per_bucket: int) -> list[int]:
    """At most 65,535 values of key that cut the rows into buckets of about as many rows."""
    n = docs.count()
    steps = min(16, max(6, math.ceil(math.log2(max(1, n / rows_per_bucket)))))
    parts = 2**steps
    got = docs.agg(F.percentile_approx(key, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts)).alias("p")).first()["p"]
    return sorted(set(got or []))


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most key, by binary search."""
    if not splits:
        return F.lit(0)
    bounds = F.array(*[F.lit(x).cast("long") for x in splits])
    steps = [2**i for i in range(len(splits).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = 2000) -> DataFrame:
    """docs with next_<column>: the values in the next row by ascending doc_id; after the last, the first.

    Rows are cut into ranges of doc_id of equal size; each range gets the head of the following range
    as a last row, so that no range needs another and none holds more than its share of the rows.
    """
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(_LOWEST)))
    splits = _splits(keyed, F.col("_key"), rows_per_bucket)
    keyed = keyed.withColumn("_range", _bucket(F.col("_key"), splits)).withColumn("_head", F.lit(False))
    # At most 65,536 rows of two numbers: one for each range.
    heads = keyed.groupBy("_range").agg(F.min("_key").alias("_first"))
    follow = heads.select("_first", F.lag("_range").over(Window.orderBy("_range")).alias("_before"), F.max("_range").over(Window.partitionBy()).alias("_last"))
    follow = follow.select(F.col("_first").alias("_key"), F.coalesce("_before", "_last").alias("_to"))
    borrowed = keyed.join(F.broadcast(follow), "_key").withColumn("_range", F.col("_to")).withColumn("_head", F.lit(True)).select(*keyed.columns)
    order = Window.partitionBy("_range").orderBy("_head", "_key", F.xxhash64(*columns))
    both = keyed.unionByName(borrowed)
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter(~F.col("_head")).drop("_key", "_range", "_head")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of following."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """op1's rows: each document's digest, that of its edited text, their likeness, and its exact group.

    The digest is exact, so likeness is 1 for equal digests and 0 otherwise.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(with_fingerprint(docs, "text", "fingerprint"), ["text", "fingerprint"])
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited(F.col("text"), F.col("next_text")).alias("edited"))
    pairs = with_fingerprint(pairs, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    likeness = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    rows = pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited_fingerprint").alias("near_edited"), likeness("next_fingerprint").alias("near_next"))
    groups = exact_groups(docs).withColumnsRenamed({"doc_id": "_id", "fingerprint": "_fp"})
    joined = rows.join(groups, rows.doc_id.eqNullSafe(groups["_id"]) & (rows.fingerprint == groups["_fp"]), "left").drop("_id", "_fp")
    return joined.withColumn("group_id", F.coalesce("group_id", "doc_id")).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
