"""Mixing sources to target weights, made with SQL functions alone.

Each source's target is its share by weight of 150 % of all words, held at twice the source's size;
what a full source can't take is shared again by weight. Targets become whole blocks of equal token
count by Sainte-Lague apportionment (seats go to the highest quotients target/(2k-1)): first over the
sources, then over groups of each source's shards, then over the shards of each group. Inside a shard,
documents stand in a seeded order as one run of words cut into blocks; a quota of q takes its first q
blocks, going round a second time if q exceeds the blocks there are. What whole blocks miss or exceed of a
source's target, and what a shard can't give within twice its words, is settled in single words by the
shards with room, in their order; so every source gives its target, rounded down, however small it is. No
document is taken more than twice, and reruns agree.

Shards follow the number of all documents, but a source has at most one for each BLOCKS_A_SHARD blocks of
its own words; its groups are about the square root of its shards, so no window holds all of them.

Defined results: a null text has size 0 and gets taken 0; a null source is a source of its own and
comes last; sources whose words are all missing get target 0; rows with equal doc_id are kept and
ordered by size; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, unused, written

WEIGHTS = (3, 1, 2)
BLOCKS_A_SHARD = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """votes with a column quota: seats (equal on all rows of a group) given by highest quotients.

    A divisor a little too large gives each party a number of seats that it surely gets, one a little
    too small a number that it surely doesn't exceed; only the few quotients between are ranked, so the
    work is in proportion to the parties and not to the seats. Ties go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    df = votes.withColumn("_v", F.sum(vote).over(whole)).withColumn("_n", F.count("*").over(whole))
    at = lambda seat: F.when(F.col("_v") > 0, F.floor(F.col(vote) / F.col("_v") * F.greatest(seat, F.lit(0)) + 0.5)).otherwise(0).cast("long")
    df = df.withColumn("_low", at(F.col(seats) - F.col("_n"))).withColumn("_high", at(F.col(seats) + F.col("_n")))
    df = df.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    between = df.filter((F.col("_high") > F.col("_low")) & (F.col("_left") > 0)).select(*group, *key, "_left", vote, F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(vote) / (2 * F.col("_k") - 1)), *key)
    won = between.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_left")).groupBy(*group, *key).agg(F.count("*").alias("_more"))
    return df.join(won, [*group, *key], "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_v", "_n", "_low", "_high", "_left", "_more")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (s_null, s, source_size: a row for each source) with rank and target.

    The level at which sources stop taking is found in one pass over the sources in the order in which
    they fill up; the number of sources is taken to be far below that of documents.
    """
    one = sizes.withColumn("_all", F.lit(0))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("_all").orderBy("s_null", "s")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size"))
    fill = Window.partitionBy("_all").orderBy(F.col("_cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("_all")
    ranked = ranked.withColumn("_free", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("_free") / F.col("_weights")
    # The first source that doesn't fill up sets the level for itself and all after it.
    ranked = ranked.withColumn("_level", F.min(F.when(F.col("_cap") > level * F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "rank", level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("weight")))
    return ranked.withColumn("target", target).drop("_all", "_cap", "_free", "_weights", "_level")


def _settled(rows: DataFrame, by: list[str], order: str, rest: Column) -> DataFrame:
    """rows (_words, _room) with _change: how the rest, positive or negative, falls on them one after another."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    part = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), n - so_far(c)))
    return rows.withColumn("_change", part("_room", rest) - part("_words", -rest))


def mix(docs: DataFrame, size: Column | None = None, block_tokens: int = 64, docs_per_shard: int = 512, seed: int = 17, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the columns to carry: a row for each row of docs."""
    shards = max(1, math.ceil(docs.count() / docs_per_shard))
    size = n_words(F.col("text")) if size is None else size
    sized = docs.select("doc_id", "source", size.alias("size"), F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    if not carry:  # so that texts are read once
        sized = written(sized, "mix-sizes")
    sized = sized.withColumn("_dice", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    sized = sized.withColumn("shard", F.conv(F.substring("_dice", 1, 8), 16, 10).cast("long") % shards)
    # Documents without words add nothing to a shard; where they are many they stay spread.
    sized = sized.withColumn("_some", F.coalesce(F.col("size") > 0, F.lit(False)))
    source, fine, group = ["s_null", "s"], ["shard", "_some"], ["s_null", "s", "_group"]
    # The tables of sources and shards are small beside the documents; each is made once.
    by_fine = written(sized.groupBy(*source, *fine).agg(F.sum("size").alias("fine_size")), "mix-fine")
    targets = source_targets(by_fine.groupBy(*source).agg(F.sum("fine_size").alias("source_size")), weights, share, most)
    everything = Window.partitionBy(F.lit(0))
    targets = targets.withColumn("_blocks", F.floor(F.sum("target").over(everything) / block_tokens + 0.5).cast("long")).withColumn("_one", F.lit(0))
    targets = sainte_lague(targets, ["_one"], ["rank"], "target", "_blocks").withColumnRenamed("quota", "source_blocks").drop("_one", "_blocks")
    targets = written(targets, "mix-targets")
    own_shards = F.greatest(F.lit(1), F.least(F.lit(shards), F.floor(F.col("source_size") / (block_tokens * BLOCKS_A_SHARD))))
    by_fine = by_fine.join(targets, source).withColumn("_own", F.when(F.col("_some"), F.col("shard") % own_shards).otherwise(F.col("shard")))
    by_fine = by_fine.withColumn("_group", F.col("_own") % F.ceil(F.sqrt(own_shards)))
    by_fine = written(by_fine, "mix-fine")
    by_shard = by_fine.groupBy(*group, "_own").agg(F.sum("fine_size").alias("shard_size"), *[F.first(c).alias(c) for c in ("source_size", "target", "source_blocks")])
    by_group = by_shard.groupBy(*group).agg(F.sum("shard_size").alias("group_size"), F.first("source_blocks").alias("source_blocks"))
    seats = sainte_lague(by_group, source, ["_group"], "group_size", "source_blocks").select(*group, F.col("quota").alias("group_blocks"))
    quotas = sainte_lague(by_shard.join(seats, group), group, ["_own"], "shard_size", "group_blocks").drop("group_blocks")
    quotas = written(quotas, "mix-quotas")
    room = F.floor(most * F.col("shard_size")).cast("long")
    quotas = quotas.withColumn("_words", F.least(F.col("quota") * block_tokens, room)).withColumn("_room", room - F.col("_words"))
    # The rest in words: first what each group adds or leaves out, then each shard.
    rest = quotas.groupBy(*group).agg(F.sum("_words").alias("_words"), F.sum("_room").alias("_room"), F.first("target").alias("target"))
    rest = rest.withColumn("_rest", F.floor("target").cast("long") - F.sum("_words").over(Window.partitionBy(*source)))
    rest = _settled(rest, source, "_group", F.col("_rest")).select(*group, F.col("_change").alias("_rest"))
    quotas = _settled(quotas.join(rest, group), group, "_own", F.col("_rest")).withColumn("_words", F.col("_words") + F.col("_change"))
    quotas = by_fine.select(*source, *fine, "_own").join(quotas.select(*source, "_own", "shard_size", "source_size", "target", "_words"), [*source, "_own"])
    run = Window.partitionBy(*source, "_own").orderBy(F.substring("_dice", 9, 24), "doc_id", "size")
    placed = sized.join(quotas, [*source, *fine]).withColumn("_end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.col("_words")
    lap = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), words - k * F.col("shard_size") - (F.col("_end") - F.col("size"))))
    taken = sum((lap(k) for k in range(1, math.ceil(most))), lap(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: whole copies, and of a partly taken document its first words.

    The columns are those of docs; of a cut text the words are joined by single spaces and n_chars is
    made to fit. Documents of which nothing is taken go.
    """
    # All columns of docs but these travel under names that the mix doesn't use.
    names = {c: c if c in ("doc_id", "source") else f"_docs_{c}" for c in docs.columns}
    whole, rest, copy, text = unused(names.values(), "whole", "rest", "copy", "text")
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    size = options.pop("size", None)
    size = n_words(F.col(names["text"])) if size is None else size
    rows = mix(plain, size, carry=tuple(n for c, n in names.items() if c not in ("doc_id", "source")), **options).filter("taken > 0")
    rows = rows.withColumn(whole, F.floor(F.col("taken") / F.col("size"))).withColumn(rest, (F.col("taken") % F.col("size")).cast("int"))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole) + F.when(F.col(rest) > 0, 1).otherwise(0))))
    part = F.col(copy) > F.col(whole)
    head = F.array_join(F.slice(F.regexp_extract_all(names["text"], F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(rest, F.lit(1))), " ")
    rows = rows.withColumn(text, F.when(part, head).otherwise(F.col(names["text"])))
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.length(text)).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])
