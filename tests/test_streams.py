"""Conversation state on streams, against the operators over tables; late messages, timers and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.operators import conversation
from loomgraph.streaming import conversations

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, conversations.PROVIDER)
    yield spark
    spark.conf.set(key, was) if was else spark.conf.unset(key)


def messages(dice, n=8):
    yes, no = next(iter(fixed.CONFIRMATIONS)), "something else"
    rows = []
    for c in range(n):
        for t in range(dice.randint(1, 16)):
            role = ["user", "Assistant ", "system", None][dice.choice([0, 0, 1, 1, 1, 2, 3])]
            text = dice.choice([None, "", "  ", f"text {c} {t}", yes, no, f"please {fixed.CONFIRMATION_MARKER}", "x" * 900])
            rows.append((c, t, role, text))
    return rows


def run(spark, folder, batches, once=False, **options):
    """The rows of a stream that reads each of batches in a micro-batch of its own, restarted from its checkpoint for each."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        got = conversations.conversation_states(stream, **options)
        got.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(lambda df, n, i=i: df.write.mode("overwrite").parquet(f"{folder}/out/{i}-{n}")).trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination(60)
    out = spark.read.parquet(f"{folder}/out/*").collect()
    return {(r["conv_id"], r["turn"]): r for r in out if not r["late"]}, [(r["conv_id"], r["turn"]) for r in out if r["late"]]


def test_equals_tables_in_any_order_over_restarts(rocks, tmp_path):
    dice = random.Random(4)
    rows = messages(dice)
    mixed = dice.sample(rows, len(rows))
    third = len(mixed) // 3 + 1
    got, late = run(rocks, tmp_path, [mixed[:third], mixed[third : 2 * third], mixed[2 * third :]], last=4, chars=50)
    table = rocks.createDataFrame(rows, SCHEMA)
    assert len(got) == len(rows) and not late
    for r in conversation.with_confirmation(table).collect():
        assert got[r["conv_id"], r["turn"]]["confirmed"] == r["confirmed"]
    for r in conversation.with_intent(table).collect():
        assert got[r["conv_id"], r["turn"]]["intent"] == r["intent"]
    shown = {}
    for r in conversation.history_window(table, 4, 50).orderBy("turn").collect():
        shown.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for c, t in table.groupBy("conv_id").agg(F.max("turn")).collect():
        assert [tuple(x) for x in got[c, t]["history"]] == shown.get(c, [])


def test_a_timer_ends_the_wait_for_a_missing_turn(rocks, tmp_path):
    marker = f"do it? {fixed.CONFIRMATION_MARKER}"
    first = [(1, 0, "user", "go"), (1, 2, "assistant", marker), (1, 3, "user", next(iter(fixed.CONFIRMATIONS)))]
    got, late = run(rocks, tmp_path, [first, [(2, 0, "user", "x")], [(1, 1, "assistant", "too late"), (1, 4, "user", "end")]], once=True, patience=1)
    assert sorted(got) == [(1, 0), (1, 2), (1, 3), (1, 4), (2, 0)] and late == [(1, 1)]
    assert got[1, 3]["confirmed"] and not got[1, 2]["confirmed"]
