"""What a conversation remembers, kept as state over a stream of its messages.

Messages (conv_id, turn, role, text) may come in any order and in any micro-batches. Each conversation's state holds
its last messages, whether the assistant has just asked for confirmation, and what the user said before that;
a message is handled once all turns before it have been. One that waits for a missing turn waits for `patience` at
most: then a timer lets those that wait go on in their order, and what comes too late for its place is reported as
late and changes nothing. So while nothing is late, a stream gives the rows that the operators over tables give.

What only needs the message itself is done by columns in front of the state; the state's own step is a few assignments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.text import collapse_space, plain, truncated
from ..operators.conversation import bare_reply
from ..sources.tables import shared_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = ["turn", "role", "text", "said", "shown", "asks", "consents"]
STATE = "turn long, role string, text string, said string, shown string, asks boolean, consents boolean"
OUT = "conv_id long, turn long, role string, confirmed boolean, intent string, history array<struct<turn: long, role: string, text: string>>, late boolean"


def _described(messages: DataFrame, marker: str, chars: int) -> DataFrame:
    """conv_id and MESSAGE: said is a user's text, shown the text as history shows it."""
    text, role = F.col("text"), F.lower(plain(F.col("role")))
    reply = bare_reply(text)
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), "text",
        F.when((role == "user") & (plain(text) != ""), plain(text)).alias("said"), truncated(collapse_space(F.coalesce(text, F.lit(""))), chars).alias("shown"),
        F.coalesce((role == "assistant") & text.contains(marker), F.lit(False)).alias("asks"), F.coalesce(reply.isin(*fixed.CONFIRMATIONS) | reply.rlike(f"^(?:{fixed.CONFIRMATION_PATTERN})\\z"), F.lit(False)).alias("consents"),
    )


class Conversation(StatefulProcessor):
    def __init__(self, goal: str, last: int, first: int, patience: int):
        self.goal, self.last, self.first, self.patience = goal, last, first, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, asked boolean, earlier string, before string")
        self.recent = handle.getListState("recent", "turn long, role string, text string")
        self.waiting = handle.getListState("waiting", STATE)

    def _step(self, key: tuple, fresh: list[tuple], now: int, flush: bool) -> pd.DataFrame:
        turn, asked, earlier, before = self.place.get() if self.place.exists() else (self.first, False, None, None)
        held = sorted([*(tuple(x) for x in self.waiting.get()), *fresh], key=lambda x: x[0])
        recent = [tuple(x) for x in self.recent.get()]
        out, rest = [], []
        for at, role, text, said, shown, asks, consents in held:
            if at < turn:
                out.append((key[0], at, role, False, None, [], True))
                continue
            if at > turn and not flush:
                rest.append((at, role, text, said, shown, asks, consents))
                continue
            recent = [*recent, (at, role, shown)][-self.last :]
            history = [dict(zip(("turn", "role", "text"), x, strict=True)) for x in recent if x[1] in ("user", "assistant") and x[2]]
            intent = earlier if earlier is not None else self.goal or text
            out.append((key[0], at, role, bool(asked and consents), intent, history, False))
            turn, asked, earlier, before = at + 1, bool(asks), before if before is not None else earlier, said
        self.place.update((turn, asked, earlier, before))
        self.recent.put(recent) if recent else self.recent.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        timers = [x[0] if isinstance(x, tuple) else x for x in self.handle.listTimers()]
        if rest and not timers:
            self.handle.registerTimer(now + self.patience)
        elif not rest:
            for x in timers:
                self.handle.deleteTimer(x)
        return pd.DataFrame(out, columns=["conv_id", "turn", "role", "confirmed", "intent", "history", "late"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [tuple(None if x is None or x != x else x for x in r) for some in rows for r in some[MESSAGE].itertuples(index=False)]
        yield self._step(key, fresh, timerValues.getCurrentProcessingTimeInMs(), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._step(key, [], timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def conversation_states(messages: DataFrame, goal: str = "", last: int = fixed.HISTORY_MESSAGES, chars: int = fixed.MESSAGE_CHARS, marker: str = fixed.CONFIRMATION_MARKER, first: int = 0, patience: int = 600_000) -> DataFrame:
    """conv_id, turn, role, confirmed, intent, history, late of a stream of messages, a row for each message.

    confirmed and intent are those of conversation.with_confirmation() and with_intent(); history is what
    conversation.history_window() shows after the message. Turns count up by one from `first`; patience is in
    milliseconds. A turn that comes again is late. The session must keep its state in RocksDB (PROVIDER).
    """
    rows = _described(messages, marker, chars)
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(goal, last, first, patience), OUT, "Append", "ProcessingTime")


def run_to_end(states: DataFrame) -> DataFrame:
    """The rows of conversation_states() for all messages that are there now, as a table in the shared folder."""
    spark, key = states.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    out, was = shared_path(spark, "states"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, PROVIDER)
    try:
        # One batch, as a timer of a conversation that waits for a turn would keep a run over all batches going.
        query = states.writeStream.option("checkpointLocation", shared_path(spark, "checkpoint")).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(once=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    return spark.read.schema(states.schema).parquet(out)
