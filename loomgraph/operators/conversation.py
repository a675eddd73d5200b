"""Conversations as message tables: (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse_space, plain, truncated



def _order():
    return Window.partitionBy("conv_id").orderBy("turn")


def is_clear_intent(message: Column, feature: Column | None = None) -> Column:
    """A chosen feature, or a message of two characters or more with one of the intent words."""
    text = F.lower(collapse_space(F.coalesce(message, F.lit(""))))
    word = text.rlike("|".join(fixed.INTENT_WORDS)) & (F.length(text) >= 2)
    return word if feature is None else (plain(feature) != "") | word


def bare_reply(message: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(message, F.lit("")), f"(?U){fixed.REPLY_PUNCTUATION}", ""))


def with_confirmation(messages: DataFrame, marker: str = fixed.CONFIRMATION_MARKER) -> DataFrame:
    """messages with confirmed: a reply of consent right after an assistant's request for it."""
    asked = (F.lower(plain(F.lag("role").over(_order()))) == "assistant") & F.coalesce(F.lag("text").over(_order()).contains(marker), F.lit(False))
    reply = bare_reply(F.col("text"))
    consent = reply.isin(*fixed.CONFIRMATIONS) | reply.rlike(f"^(?:{fixed.CONFIRMATION_PATTERN})\\z")
    return messages.withColumn("confirmed", F.coalesce(asked & consent, F.lit(False)))


def with_intent(messages: DataFrame, goal: str = "") -> DataFrame:
    """messages with intent: the latest non-blank user message before the preceding one, else the goal, else the message."""
    user = F.when((F.lower(plain(F.col("role"))) == "user") & (plain(F.col("text")) != ""), plain(F.col("text")))
    earlier = F.last(user, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -2))
    return messages.withColumn("intent", F.coalesce(earlier, F.nullif(F.lit(goal), F.lit("")), F.col("text")))


def history_window(messages: DataFrame, last: int = fixed.HISTORY_MESSAGES, chars: int = fixed.MESSAGE_CHARS) -> DataFrame:
    """The last messages of each conversation, then of those the user's and the assistant's, folded and cut."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("_n", newest).filter(F.col("_n") <= last).withColumn("role", F.lower(plain(F.col("role"))))
    rows = rows.filter(F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", "turn", "role", truncated(collapse_space(F.coalesce("text", F.lit(""))), chars).alias("text")).filter("text <> ''")


def section(label: str, text: Column, length: int | None = None) -> Column:
    """A labelled section, the text as it is or its first characters; null for null."""
    return F.concat(F.lit(f"{label}: "), text if length is None else truncated(text, length))


def prompt_context(title: Column, summary: Column, text: Column, goal: Column) -> Column:
    """Labelled sections of bounded length; blank ones are left out."""
    parts = [("title", title, 200), ("summary", summary, 1200), ("text", text, fixed.CONTEXT_CHARS), ("goal", goal, 800)]
    return F.concat_ws("\n", *[F.when(plain(c) != "", section(label, plain(c), n)) for label, c, n in parts])


def search(projects: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows in which the columns, joined by spaces, hold the query, whatever the case."""
    return projects.filter(F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower()))
