"""JSON out of free text: a reply may hold fences or words around its object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import uni_trim


def json_candidate(reply: Column) -> Column:
    """The text without code fences; if that isn't JSON, from its first { to its last }; else null."""
    bare = uni_trim(reply)
    bare = F.regexp_replace(bare, r"^```(?:json)?\s*", "")
    bare = uni_trim(F.regexp_replace(bare, r"\s*```\z", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(inner).isNotNull(), inner)


def recover_json(reply: Column) -> Column:
    """A variant, or null where no JSON is found."""
    return F.try_parse_json(json_candidate(reply))


def form_field(value: Column, schema: str) -> tuple[Column, Column]:
    """(parsed value, error text): a blank field is null without error."""
    blank = F.coalesce(F.trim(value) == "", F.lit(True))
    bad = ~blank & F.try_parse_json(value).isNull()
    return F.when(~blank & ~bad, F.from_json(value, schema)), F.when(bad, F.lit("not valid JSON"))
