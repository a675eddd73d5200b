"""Decisions that a model would take, behind one interface, with a deterministic offline provider.

A provider turns a request text into a reply text. Replies are asked for in Arrow batches, at most once a
row: callers write the result before they use it, as decide() does, so that a retry asks no one again.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches


class Provider(Protocol):
    def reply(self, task: str, request: str) -> str: ...


class Offline:
    """Rules in place of a model: capitalised words as entities, neighbours in a sentence as relations.

    most: how many names of a part become entities, the most frequent ones.
    """

    def __init__(self, most: int = 12):
        self.most = most

    def reply(self, task: str, request: str) -> str:
        return json.dumps(getattr(self, task)(request), ensure_ascii=False)

    def extract(self, text: str) -> dict:
        names = Counter(re.findall(r"[^\W\d_]{3,}", text))
        top = [w for w, _ in sorted(names.items(), key=lambda x: (-x[1], x[0])) if w[0].isupper()][: self.most]
        ids = {w: f"n{i + 1}" for i, w in enumerate(top)}
        seen, edges = set(), []
        for sentence in re.split(r"[.!?。！？]", text):
            some = [w for w in re.findall(r"[^\W\d_]{3,}", sentence) if w in ids]
            for a, b in zip(some, some[1:], strict=False):
                if a != b and (a, b) not in seen:
                    seen.add((a, b))
                    edges.append({"source": ids[a], "target": ids[b], "relation": "follows"})
        return {"nodes": [{"id": i, "name": w, "type": "term"} for w, i in ids.items()], "edges": edges}

    def strategy(self, text: str) -> dict:
        headings = len(re.findall(r"(?m)^第\S{1,8}[章节]", text))
        config = {"split_mode": "heading_regex", "primary_start_patterns": [r"^第\S{1,8}[章节].{0,80}$"]} if headings > 1 else {"split_mode": "fixed_length"}
        return {"executable_split_config": config}

    def ontology(self, text: str) -> dict:
        return {"entity_types": ["term"], "relation_types": ["follows"], "relations": [{"from": "term", "relation": "follows", "to": "term"}]}


def decide(rows: DataFrame, provider: Provider, task: str, request: str, path: str | None = None) -> DataFrame:
    """rows with reply and error: a failed request has an error and no reply, and fails no task.

    With a path the result is written there and read back.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for text in batch[request]:
                try:
                    replies.append(provider.reply(task, text or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    replies.append(None)
                    errors.append(str(e)[:500])
            yield batch.assign(reply=pd.Series(replies, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "reply string", "error string"])
    out = small_batches(rows).mapInPandas(each, schema)
    if path is None:
        return out
    out.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


REPLY = "nodes array<struct<id:string,name:string,canonical_name:string,type:string,description:string,evidence:string>>, edges array<struct<id:string,source:string,target:string,relation:string,description:string>>"


def extracted(decided: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of replies to `extract`, with the keys and ord."""
    from ..functions.json import json_candidate

    parsed = decided.withColumn("r", F.from_json(json_candidate(F.col("reply")), REPLY)).filter("r is not null")
    one = lambda name: parsed.select(*keys, F.posexplode(f"r.{name}").alias("ord", "x")).select(*keys, F.col("ord").cast("long").alias("ord"), "x.*")
    return one("nodes"), one("edges")
