"""Repeated values in JSON of any shape, against plain Python."""

import json
import random

import pytest

from loomgraph.operators.json_values import distinct_json


def text(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def clean(value, path="", in_field=False, found=None):
    """The clean value; found gets (path, before, after) of lists that lost values."""
    if isinstance(value, dict):
        return {k: clean(x, f"{path}.{k}".removeprefix("."), True, found) for k, x in value.items()}
    if not isinstance(value, list):
        return value
    parts = [clean(x, f"{path or '$'}[{i}]", False, found) for i, x in enumerate(value)]
    once = list({text(x): x for x in parts}.values())
    if in_field and len(once) < len(parts):
        found.append((path, len(parts), len(once)))
    return once if in_field else parts


def some(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return rng.choice([1, 2, "a", "a\"b\\\n", "é", "", True, None, -3, 2.5])
    if kind == 3:
        return {k: some(rng, depth - 1) for k in rng.sample(["b", "a", "k é", "x.y", 'q"'], rng.randrange(4))}
    return [some(rng, depth - 1) for _ in range(rng.randrange(9))]


def run(spark, texts):
    rows, report = distinct_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, json string"))
    number = {r["_row"]: r["n"] for r in rows.collect()}
    assert len(number) == len(texts)
    lost = {}
    for r in report.collect():
        assert r["removed"] == r["before"] - r["after"]
        assert r["path"].endswith(r["key"])
        lost.setdefault(number[r["_row"]], []).append((r["path"], r["before"], r["after"]))
    return {r["n"]: r["_clean"] for r in rows.collect()}, lost


def test_any_shape(spark):
    rng = random.Random(5)
    values = [{"a": some(rng, 4), "b": some(rng, 4)} for _ in range(150)]
    values += [{"t": [{"b": 1, "a": [1, 1, 2]}, {"a": [1, 2], "b": 1}]}, [[1, 1], [1, 1]], {"l": [[1, 1], [1, 1]]}, [], {}, {"e": []}, {"a": {"b": {"c": [None, None]}}}] * 2
    values += [{"long": ["x" * 3000, "y"] * 2000}]
    got, lost = run(spark, [json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)])
    for i, value in enumerate(values):
        found = []
        assert got[i] == text(clean(value, found=found)), value
        assert sorted(lost.get(i, [])) == sorted(found)
    assert sum(map(len, lost.values())) > 20


def test_odd_texts(spark):
    got, lost = run(spark, [None, "", "{", "nonsense", '{"a": 1, "a": [2, 2]}', "null", "3", '"s"', '{"n": [1, 1.0]}'])
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: "null", 6: "3", 7: '"s"', 8: '{"n":[1]}'}
    assert lost == {8: [("n", 2, 1)]}


def test_empty_and_clashing(spark):
    assert run(spark, []) == ({}, {})
    rows, _ = distinct_json(spark.createDataFrame([(1, 2, '{"v": [1, 1]}')], "key int, path int, v string"), "v")
    assert [(r["key"], r["path"], r["v"], r["_clean"]) for r in rows.collect()] == [(1, 2, '{"v": [1, 1]}', '{"v":[1]}')]
    with pytest.raises(ValueError, match="_row"):
        distinct_json(rows, "v")
