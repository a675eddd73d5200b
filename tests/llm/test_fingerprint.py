import hashlib

from pyspark.sql import functions as F

from loomgraph.llm import fingerprint as fp


def canon(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["c"] for r in rows.select("i", fp.canonical(F.col("t")).alias("c")).orderBy("i").collect()]


def test_canonical(spark):
    assert canon(spark, "Ａé  ﬁ\tSTRASSE ß", None, " \n ", "É", "é", "A b C", "ǅ") == ["aé fi strasse ss", "", "", "é", "é", "a b c", "dž"]


def test_rows(spark, documents):
    texts = ["Abc def", "xyz", "abc  DEF", "", "q" * 11]
    got = {r["doc_id"]: r for r in fp.fingerprints(documents(texts)).collect()}
    for i, t in enumerate(texts):
        after, half = texts[(i + 1) % len(texts)], len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[2]["fingerprint"] and (got[2]["group_id"], got[2]["group_size"]) == (0, 2)
    assert got[1]["near_edited"] == 0.0 and got[3]["near_edited"] == 1.0


def test_odd(odd, spark):
    got = fp.fingerprints(odd).collect()
    assert len(got) == 8
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 7)}) == 1
    assert fp.fingerprints(odd.limit(0)).count() == 0


def test_one_row_is_its_own_next(documents):
    row = fp.fingerprints(documents(["abcd"])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and row["near_next"] == 1.0


def test_bytes_are_compared(documents, monkeypatch):
    monkeypatch.setattr(fp, "digest", lambda c: F.lit("equal"))
    groups = fp.exact_groups(documents(["a", "b", "A", "b", "c"])).collect()
    assert {(r["doc_id"], r["group_id"]) for r in groups} == {(0, 0), (2, 0), (1, 1), (3, 1), (4, 4)}
