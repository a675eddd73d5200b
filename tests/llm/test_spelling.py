import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import spelling


def near(u, v):
    """One inserted, deleted or replaced code point."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(n):
    found = []
    for w in n:
        some = [x for x in n if near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        found.append([w, form, n[w], len(some), n[form] if form else None])
    forms = {w: f for w, f, *_ in found}
    for row in found:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, found), key=str)


def got(rows):
    return sorted(((r["word"], r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in rows.collect()), key=str)


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("ab", min_size=3, max_size=3)), st.sets(st.text("abc", min_size=4, max_size=4)))
def test_composition(short, long):
    found = [frozenset(p) for p in spelling.pairs_of(sorted(short), sorted(long), True)]
    want = {frozenset((u, v)) for u in short for v in short | long if near(u, v)}
    assert len(found) == len(set(found)) and set(found) == want


def test_acceptors_are_minimal():
    acceptors = spelling.Acceptors()
    acceptors.add(sorted(a + b + c for a in "xyz" for b in "pq" for c in "mn"))
    assert len(acceptors.arcs) == 4  # one state a place, however many words


def test_partitions_and_forms(spark):
    dice = random.Random(3)
    words = {"".join(dice.choice("ab") for _ in range(dice.randint(3, 8))) for _ in range(160)} | {"stem" + a + b for a in "abcdef" for b in "abcdef"}
    n = {w: 5 ** dice.randint(1, 6) for w in words}
    rows = spark.createDataFrame(sorted(n.items()), "word string, n long")
    for most in (20_000, 3):
        assert got(spelling.variants(rows, most=most)) == expected(n)
        pairs = [(r["word"], r["other"]) for r in spelling.near_pairs(rows, most).collect()]
        assert len(pairs) == len(set(pairs))


def test_documents(spark, documents):
    texts = ["Colour colour colours, colour; colours Müller-muller MÜLLER ", None, "", "12 ab!", "colour colouur " * 40 + "Muller " * 30, "x" * 100_000 + " coloor " * 6, "Ünlike ünlike ÷ünlike "] * 3
    rows = [(None if i == 4 else i, t, None, None) for i, t in enumerate(texts)] + [(0, texts[0], None, None)]
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                n[word] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    docs = documents(rows, "word")
    assert len(n) > 4 and got(spelling.spelling(docs)) == expected(n)
    assert spelling.spelling(docs.limit(0)).count() == 0


def test_deleted_code_points(spark, documents):
    texts = [(i, "wonderful müßiggang", None, None) for i in range(900)]
    found = spelling.runs(documents(texts))
    got_ = Counter(r["w"] for r in found.select(spelling.misspelt(found["id"], found["run"]).alias("w")).collect())
    want = Counter()
    for i, *_ in texts:
        for run in ("wonderful", "müßiggang"):
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert got_ == want and len(want) > 2
