import collections
import math
import zlib

import numpy as np

from loomgraph.llm import lm


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() + [None]


def expect(rows):
    train = collections.Counter(t for i, text in rows for t in tokens(text) if zlib.crc32(str(i).encode()) % 7 != 2)
    n, v = sum(train.values()), len(train)
    return n, {i: (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_base_score(documents):
    rows = [(i, " ".join(f"W{(i * k) % 17}" for k in range(i % 9))) for i in range(60)]
    n, want = expect(rows)
    got = {r["doc_id"]: r for r in lm.score(documents([(i, t, "en", "a") for i, t in rows])).collect()}
    for i, (size, known, base) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert abs(r["base_score"] - base) < 1e-9 and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_model_is_a_distribution(documents):
    rows = documents(["a b a c", "b a b", "a a d"] * 20)
    model, _ = lm.train(rows)
    words = ["a", "b", "c", "d", None]
    probe = lm.tokens(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7]))
    assert model.n_tokens == 13 * 20 and model.n_distinct == 5
    own = 10 ** model.log_probabilities(*probe)
    assert ((own > 0) & (own < 1)).all() and len(own) == len(words)


def test_filter_gives_counts_back():
    some = np.random.default_rng(1).integers(0, 2**63, 3000, dtype=np.uint64)
    counts = np.random.default_rng(2).geometric(0.3, 3000)
    levels = lm.level(counts)
    f = lm.Filter(1, int(levels.sum() * lm.PROBES / -math.log(1 - lm.FILL)))
    f.data = np.frombuffer(f.segment(some, levels), np.uint8)
    found = f.levels(some)
    assert (found >= levels).all() and (found == levels).mean() > 0.98
    assert (f.levels(np.arange(10**6, 10**6 + 3000, dtype=np.uint64)) > 0).mean() < 0.03


def test_model_beats_base_on_repeated_phrases(documents):
    text = " ".join(f"k{i % 50} l{(i * 7) % 50}" for i in range(400))
    got = lm.score(documents([text + f" end{i}" for i in range(40)])).filter("held_out").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_probabilities_of_all_next_words_sum_to_one(documents):
    """Over all known words, the end, and one unseen word, after each of them."""
    model, _ = lm.train(documents(["a b a c", "b a b", "a a d", "d"] * 5))
    hashed = {w: lm.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in "abcdz"} | {None: lm.END}
    for before in (*"abcd", None):
        own = np.array([hashed[w] for w in hashed], np.uint64)
        both = lm.mix(np.full(len(own), hashed[before], np.uint64) * lm._PAIR[0] + own * lm._PAIR[1])
        h = float(model.counts(lm.WORD, np.array([hashed[before]], np.uint64))[0])
        plain = (model.counts(lm.WORD, own) + 1) / (model.n_tokens + model.n_distinct + 1)
        p = (np.minimum(model.counts(lm.PAIR, both), h) + lm.MU * plain) / (h + lm.MU)
        assert abs(p.sum() - 1) < 0.125  # a level stands for counts up to an eighth off


def test_score_against_exact_counts(documents):
    """The model by dictionaries, with counts quantised as the filter's levels are."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 13}" for k in range(i % 20)), "en", "a") for i in range(80)] + [(200, None, "en", "a"), (201, "", "en", "a"), (202, "unseen words here", "en", "a")]
    train = [tokens(t) for i, t, _, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(w for t in train for w in t), collections.Counter(p for t in train for p in zip([None, *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    about = lambda c: float(lm.COUNT[lm.level(np.array([c]))[0]]) if c else 0.0
    got = {r["doc_id"]: r["score"] for r in lm.score(documents(rows)).collect()}
    for i, text, _, _ in rows:
        want = sum(math.log10((min(about(two[a, b]), about(one[a])) + lm.MU * (about(one[b]) + 1) / (n + v + 1)) / (about(one[a]) + lm.MU)) for a, b in zip([None, *tokens(text)], tokens(text), strict=False))
        assert abs(got[i] - want) < 0.01 * abs(want) + 0.02, i


def test_odd(odd):
    got = lm.score(odd).collect()
    assert len(got) == 8 and lm.score(odd.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 1, 2, 2, 2, 7, 40_001] and all(r["score"] < 0 for r in got)


def test_all_pairs_are_stored(documents, monkeypatch):
    """Pairs seen once count, and a text's score is that of the model of all n-grams however many groups and buckets there are."""
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 211}" for k in range(60)), "en", "a") for i in range(50)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    model, _ = lm.train(documents(train))
    hashed = {i: lm.tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])) for i, x, _, _ in rows}
    assert all((model.counts(lm.PAIR, lm.pairs(*hashed[i])) >= 1).all() for i, _, _, _ in train)
    want = {i: model.log_probabilities(*t).sum() for i, t in hashed.items()}
    for group, bucket in ((2_000_000, 2_000_000), (200, 100)):
        monkeypatch.setattr(lm, "GROUP", group)
        monkeypatch.setattr(lm, "BUCKET", bucket)
        got = {r["doc_id"]: r["score"] for r in lm.score(documents(rows)).collect()}
        assert all(abs(got[i] - want[i]) < 0.02 * abs(want[i]) for i in want)


def test_those_who_probe_have_no_counts(documents):
    """Questions hold hashes alone, also of n-grams that training hasn't seen; all else comes from the written segments."""
    rows = documents([(i, f"a b c{i} d a b", "en", "a") for i in range(30)])
    parts = lm.written(lm.groups(rows.select("doc_id", lm.held_out(rows["doc_id"], 7, 2).alias("held_out"), "text")), "lm-groups")
    asked, model = lm.questions(parts, 16), lm.segments(parts, 16)
    assert asked.columns == ["kind", "bucket", "data", "g"]
    sent = sum(len(r["data"]) // 8 for r in asked.filter("kind = 1").collect())
    distinct = {w for i in range(30) for w in ("a", "b", "d", f"c{i}", None)}
    assert sent >= len(distinct)
    told = {r["bucket"]: r for r in model.filter("kind = 1").collect()}
    assert sum(r["n_distinct"] for r in told.values()) < len(distinct) and sum(r["n_tokens"] for r in told.values()) == 7 * sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(30))
    # Without the segments no group learns anything.
    none = lm.answers(asked, model.limit(0)).collect()
    assert none and all(set(r["levels"]) <= {0} for r in none)
