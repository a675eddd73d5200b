import itertools
import math
import random

from loomgraph.llm import licenses


SHORT = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_base(documents):
    texts = ["All rights RESERVED. x all-rights reserved", "cc by cc by-nc", "General  Public\nLicense", "ccby", "all rights", None, "é all rights reserved"]
    got = {r["doc_id"]: r for r in licenses.scan(documents(texts)).collect()}
    assert [(got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) for i in range(7)] == [
        (7, 2, 0, 4, "reserved"), (5, 2, 0, 2, "cc-by"), (3, 1, 0, 0, "gpl"), (1, 0, None, None, ""), (2, 0, None, None, ""), (0, 0, None, None, ""), (4, 1, 1, 1, "reserved"),
    ]


def test_join_equals_comparing_all_pairs(documents):
    pool = "licensed under the apache license version mit released general public work is this cc by nc other words".split()
    blocks = [" ".join(c) for n in (3, 5, 7) for c in itertools.islice(itertools.combinations(pool, n), 0, None, 97)]
    templates = SHORT
    docs = documents(["\n".join(blocks[i : i + 20]) for i in range(0, len(blocks), 20)])
    for threshold in (0.5, 0.8, 1.0):
        got = {(r["doc_id"], b["line"], b["label"]) for r in licenses.scan(docs, templates, {}, threshold).collect() for b in r["blocks"]}
        sides = {k: set(licenses.words(v)) for k, v in templates.items()}
        want = {(i // 20, i % 20, k) for i, b in enumerate(blocks) for k, s in sides.items() if len(s & set(licenses.words(b))) >= math.ceil(threshold * len(s) - 1e-9)}
        assert got == want


def test_templates_are_found_in_themselves(documents):
    docs = documents([f"before\n{t}\nafter" for t in licenses.TEMPLATES.values()])
    for label, r in zip(licenses.TEMPLATES, licenses.scan(docs).orderBy("doc_id").collect(), strict=True):
        assert label in r["labels"].split(",") and r["score"] == 1.0


def test_whole_bodies_wrapped_and_changed(documents):
    """License bodies inside other text, wrapped anew, with names put in and a few words lost; and text that only looks alike."""
    dice = random.Random(3)
    filler = " ".join(f"filler{i}" for i in range(80))
    texts, want = [], []
    for label in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "gpl-2.0-or-later", "gpl-3.0-or-later", "mpl-2.0", "cc-by-4.0"):
        words = licenses.TEMPLATES[label].split()
        told = {w for x in licenses.TELLING[label] for w in x.split()}
        changed = [w for w in words if dice.random() > 0.04 or told & {x.decode() for x in licenses.words(w)}]
        changed.insert(len(changed) - 3, "Acme")
        texts.append(filler + "\n" + "\n".join("# " + " ".join(changed[i : i + 7]) for i in range(0, len(changed), 7)) + "\n" + filler)
        want.append(label)
    texts.append(" ".join(f"{w} {x}" for w, x in zip(licenses.TEMPLATES["mit"].split(), itertools.cycle("a b c d".split()))) * 1 + filler)  # spread over twice the length and more
    texts.append(" ".join(licenses.TEMPLATES["mit"].split()[:60]))
    got = [r["labels"].split(",") for r in licenses.scan(documents(texts)).orderBy("doc_id").collect()]
    assert all(label in some for label, some in zip(want, got, strict=False))
    assert "mit" not in got[-1]


def test_ties_repeats_and_nulls(documents):
    same = licenses.TEMPLATES["mpl-2.0"]
    got = licenses.scan(documents([(1, same, "", ""), (1, same, "", ""), (None, same, "", ""), (2, None, "", "")])).collect()
    assert sorted((r["doc_id"] or 0, r["labels"], r["score"]) for r in got) == [(0, "mpl-2.0", 1.0), (1, "mpl-2.0", 1.0), (1, "mpl-2.0", 1.0), (2, "", 0.0)]


def test_odd(odd):
    got = licenses.scan(odd).collect()
    assert len(got) == 8 and all(r["score"] == 0 for r in got) and licenses.scan(odd.limit(0)).count() == 0


def test_wrapped_notices_and_long_lines(documents):
    templates = {"mit-grant": " ".join(licenses.TEMPLATES["mit"].split()[:19]), "mit": SHORT["mit"]}
    grant = templates["mit-grant"].split()
    filler = [f"w{i}" for i in range(200)]
    scattered = filler[:50] + ["released"] + filler[:50] + ["under", "the"] + filler[:50] + ["mit"] + filler + ["license", "w"]
    texts = ["\n".join(" * " + " ".join(grant[i : i + n]) for i in range(0, len(grant), n)) for n in (1, 4, 13)]
    texts += [" ".join(scattered), " ".join([*scattered, *"released under the mit license".split(), *filler]), "a\n".join(scattered)]
    got = licenses.scan(documents(texts), templates).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit-grant"] * 3 + ["", "mit", ""] and [r["score"] for r in got] == [1.0, 1.0, 1.0, 0.0, 1.0, 0.0]
    assert [(r["first"], r["last"]) for r in got[4]["runs"]] == [(len(scattered), len(scattered) + 4)]


def test_runs_equal_trying_every_window(documents):
    pool = "licensed under the apache license version mit released x1 x2 x3 x4 x5 x6 x7 cc by nc 4 0 2".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choice(pool) + rng.choice(["", "\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    templates = {k: v for k, v in SHORT.items() if k != "gpl-3.0"}
    sides = {k: (set(licenses.words(v)), licenses.SPREAD * len(licenses.words(v))) for k, v in templates.items()}
    for threshold in (0.6, 0.8):
        for r, text in zip(licenses.scan(documents(texts), templates, {"no such": "no"}, threshold).orderBy("doc_id").collect(), texts, strict=True):
            some, want = licenses.words(text), {}
            for k, (side, span) in sides.items():
                most = max((len(side & set(some[i : i + span])) for i in range(len(some))), default=0)
                if most >= math.ceil(threshold * len(side) - 1e-9):
                    want[k] = most / len(side)
            assert r["labels"] == ",".join(sorted(want)) and r["score"] == max(want.values(), default=0)
            assert all(x["last"] - x["first"] < sides[x["label"]][1] for x in r["runs"])


def test_each_template_is_meant_by_itself_alone(documents):
    """Whole notices, wrapped anew: the label is that of the notice, and of the short notice that stands in it."""
    labels = list(licenses.TEMPLATES)
    got = licenses.scan(documents(["a b\n" + " ".join(licenses.TEMPLATES[x].split()) + " c d" for x in labels])).orderBy("doc_id").collect()
    inside = {"apache-2.0": {"short-apache-2.0"}}
    base = {"general public license": "gpl", "cc by": "cc-by"}
    for label, r in zip(labels, got, strict=True):
        assert set(r["labels"].split(",")) - set(base.values()) == {label} | inside.get(label, set())


def test_near_misses_are_not_labelled(documents):
    texts = {
        "Licensed under the Apache License, Version 2.0.": "short-apache-2.0",
        "Released under the MIT License.": "short-mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,short-gpl-3.0",
        "Licensed under the GNU General Public License, version 2": "gpl",
        "Licensed under the Apache License, Version 2.1": "",
        "Licensed under the Apache License, Version 1.1": "",
        "This is licensed under the license of the museum": "",
        "This work is licensed under the terms of the license, version 3": "",
        "Released under the XYZ License.": "",
        "SPDX-License-Identifier: BSD-3-Clause": "",
        "SPDX-License-Identifier: MIT": "spdx-mit",
    }
    got = licenses.scan(documents(list(texts))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == list(texts.values())


def test_telling_phrases_in_runs_equal_trying_every_window(documents):
    pool = "licensed under the apache license version mit released x1 x2 x3 2 0".split()
    rng = random.Random(7)
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(70))) for _ in range(120)]
    templates = {"a": SHORT["apache-2.0"], "m": SHORT["mit"]}
    telling = {"a": ["apache license", "2 0"], "m": ["the mit"]}
    for threshold in (0.6, 0.8):
        for r, text in zip(licenses.scan(documents(texts), templates, {"no such": "no"}, threshold, telling).orderBy("doc_id").collect(), texts, strict=True):
            some, want = licenses.words(text), {}
            for k, v in templates.items():
                side, span = set(licenses.words(v)), licenses.SPREAD * len(licenses.words(v))
                fits = lambda i, k=k, span=span, some=some: all(b" " + x.encode() + b" " in b" " + b" ".join(some[i : i + span]) + b" " for x in telling[k])
                most = max((len(side & set(some[i : i + span])) for i in range(len(some)) if fits(i)), default=0)
                if most >= math.ceil(threshold * len(side) - 1e-9):
                    want[k] = most / len(side)
            assert r["labels"] == ",".join(sorted(want)) and abs(r["score"] - max(want.values(), default=0)) < 1e-12
            for x in r["runs"]:
                run = b" " + b" ".join(some[x["first"] : x["last"] + 1]) + b" "
                assert all(b" " + t.encode() + b" " in run for t in telling[x["label"]])
