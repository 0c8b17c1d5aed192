"""The license scan against every window of every text."""

import numpy as np
import pytest

from evenkeel.llm import licenses, shingles


def shingle_rows(text, template):
    words = licenses.words_of(text)
    size = min(shingles.SIZE, template.words)
    return shingles.runs(shingles.word_hashes(words), size) if len(words) >= size else np.empty(0, np.uint64)


def best_window(text, template):
    """The most distinct shingles of the template in any window of the text."""
    runs = shingle_rows(text, template)
    own = set(template.runs.tolist())
    return max((len(own & set(runs[p : p + template.window].tolist())) for p in range(max(1, len(runs) - template.window + 1))), default=0)


def damaged(rng, words, rate):
    return [w if rng.random() > rate else f"x{rng.integers(1000)}" for w in words]


def test_no_window_is_missed():
    """Recall over windows of every containment: all that hold three quarters are found, and nothing else."""
    rng = np.random.default_rng(9)
    known = licenses.templates()
    short = [t for t in known if t.words < 400]
    texts = dict(zip(map(id, known), [x for _, x in licenses.builtin()]))
    found = missed = wrong = 0
    for round_ in range(160):
        template = short[rng.integers(len(short))]
        words = texts[id(template)].split()
        body = damaged(rng, words, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))
        cut = int(len(body) * rng.choice([1, 1, 0.9, 0.76, 0.7]))
        filler = [f"f{rng.integers(500)}" for _ in range(rng.integers(0, 120))]
        text = " ".join(filler + body[:cut] + filler[::-1])
        one = licenses.Known([template])
        hits = licenses.matches(text, one)[1]
        best = best_window(text, template)
        if licenses.OF * best >= licenses.NEED * len(template.runs):
            found += bool(hits)
            missed += not hits
            assert not hits or max(c for _, _, c in hits) == best / len(template.runs)
        else:
            wrong += bool(hits)
    assert (missed, wrong) == (0, 0) and found > 60


def test_every_occurrence_is_a_match():
    known = licenses.templates()
    mit, notice = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    text = f"file one {mit} and some words then {mit} more words {notice} the end {mit}"
    words = licenses.words_of(text)
    got = licenses.matches(text, known)[1]
    assert sorted((name, at) for name, at, _ in got) == sorted([("MIT", i) for i in range(len(words)) if words[i : i + 5] == licenses.words_of(mit)] + [("Apache-2.0", words.index(b"licensed"))])
    full = dict(licenses.builtin())["MPL-2.0"]
    twice = licenses.matches(f"{full}\n some other words here \n{full}", licenses.templates([("MPL-2.0", full)]))[1]
    assert [name for name, _, _ in twice] == ["MPL-2.0"] * 2 and all(c > 0.99 for _, _, c in twice)


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("own-1", "You may use this thing as you like until the next full moon."), ("own-1", None), (None, "x"), ("empty", " ")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "Note: you may use this THING as you like, until the next full moon!", "MIT"), (None, "Released under the MIT License.", ""), (3, None, ""), (4, "", "")], "doc_id long, text string, license string")
    got = {r["doc_id"]: [m["license"] for m in r["matches"]] for r in licenses.scan(docs, table).collect()}
    assert got == {1: ["own-1"], None: [], 3: [], 4: []}
    assert all(not r["matches"] for r in licenses.scan(docs, table.limit(0)).collect())


def test_a_table_that_is_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        licenses.scan(spark.range(1).selectExpr("id as doc_id", "'a' as text"), spark.createDataFrame([("a", "more than ten bytes")], "license_id string, text string"))
