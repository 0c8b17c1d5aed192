"""Removal of repeated byte strings against brute force, and the run-length index against its definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import repeats, runindex


def strings_of(parts):
    return runindex.Strings(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))


small = st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=10)


@settings(max_examples=150, deadline=None)
@given(small)
def test_the_index_holds_the_transform(parts):
    strings = strings_of(parts)
    order = runindex.suffix_order(strings)
    suffix = lambda i: (bytes(strings.text[i : i + strings.left[i]]), i)
    assert order.tolist() == sorted(range(strings.n), key=suffix)
    index = runindex.RunIndex(strings)
    assert index.lengths.sum() == strings.n
    expanded = np.repeat(index.symbols, index.lengths)
    assert expanded.tolist() == [0 if i == 0 else int(strings.text[i - 1]) for i in order.tolist()]


@settings(max_examples=150, deadline=None)
@given(small, st.integers(1, 9))
def test_matching_statistics(parts, least):
    strings = strings_of(parts)
    order = runindex.suffix_order(strings).tolist()
    text = bytes(strings.text)
    want = {}
    for before, i in zip(order, order[1:]):
        n = 0
        while n < min(strings.left[before], strings.left[i]) and text[before + n] == text[i + n]:
            n += 1
        if n >= least:
            want[i] = before
    start, source, count = runindex.RunIndex(strings).statistics(least)
    assert {s + k: t + k for s, t, c in zip(start.tolist(), source.tolist(), count.tolist()) for k in range(c)} == want
    seen, again = set(), []
    for low, part in zip(strings.low.tolist(), parts):
        for p in range(len(part) - least + 1):
            if part[p : p + least] in seen:
                again.append(low + p)
            seen.add(part[p : p + least])
    assert runindex.repeated(strings, least).tolist() == again


def test_a_repetitive_text_has_few_runs():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 123, 2_000).astype(np.uint8)
    copies = [base.copy() for _ in range(40)]
    for c in copies:
        c[rng.integers(0, len(c), 3)] = 65
    index = runindex.RunIndex(strings_of([c.tobytes() for c in copies]))
    assert len(index.lengths) < index.n / 15


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows in their order, by every window of every text."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        own = [raw[p : p + 100] for p in range(len(raw) - 99)]
        for p, w in enumerate(own):
            if w in seen:
                cut[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        out.append((doc_id, len(raw), sum(cut), spans, hashlib.sha256(bytes(b for b, c in zip(raw, cut) if not c)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed: int):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 120))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 450), (4, "ab" * 300 + "\0" * 130), (None, passages[0]), (None, passages[1] * 2), (None, passages[0])]
    for i in range(60):
        text = " ".join(rng.choice([word(), word(), rng.choice(passages), passages[0][rng.randrange(100) :]]) for _ in range(rng.randrange(1, 14)))
        rows.append((rng.choice([i + 5, i + 5, 7, None]), text))
    rows.append((9, "v" * 250))
    rows += [(5, passages[2]), (5, passages[2] + passages[3]), (90, " ".join(passages) * 3)]
    return rows


@pytest.mark.parametrize("hot, bucket", [(4_000, 2 << 20), (4_000, 2_000), (1, 2_000)])
def test_against_every_window(spark, monkeypatch, hot, bucket):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    rows = corpus(hot + bucket)
    docs = spark.createDataFrame([(i, t, 5, "clash", 1) for i, t in rows], "doc_id long, text string, row int, spans string, at int").coalesce(1)
    out = repeats.remove(docs, keep_text=True).collect()
    assert sorted([tuple(r)[:5] for r in out], key=str) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_unique_bytes_stay_where_ids_repeat(spark):
    v, w = "v" * 40 + "".join(chr(97 + i % 23) for i in range(300)), "".join(chr(97 + i * i % 25) for i in range(400))
    for rows in ([(0, v), (5, w), (5, v + v)], [(1, v), (2, v), (2, w)], [(None, v), (None, w), (None, v)]):
        got = repeats.remove(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
