"""The pipeline's stages in order, on documents with nulls, repeats and clashing columns, against what each must keep."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import store
from evenkeel.llm.queries import CAPACITY, PACK_END, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit_id string, bad_id int, dropped_id int, kept boolean, k1 string"


def made():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    texts = {i: say(rng.integers(60, 140)) for i in range(80)}
    passage = say(14)
    texts |= {200: None, 201: "", 202: "too short", 203: "again and again " * 40, 204: " ".join(f"{w}$$$" for w in say(90).split())}
    texts |= {300: texts[4], 301: texts[5] + " more", 302: texts[6].upper()}  # copies of kept documents
    texts |= {400: f"{say(60)} {passage} {say(20)}", 401: f"{say(70)} {passage.upper().replace(' ', ', ')}"}
    texts |= {500: f"{say(60)} write to some.one@mail.example or +1 (743) 555-3824", 501: say(4_000)}
    rows = [(i, t, "en", "s", len(t or ""), "a", 1, 2, True, "b") for i, t in texts.items()]
    rows += [(None, say(80), "en", "s", 0, None, None, None, None, None), (None, f"{say(60)} {passage}", "en", "s", 0, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(7, say(90), "en", "s", 0, "a", 1, 2, True, "b")]  # another version of document 7
    return rows, passage


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, passage = made()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, f"{passage}."), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, after = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, folder), "stage")
        after.append([tuple(r) for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return folder, after


def ids(rows):
    return sorted((r[0] for r in rows), key=str)


def without(rows, *gone):
    return sorted((r[0] for r in rows if r[0] not in gone), key=str)


def test_the_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "packing"]


def test_each_stage_drops_what_it_must(stages):
    _, (docs, good, single, clean, safe, _) = stages
    assert ids(good) == [x for x in without(docs, 200, 201, 202, 203, 204) if x is not None] + [None, None]
    assert sorted(good, key=str) == sorted([r for r in docs if r in good], key=str)  # rows as they were
    assert ids(single) == without(good, 300, 301, 302)
    assert ids(clean) == [x for x in without(single, 400, 401) if x is not None] + [None]
    assert ids(safe) == ids(clean)
    text = {r[0]: r[1] for r in safe}
    assert text[500].endswith("write to <EMAIL> or <PHONE>")
    assert {(r[0], r[1]) for r in safe if r[0] != 500} == {(r[0], r[1]) for r in clean if r[0] != 500}
    assert all(r[4] == len(r[1]) for r in safe)


def test_packing_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    _, (*_, safe, packed) = stages
    plain = Tokenizer.from_file(vocabulary())
    want = []
    for doc_id, text, *_ in safe:
        tokens = [*plain.encode(text or "", add_special_tokens=False).ids, PACK_END]
        want += [(doc_id, k, low, len(tokens[low : low + CAPACITY]), zlib.crc32(np.array(tokens[low : low + CAPACITY], "<u4").tobytes())) for k, low in enumerate(range(0, len(tokens), CAPACITY))]
    assert sorted([r[:5] for r in packed], key=str) == sorted(want, key=str)
    by = {}
    for r in packed:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0, *(n for _, n in sorted(places))])[:-1]) and sum(n for _, n in places) <= CAPACITY
    assert len(by) <= 1.05 * sum(w[3] for w in want) / CAPACITY + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    folder, after = stages
    places = lambda rows: sorted((r[:5] for r in rows), key=str)
    assert places([tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]) == places(after[-1])


def test_empty_tables(spark, stages, tmp_path):
    folder, _ = stages
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_settings_stay_as_they_were(spark):
    assert all(spark.conf.get(k, None) is None for k in store.SETTINGS)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(Session)


def test_discarded_tables_are_gone(spark):
    import os

    table = store.written(spark.range(3), "some")
    assert os.path.isdir(table._stored_at.removeprefix("file:"))
    store.discard(table)
    assert not os.path.exists(table._stored_at.removeprefix("file:"))
    outside = spark.range(2).where(F.col("id") > 5)
    store.discard(outside)  # not a written table: nothing happens


def test_only_results_stay_behind(spark, stages):
    import glob

    folder, _ = stages
    root = store.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/evenkeel-*/*"))
    corpus_pipeline.run(spark, folder).count()
    left = set(glob.glob(f"{root}/evenkeel-*/*")) - before
    assert [x.rsplit("/", 1)[1] for x in left] == ["packing"]


def test_words_are_those_of_the_contract():
    assert re.fullmatch(r"[0-9a-z ]+", made()[1])
