"""The quality rules: the model against a plain modified Kneser-Ney in Python, base columns against brute force, bands."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import quality


class Reference:
    """Interpolated modified Kneser-Ney over characters, by the textbook, with dicts."""

    def __init__(self, texts):
        n = quality.ORDER
        counts = {n: Counter(), **{k: Counter() for k in range(1, n)}}
        for text in texts:
            padded = " " * (n - 1) + text
            for i in range(n - 1, len(padded)):
                counts[n][padded[i - n + 1 : i + 1]] += 1
        for k in range(n - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.d, self.total, self.mass = counts, {}, {}, {}
        for k in range(1, n + 1):
            of = Counter(counts[k].values())
            y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.0
            self.d[k] = {j: max(0.0, min(float(j), j - (j + 1) * y * of[j + 1] / of[j] if of[j] else 0.5)) for j in (1, 2, 3)}
            self.total[k], self.mass[k] = Counter(), defaultdict(float)
            for g, c in counts[k].items():
                self.total[k][g[:-1]] += c
                self.mass[k][g[:-1]] += self.d[k][min(c, 3)]
        self.symbols = len(counts[1])

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (self.symbols + 1)
        context = gram[:-1]
        if not self.total[k][context]:
            return self.p(gram[1:])
        c = self.counts[k][gram]
        own = (c - self.d[k][min(c, 3)]) / self.total[k][context] if c else 0.0
        return own + self.mass[k][context] / self.total[k][context] * self.p(gram[1:])

    def log_perplexity(self, text):
        padded = " " * (quality.ORDER - 1) + text
        return -np.mean([math.log(self.p(padded[i : i + quality.ORDER])) for i in range(len(padded) - quality.ORDER + 1)])


def joined(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).lower()


@pytest.mark.parametrize("shard, held", [(quality.SHARD, quality.HELD_ENTRIES), (40, 60)])
def test_scores_match_a_plain_model_of_the_other_fold(spark, monkeypatch, shard, held):
    monkeypatch.setattr(quality, "SHARD", shard)
    monkeypatch.setattr(quality, "HELD_ENTRIES", held)
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 6)))
    rows = [(i, lang, " ".join(word(letters) for _ in range(rng.integers(5, 60)))) for i, (lang, letters) in enumerate([("en", "abcde"), ("fr", "abéç中"), (None, "xyZ")] * 8)]
    rows += [(90, "en", rows[0][2]), (91, "one", "only text here"), (92, "en", "##### $$$ a b ####"), (93, "en", None), (None, "en", "abc\tabd\nabe"), (None, "en", "ede")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    folds = {(r["lang"], r["text"]): r["fold"] for r in quality._rows(docs).select("lang", "text", "fold").collect()}
    models = {(lang, fold): Reference([joined(t) for (l, t), f in folds.items() if l == lang and f == fold and t and joined(t) and quality.plain(t)]) for lang in ("en", "fr", None, "one") for fold in (0, 1)}
    got = sorted(((r["doc_id"], r["log_perplexity"]) for r in quality.digest(docs).collect()), key=str)
    want = []
    for i, lang, text in rows:
        if not text:
            want.append((i, None))
            continue
        model = models[lang, 1 - folds[lang, text]]
        want.append((i, model.log_perplexity(joined(text)) if model.symbols else -quality.UNSEEN))
    for (i, a), (j, b) in zip(got, sorted(want, key=str)):
        assert i == j and (a is None) == (b is None) and (a is None or abs(a - b) < 2e-5), (i, a, b)


def test_base_columns_match_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = [None, "", " \t", "a", "a b c", "a b c a b c", "x\ny\n\nx\n x", "<|$|>#&%*", "a\u00a0b\u2028c\x1cd\x85e", "w " * 49 + "w", "long " * 20_000]
    texts += [" ".join(rng.choice(["a", "b", "c#", "dé\n", "e\ne"], rng.integers(1, 120))) for _ in range(60)]
    rows = spark.createDataFrame([(i, "en", t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, lang string, text string, key string, k1 int")
    got = {r["doc_id"]: r for r in quality.digest(rows).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat))
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_symbols_and_foreign_text_are_out_of_band(spark):
    rng = np.random.default_rng(1)
    say = lambda letters, n=150: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))
    rows = [(i, "en", say("etaoinsh"), 3) for i in range(60)]
    rows += [(100 + i, "en", " ".join(w + "$$$" for w in say("etaoinsh").split()), 3) for i in range(8)]
    rows += [(200, "en", say("qxzjkv"), 3), (201, "one", say("etaoinsh"), 3), (None, "en", say("etaoinsh"), 3), (None, "en", say("wbpyfg"), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, kept int")
    kept = [r["doc_id"] for r in quality.filter_quality(docs).collect()]
    assert sorted(kept, key=str) == sorted([*range(60), 201, None], key=str)
    assert quality.filter_quality(docs).columns == docs.columns


def test_copies_weigh_once_in_the_bands(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("etaoinshrdlu"))
    words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(300)]
    some = [" ".join(rng.choice(words, 200)) for _ in range(40)]
    hot = " ".join("".join(rng.choice(list("qzxjkv"), 6)) for _ in range(80))
    rows = [(i, "en", t) for i, t in enumerate([*some, *[hot] * 200])]
    plain = {r["doc_id"]: r for r in quality.digest(spark.createDataFrame(rows[:41], "doc_id long, lang string, text string")).collect()}
    got = {r["doc_id"]: r for r in quality.digest(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert len(got) == 240 and all(got[i]["kept"] for i in range(40))
    for i in range(41):
        assert abs(got[i]["log_perplexity"] - plain[i]["log_perplexity"]) < 1e-5 and got[i]["kept"] == plain[i]["kept"]
        assert abs(got[i]["lower"] - plain[i]["lower"]) < 1e-5 and abs(got[i]["upper"] - plain[i]["upper"]) < 1e-5
