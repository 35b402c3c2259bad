"""Language model and quality classifier against plain Python."""

import math
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import language_model, quality
from tidegauge.llm.common import hash_words, split_words, write_file


def off(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [0, *[d if 0 < d < k + 1 else (0.5, 1.0, 1.5)[k] for k, d in enumerate(raw)]]


class Plain:
    """The definition: raw counts at the highest order, different words before an n-gram below it."""

    def __init__(self, token_lists, order=3):
        self.order, grams, self.uni = order, Counter(), Counter()
        for w in token_lists:
            self.uni.update(w)
            grams.update(self.grams(w))
        self.levels = []
        while True:
            total, left, d = Counter(), Counter(), off(grams.values())
            for g, c in grams.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3)]
            self.levels.insert(0, (grams, d, total, left))
            if len(self.levels) == order:
                break
            grams = Counter(g[1:] for g in grams)
        self.v, self.n = len(self.uni), sum(self.uni.values())

    def grams(self, w):
        whole = ["<s>"] * (self.order - 1) + w
        return [tuple(whole[k : k + self.order]) for k in range(len(w))]

    def score(self, w):
        s = 0.0
        for gram in self.grams(w):
            p = 1 / (self.v + 1)
            for k, (grams, d, total, left) in enumerate(self.levels):
                own = gram[self.order - 1 - k :]
                if total[own[:-1]]:
                    c = grams.get(own, 0)
                    p = (max(c - d[min(c, 3)], 0) + left[own[:-1]] * p) / total[own[:-1]]
            s += math.log10(p)
        return s


def held(k):
    return zlib.crc32(str(k).encode()) % 10 == 0


@pytest.mark.parametrize("order", [2, 3])
def test_scores(documents, texts, order):
    tokens = {k: [*(t or "").encode().lower().split(), b"\n"] for k, t in texts.items()}
    plain = Plain([w for k, w in tokens.items() if not held(k)], order)
    model = language_model.train(documents, order=order)
    assert len(model.hot) > 2  # frequent words take the other way
    got = {r["doc_id"]: r for r in language_model.score(documents, model).collect()}
    assert set(got) == set(texts) and any(r["held_out"] for r in got.values())
    for k, w in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(k), len(w), plain.n)
        assert r["n_known"] == sum(x in plain.uni for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.uni.get(x, 0) + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for x in w), abs=1e-8)
        assert r["score"] == pytest.approx(plain.score(w), rel=1e-9)

def test_hash_arrays():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        values = rng.integers(0, 9, len(keys)), rng.integers(0, 400, len(keys)), rng.integers(0, 1 << 40, len(keys))
        folder = tempfile.mkdtemp()
        write_file(f"file://{folder}/x", language_model.hash_file(keys, *values))
        own = language_model.HashArray(f"file://{folder}/x")
        assert own[keys].tolist() == np.stack(values, 1).tolist()
        other = np.setdiff1d(rng.integers(0, 1 << 62, 999).astype(np.uint64), keys)
        assert not own[other].any()


def test_words_are_split_and_hashed_as_bytes_split():
    texts = [None, "", " ", "a", " a  b\t\nc\x1cd ", "x" * 9000 + " y", "ü\xa0ü a"]
    words, which, counts = split_words(pa.array(texts, pa.string()))
    flat = [words[k].as_py().encode() for k in which.tolist()]
    assert [flat[b - n : b] for b, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)] == [(x or "").encode().split() for x in texts]
    many = pa.array([f"{k:x}" * (k % 40) + "é" * (k % 3) for k in range(5000)])
    hashes = hash_words(many)
    assert len(set(hashes.tolist())) == len(set(many.to_pylist())) and (hash_words(many.slice(7)) == hashes[7:]).all()


def test_no_training_rows(spark, empty):
    rows = spark.createDataFrame([(k, "a b") for k in range(200) if held(k)], "doc_id long, text string")
    got = language_model.score(rows, language_model.train(rows)).collect()
    assert got and all(r["train_tokens"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in got)
    assert language_model.score(empty, language_model.train(empty)).count() == 0


def test_held_out_text_scores_above_the_base(spark):
    text = "the quiet river runs under the old stone bridge every late winter evening " * 3
    rows = spark.createDataFrame([(k, text + f"number{k}") for k in range(60)], "doc_id long, text string")
    got = [r for r in language_model.score(rows, language_model.train(rows)).collect() if r["held_out"]]
    assert got and all(r["score"] > r["base_score"] for r in got)


def corpus(spark):
    import random

    rng = random.Random(8)
    words = "the of and stone river light quiet hand paper green iron seven cloud open road".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)), "en" if k % 2 else "fr") for k in range(120)]
    rows += [(200 + k, " ".join(f"{rng.choice(words).upper()}!!{rng.randrange(999)}" for _ in range(40)), "en") for k in range(10)]
    rows += [(300, None, "en"), (301, "", None), (None, "JUNK$$ JUNK%%", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, 1, 0) for k in range(0, 100)] + [(200, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("order", [2, 3])
def test_classifier_matches_plain_scores(spark, order):
    rows, labels = corpus(spark)
    got = {r["doc_id"]: r for r in quality.classify(rows, labels, order=order).collect()}
    sample = {r["doc_id"] for r in quality.trusted(rows, labels).where("trains").collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").split(), "\n"] for r in rows.where("doc_id IS NOT NULL").collect()}
    plain = Plain([texts[k] for k in sample], order)
    for k, w in texts.items():
        assert got[k]["perplexity"] == pytest.approx(10 ** (-plain.score(w) / len(w)), rel=1e-9)
    assert not any(got[k]["kept"] for k in range(200, 210)) and sum(got[k]["kept"] for k in range(120)) >= 117


def test_classifier_with_many_shards_is_the_same(spark, monkeypatch):
    rows, labels = corpus(spark)
    rounded = lambda df: sorted((r["doc_id"], r["lang"] or "", round(r["perplexity"], 6), r["kept"]) for r in df.collect())
    whole = rounded(quality.classify(rows, labels))
    monkeypatch.setattr(quality, "SHARD_ROWS", 50)
    assert whole == rounded(quality.classify(rows, labels))


def test_classifier_takes_very_long_texts(spark):
    rows, labels = corpus(spark)
    long = spark.createDataFrame([(900, "the stone river " * 400_000, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.classify(rows.unionByName(long), labels).collect()}
    assert got[900]["n_tokens"] == 1_200_001 and got[900]["perplexity"] > 0


def test_classifier_keeps_columns_and_null_ids(spark):
    rows, labels = corpus(spark)
    out = quality.keep(rows.selectExpr("*", "1 AS kept", "2 AS perplexity"), labels)
    assert out.columns == ["doc_id", "text", "lang", "kept", "perplexity"] and out.where("doc_id IS NULL").count() == 1
    assert quality.keep(rows, labels.limit(0)).count() == rows.count() and quality.keep(rows.limit(0), labels).count() == 0


def test_toxic_documents_are_not_trusted(spark):
    rows, labels = corpus(spark)
    odd = spark.createDataFrame([(100, 1, 1), (101, 1, None), (102, None, 0), (103, 1, 0), (103, 1, 1), (104, 1, 0)], "doc_id long, quality int, toxic int")
    ids = {r["doc_id"] for r in quality.trusted(rows, labels.unionByName(odd)).collect()}
    assert ids == {*range(100), 104}


def test_thresholds_cover_all_trusted_documents_that_did_not_train(spark):
    rows, labels = corpus(spark)
    train = {r["doc_id"] for r in quality.trusted(rows, labels, 10).where("trains").collect()}
    got = quality.classify(rows, labels, 0.9, 10).where("doc_id < 120").collect()
    assert 0 < len(train) < 20
    for lang in ("en", "fr"):
        calibration = sorted(r["perplexity"] for r in got if r["lang"] == lang and r["doc_id"] < 100 and r["doc_id"] not in train)
        assert len(calibration) > 30
        assert {r["threshold"] for r in got if r["lang"] == lang} == {calibration[math.ceil(0.9 * len(calibration)) - 1]}


def test_all_trusted_documents_train_or_calibrate(spark):
    """More documents of a language than the 2,000 that a bound once left."""
    rows = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id % 7, ' stone w', id % 11, ' river') AS text", "'en' AS lang")
    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    sample = quality.trusted(rows, labels).collect()
    assert {r["doc_id"] for r in sample} == set(range(5000)) and 2300 < sum(r["trains"] for r in sample) < 2700
    odd = {r["doc_id"] for r in sample if r["trains"]}
    plain = Plain([[f"w{k % 7}", "stone", f"w{k % 11}", "river", "\n"] for k in odd], 3)
    got = {r["doc_id"]: r for r in quality.classify(rows, labels).collect()}
    for k in range(0, 5000, 97):
        assert got[k]["perplexity"] == pytest.approx(10 ** (-plain.score([f"w{k % 7}", "stone", f"w{k % 11}", "river", "\n"]) / 5), rel=1e-9)
