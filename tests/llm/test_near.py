"""N-gram join, components and embedding dedup against all pairs."""

import random

import numpy as np
import pytest

from tidegauge.llm import embedding_dedup, ngram_join
from tidegauge.llm.components import components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), r) for k, r in roots(sets, pairs).items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(df).collect()}


def test_classes(documents, texts):
    want = brute(texts)
    assert got(documents) == want and len({c for _, c in want.values()}) < len(texts) - 10


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_borders(spark, seed, monkeypatch):
    """Texts that drift word by word: links form chains, pairs lie on both sides of the bound; blocks are tiny."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    texts, k = {}, 0
    for _ in range(4):
        own = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(20, 60))]
        for _ in range(14):
            own = list(own)
            for _ in range(rng.choice([0, 1, 1, 2])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            texts[k] = " ".join(own)
            k += 1
    order = list(texts.values())
    rng.shuffle(order)
    texts = dict(enumerate(order))
    assert got(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)) == brute(texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_frequent_shingles_are_salted(spark, seed, monkeypatch):
    """Many near copies of a few texts, with salts of a row or two: no link is lost, alone in its salt or not."""
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 1)
    rng = random.Random(seed)
    texts = {}
    for base in range(3):
        own = [f"{base}{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(60)]
        for _ in range(30):
            copy = list(own)
            for _ in range(rng.choice([0, 1, 2, 2])):
                copy[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    ids = rng.sample(range(1000), len(texts))
    texts = {k: t for k, t in zip(ids, texts.values(), strict=True)} | {2000 + k: f"only text number {k} of its kind" for k in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    seen = []
    plain = ngram_join._first_of_salted
    monkeypatch.setattr(ngram_join, "_first_of_salted", lambda met: seen.append(met.where("salt > 0").count()) or plain(met))
    assert got(frame) == brute(texts) and seen[0] > 50


def test_keep_one(documents, empty):
    kept = ngram_join.keep_one(documents)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == documents.columns and {0, 1, 2, 10, 4} <= ids and not ids & {5, 11, 30, 31}
    assert ngram_join.keep_one(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(map(str, ngram_join.classes(rows).select("doc_id", "component_id").collect())) == sorted(map(str, [(1, 1)] * 0 + [r for r in spark.createDataFrame([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], "doc_id long, component_id long").collect()]))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    want = {n: r for n, r in roots({x for p in pairs for x in p}, pairs).items()}
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {n: r for n, r in want.items() if n in found} and set(want) - set(found) <= {n for a, b in pairs if a == b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(6):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 40)):
                rows.append((k, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])).tolist(), label))
                k += 1
    rows += [(k, rows[0][1], 1), (k + 1, rows[0][1], None), (k + 2, None, 0), (k + 3, [0.0] * 16, 0), (k + 4, [float("nan")] * 16, 0), (k + 5, [None] * 16, 0), (k + 6, [1e200] * 16, 0), (k + 7, [1e-200] * 16, 0), (k + 8, [1.0], 0), (k + 9, [2.0], 0), (k + 10, [], 0)]
    return rows


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    rows = vectors(spark)
    fit = {k: (np.array(v, float) / max(abs(np.array(v, float))), y) for k, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    pairs = [(a, b) for a in fit for b in fit if a < b and fit[a][1] == fit[b][1] and len(fit[a][0]) == len(fit[b][0]) and cosine(fit[a][0], fit[b][0]) >= 0.98]
    component = roots([r[0] for r in rows], pairs)
    count = {r[0]: sum(r[0] in p for p in pairs) for r in rows}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(frame).collect()}
    hit = sum(min(found[k][0], n) for k, n in count.items())
    assert hit >= 0.9 * sum(count.values()) and all(found[k][0] <= n for k, n in count.items())
    assert np.mean([found[k][1] == c for k, c in component.items()]) >= 0.9
    assert all(found[k] == (0, k, True) for k, v, y in rows if k not in fit)
    assert embedding_dedup.dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_a_short_document_alone_in_its_slice(n):
    text = " ".join("abcd"[:n])
    alone = ngram_join.shingle_sets([text], ngram_join.WordHashes())
    beside = ngram_join.shingle_sets(["e f g h i j", text], ngram_join.WordHashes())
    assert [x.tolist() for x in alone] == [x.tolist() for x in beside[1:]] and len(alone[0]) == 1


def test_short_documents_alone_in_their_partitions(spark):
    texts = {0: "a b", 1: "a b c", 2: "a b", 3: "a b c"}
    rows = spark.sparkContext.parallelize(list(texts.items()), 4)  # one row a partition
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(texts)


@pytest.mark.parametrize("spread", [0.033, 0.3])
def test_embedding_dedup_of_dense_labels(spark, monkeypatch, spread):
    """Labels as one dense cluster and as several, larger than any window; units are small. Nearly all links are found, and none too many."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((1 if spread > 0.1 else 12, 24))
    x = centres[rng.integers(0, len(centres), 1500)] + rng.standard_normal((1500, 24)) * spread
    x[700:1000] = x[:300] + rng.standard_normal((300, 24)) * 0.15
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = np.triu(unit @ unit.T >= 0.98, 1)
    pairs = np.argwhere(hit).tolist()
    component, count = roots(range(1500), pairs), hit.sum(0) + hit.sum(1)
    frame = spark.createDataFrame([(k, v.tolist(), "dense") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string").repartition(3)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(frame).collect()}
    reps = frame.selectExpr("vec_id AS id", "label", "24 AS size", "embedding").rdd.map(lambda r: (r[0], r[1], r[2], np.array(r[3], "<f8").tobytes())).toDF("id long, label string, size int, vec binary")
    met = {(r["a"], r["b"]) for r in embedding_dedup._passes(reps, 0.98, 8).where("a <> b").collect()}
    assert met and met <= set(map(tuple, pairs))  # the passes verify what they find
    links = sum(n for n, _ in found.values())
    print("recall of links", links / count.sum(), "classes", np.mean([found[k][1] == component[k] for k in range(1500)]))
    assert len(pairs) > 100 and all(found[k][0] <= count[k] for k in range(1500)) and links >= 0.99 * count.sum()
    assert np.mean([found[k][1] == component[k] for k in range(1500)]) >= 0.99


def test_passes_grow_with_the_logarithm_and_find_the_links(spark):
    """Pairs at the threshold in a label without dense stretches: the passes alone find nearly all, whatever its size."""
    assert embedding_dedup.passes_for(20, 0.98) == 1 and embedding_dedup.passes_for(10**9, 0.98) < 60
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 32))
    turn = rng.standard_normal((600, 32))
    x[:600] /= np.sqrt((x[:600] ** 2).sum(1, keepdims=True))
    turn -= (turn * x[:600]).sum(1, keepdims=True) * x[:600]
    turn /= np.sqrt((turn * turn).sum(1, keepdims=True))
    x[600:1200] = 0.981 * x[:600] + np.sqrt(1 - 0.981**2) * turn  # just above the threshold
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(frame).collect()}
    met = sum(found[k + 600] == (1, k) and found[k] == (1, k) for k in range(600))
    print("recall of pairs at the threshold", met / 600)
    assert met >= 0.99 * 600 and all(found[k] == (0, k) for k in range(1200, 6000))
