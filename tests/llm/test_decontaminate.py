"""FM-index search against comparing every place with every phrase."""

import hashlib
import random

import numpy as np
import pytest

from tidegauge.llm import decontaminate as D


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_index(seed):
    rng = np.random.default_rng(seed)
    parts = [np.append(rng.integers(1, 5, rng.integers(0, 60)), 0) for _ in range(8)]
    parts += [parts[0]] * 5  # copies
    symbols = np.concatenate(parts).astype(np.int32)
    ends = symbols == 0
    ranks = np.where(ends, np.cumsum(ends) - 1, symbols + ends.sum()).astype(np.int64)
    assert D.suffix_array(ranks).tolist() == sorted(range(len(ranks)), key=lambda k: ranks[k:].tolist())
    index = D.FMIndex(symbols, 6)
    phrases = rng.integers(2, 6, (30, 4)).astype(np.int32)
    lengths = rng.integers(1, 5, 30)
    low, high = index.search(phrases, lengths)
    for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
        want = [k for k in range(len(symbols)) if symbols[k : k + n].tolist() == p[:n].tolist()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    own = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (25, 12, 10, 4, 1)]
    return [(9, own[0]), (10, own[1]), (2, own[2]), (33, own[3]), (4, "Zeta-99"), (5, ""), (6, None), (7, own[1]), (None, "only here it stands")]


def tables(spark, items):
    rng = random.Random(6)
    texts = {0: None, 1: "", 2: items[0][1].upper(), 3: "x " + items[3][1] + " . " + items[1][1] + "! tail", 4: "zeta 99 zeta only HERE it stands.", 5: items[0][1][:40] + " cut " + items[0][1][-60:]}
    texts |= {k: " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 300))) for k in range(10, 30)}
    documents = spark.createDataFrame([(k, t, "z", 1) for k, t in texts.items()], "doc_id long, text string, spans string, n_hit int").repartition(2)
    return texts, documents, spark.createDataFrame(items, "item_id long, text string")


def test_digests(spark, items):
    texts, documents, benchmark = tables(spark, items)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items_sha256"]) for r in D.digests(documents, benchmark).collect()}
    assert got == {k: D.brute_force(t, items) for k, t in texts.items()}
    assert got[2][1] == got[2][0] > 0 == got[1][0]


@pytest.mark.parametrize(("shard", "file_bytes", "at_once"), [(64, 60, 5), (20, 1, 1), (1 << 19, 1 << 20, 1 << 17)])
def test_small_shards_and_files(spark, items, tmp_path, monkeypatch, shard, file_bytes, at_once):
    """Long documents are cut into overlapping segments, and the benchmark lies in many files."""
    monkeypatch.setattr(D, "AT_ONCE", at_once)
    texts, _, benchmark = tables(spark, items)
    names = D.write_phrases(benchmark.repartition(3), f"file://{tmp_path}/p", file_bytes=file_bytes)
    masks, found = D.in_documents([t or "" for t in texts.values()], [f"file://{tmp_path}/p/{n}" for n in names], shard=shard)
    assert (len(names) > 3) == (file_bytes < 100)
    for mask, own, (k, t) in zip(masks, found, texts.items(), strict=True):
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        assert (len(mask), int(mask.sum()), digest) == D.brute_force(t, items), k


def test_names_of_items_are_kept_as_they_are(spark):
    odd = [("a\nb", "one two"), ("a\\nb", "three four"), ("=,", "five six"), ("", "seven eight"), (None, "nine ten")]
    benchmark = spark.createDataFrame(odd, "item_id string, text string")
    documents = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(odd)], "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in D.scan(documents, benchmark).collect()}
    assert got == {k: [] if i is None else [i] for k, (i, _) in enumerate(odd)}


def test_columns_with_the_names_of_intermediates(spark, items):
    texts, documents, benchmark = tables(spark, items)
    clash = documents.withColumnsRenamed({"spans": "row", "n_hit": "hits"})
    whole = D.clean(clash, benchmark)
    assert whole.columns == clash.columns and whole.count() == len(texts)
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {r["doc_id"]: r["text"] for r in D.clean(documents, benchmark).collect()}


def test_clean_cuts_spans(spark, items):
    texts, documents, benchmark = tables(spark, items)
    out = D.clean(documents, benchmark)
    own = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == documents.columns and own[0] is None and own[1] == "" and own[2] == "" and own[3].startswith("x ") and own[3].endswith("! tail")
    assert D.clean(documents, benchmark.limit(0)).count() == len(texts) and D.scan(documents.limit(0), benchmark).count() == 0
