"""The pipeline over a small corpus: each stage against plain Python on the very rows that it got."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tests.llm import test_lines, test_near
from tests.llm.conftest import prose
from tests.llm.test_models import Plain
from tidegauge.llm import decontaminate, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (clean, near and exact copies, a shared line, junk, passages, null and empty texts), labels, benchmark."""
    rng = random.Random(17)
    passage = " ".join(f"item{rng.randrange(500)}" for _ in range(14))
    texts = {k: prose(rng, 60) for k in range(150)}
    base = texts[3].split()
    for k in range(150, 156):  # near copies
        texts[k] = " ".join([*base[:50], f"odd{k}", *base[51:]])
    texts |= {160 + k: texts[9] for k in range(4)}
    texts |= {k: texts[k] + "\nRead More  Below\n" + prose(rng, 4) for k in range(20, 45)}
    texts |= {k: texts[k] + " " + passage.upper() + " " + prose(rng, 5) for k in (60, 61)}
    texts |= {200 + k: " ".join(f"{rng.choice('XQZ')}##{rng.randrange(9999)}" for _ in range(40)) for k in range(8)}
    texts |= {300: None, 301: "", 302: "one"}
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    documents = spark.createDataFrame([(k, t, "en" if k % 2 else "fr", f"s{k % 3}", len(t or "")) for k, t in texts.items()], COLUMNS)
    documents.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(100)] + [(200, 0, 0), (201, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, passage), (2, "nowhere to be found in any of the texts of this small corpus"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_every_stage_against_plain_python(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages, got = dict(corpus_pipeline.STAGES), {}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        out = stages[name](spark, docs, folder)
        got[name] = (rows_of(docs), rows_of(out))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), COLUMNS)
    # the classifier: perplexities from the definition, thresholds as the operator tells
    before, after = got["quality_classifier"]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    trains = {r["doc_id"] for r in quality.trusted(source, labels).where("trains").collect()}
    words = {k: [*(t or "").split(), "\n"] for k, t in before.items()}
    plain = Plain([words[k] for k in trains], 3)
    limits = {r["lang"]: r["threshold"] for r in quality.classify(source, labels).select("lang", "threshold").distinct().collect()}
    perplexity = {k: 10 ** (-plain.score(w) / len(w)) for k, w in words.items()}
    lang = lambda k: "en" if k % 2 else "fr"
    near = {k for k, p in perplexity.items() if abs(p - limits[lang(k)]) < 1e-6 * p}  # a threshold is a document's own value
    assert {k for k, p in perplexity.items() if p <= limits[lang(k)]} - near == set(after) - near
    assert not any(k in after for k in range(200, 208)) and sum(k in after for k in range(150)) >= 140
    # lines
    before, after = got["line_dedup"]
    want = test_lines.brute(before, 10)
    assert {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in after.items()} == {k: w[2] for k, w in want.items()}
    assert any(w[1] for w in want.values())
    # near copies: the smallest id of each class stays
    before, after = got["ngram_jaccard_join"]
    want = {k: c for k, (_, c) in test_near.brute(before).items()}
    assert set(after) == set(want.values()) and len(after) < len(before) and all(after[k] == before[k] for k in after)
    # passages: no hit is left, clean texts are as they were
    before, after = got["benchmark_decontamination"]
    hit = {k: decontaminate.brute_force(t, items)[1] for k, t in before.items()}
    assert any(hit.values()) and set(after) == set(before)
    for k, t in after.items():
        left = len(decontaminate.words_of(t or ""))
        assert t == before[k] if not hit[k] else left == len(decontaminate.words_of(before[k])) - hit[k], k
    # ids
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    coded = {r["doc_id"]: r for r in stages["byte_level_bpe"](spark, docs, folder).collect()}
    assert set(coded) == set(after)
    for k, t in after.items():
        assert coded[k]["n_tokens"] == len(coder.encode_ordinary(t or "")) and coded[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {k: r["ids_sha256"] for k, r in coded.items()}
