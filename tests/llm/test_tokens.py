"""Token files and byte-level BPE against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidegauge.llm import bpe, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_token_files(documents, texts, spark):
    library, at, want = Tokenizer.from_file(WORD), 0, {}
    for k in sorted(texts):
        ids = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        want[k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    parts = token_files.write(documents, WORD, end_id=2, parts=3)
    assert {r["bits"] for r in parts.collect()} == {16}
    assert {r["doc_id"]: tuple(r)[1:] for r in token_files.read(parts).collect()} == want


def test_token_files_wide_ids_null_id_and_repeats(spark):
    rows = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in token_files.read(token_files.write(rows, WORD, end_id=70_000)).collect()), key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in got] == [(None, 0, 2), (3, 2, 3), (3, 5, 3)]


def test_token_files_empty(empty):
    assert token_files.read(token_files.write(empty, WORD, end_id=2)).count() == 0


def test_bpe_matches_tiktoken_and_round_trips(documents, texts):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(documents, RANKS, PATTERN).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert got[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_offsets_and_split_characters(spark):
    text = "a \U0001f600é b"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = bpe.encode(rows, RANKS, PATTERN, offsets=True).first()
    own = bpe.coder(RANKS, PATTERN)
    assert row["starts"][0] == 0 and row["ends"][-1] == len(text) and all(a < b for a, b in zip(row["starts"], row["ends"], strict=True))
    assert "".join(own.decode_text(bytes(row["ids"]))) == text
    ids = np.array([own.bytes_of.index("é".encode()[:1])], "<u4").tobytes()  # half a character alone
    assert own.decode_text(ids) == ["�"]


def test_bpe_null_ids_and_empty(spark, empty):
    rows = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(rows, RANKS, PATTERN).first()["decoded"] is None
    assert bpe.digests(empty, RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bpe_random_text(seed):
    import random

    rng = random.Random(seed)
    own, library = bpe.coder(RANKS, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for _ in range(200):
        text = "".join(rng.choice(" \n\t ab'sSéñ中ن1.,!?\U0001f600\x85") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(3))
def test_word_encoder_random_text(seed):
    import random

    rng = random.Random(seed)
    own, library = token_files.encoder(WORD), Tokenizer.from_file(WORD)
    cases = ["".join(rng.choice(" \n\tabE'sSéñ́中1.,!?\U0001f600\x85ΣİK") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for text, ids in zip(cases, encoded(own, cases), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids


def encoded(own, texts):
    ids, counts = own.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_word_encoder_forgets_and_asks_again(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    own, library = token_files.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for _ in range(3):
        for text in ("alpha beta, gamma", "beta delta alpha.", "epsilon zeta eta beta,", "theta, iota kappa"):
            assert encoded(own, [text, None, text]) == [library.encode(x, add_special_tokens=False).ids for x in (text, "", text)]
    assert len(own.old) < 20


def test_word_encoder_takes_the_tokenizers_own_marks_as_the_library_does():
    own, library = token_files.encoder(WORD), Tokenizer.from_file(WORD)
    cases = ["plain words", "end<|endoftext|> more", "", "x <|startoftext|>.y", "plain words again."]
    assert encoded(own, cases) == [library.encode(x, add_special_tokens=False).ids for x in cases]
