import random

import pytest

WORDS = "the of and stone river light quiet hand paper green iron seven cloud open road late glass field winter song".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: null, empty, blank, exact and near copies, ties, a very long text, odd characters."""
    rng = random.Random(11)
    base = prose(rng, 120).split()
    out = {0: None, 1: "", 2: " \t\n \r", 3: "one", 4: "four words only here", 5: "four words only here", 6: prose(rng, 30_000)}
    for k in range(10, 22):  # near copies of one text, each with its own change
        own = list(base)
        own[k * 5] = f"changed{k}"
        out[k] = " ".join(own)
    for k in range(30, 33):
        out[k] = " ".join(base)
    for k in range(40, 60):
        out[k] = prose(rng, rng.randint(1, 90)) + "\nShared Line here \n" + prose(rng, 5) + ("\n shared line HERE" if k % 2 else "")
    out[70] = "Ünï çödé   tab\there \U0001f600 zero\x00 \x1c sep  two   blanks\n\n\nlines ÀÉ don't I'LL x's 12345 ...!!!   nbsp﻿"
    out[71] = "é Å Å fín. ﬁ Σίσυφος ΣΑΣ İstanbul ’quoted”. end.” (x)*y"
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with the columns of ``documents`` and columns that clash with names the operators make."""
    rows = [(k, t, None if k % 7 == 0 else "en", f"s{k % 3}", len(t or ""), "x", 1, "y", [k]) for k, t in texts.items()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens int, kept_text string, component_id array<long>"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
