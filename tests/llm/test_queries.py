"""Queries of the operators against their DuckDB SQL, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from tidegauge.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, got[columns].astype(str).to_numpy().tolist())) == sorted(map(str, want[columns].astype(str).to_numpy().tolist()))


def test_one_query_an_operator():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.parametrize(("name", "left"), [("op2_ngram_join", 1), ("op3_decontaminate", 1), ("op4_line_dedup", 1), ("op5_quality_classifier", 1), ("op8_embedding_dedup", 1), ("op11_hard_negatives", 1), ("op12_exact_topk", 1), ("op13_merkle_manifest", 1)])
def test_what_a_query_leaves_in_the_shared_folder(spark, name, left):
    """What the result is read from, and nothing else."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = queries.queries()[name](spark, SF)
    assert out.count() > 0 and len(set(os.listdir(shared)) - before) <= left, set(os.listdir(shared)) - before


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    documents = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert 0 < len(out) < len(documents) and set(out["doc_id"]) <= set(documents["doc_id"]) and out["doc_id"].is_unique
    assert (out["n_tokens"] == out["ids"].map(len) // 4).all()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString() and 0 < out.count() <= docs.count()
