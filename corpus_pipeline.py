"""A corpus pipeline of five stages; each works on all that the one before it kept.

Every stage is a (name, function) of ``STAGES``; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them
again, so that a stage never repeats the work of those before it, and lost executors cost their own tasks only.

ORACLE_SQL is None: perplexities and ids of tokens are beyond SQL; the tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, lines, ngram_join, quality
from tidegauge.llm.common import cut, drop, table

MIN_LINE_DOCUMENTS = 10


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; the documents stay, with n_chars of the text that is left."""
    out = lines.dedup(docs, MIN_LINE_DOCUMENTS)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).withColumn("text", text).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark items are cut out of the texts."""
    before = next(x for x in (f"before{'_' * k}" for k in range(len(docs.columns) + 1)) if x not in docs.columns)
    cleaned = decontaminate.clean(docs.withColumn(before, F.length("text")), table(spark, sf_dir, "benchmark"))
    changed = F.length("text") != F.col(before)
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's rows are deleted once the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if k:
            drop(before)
    return docs
