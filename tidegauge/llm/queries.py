"""Queries of the operators over the whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidegauge.llm import bpe, decontaminate, embedding_dedup, exact_topk, hard_negatives, language_model, lines, merkle, ngram_join, quality, secret_scan, sharding, token_files
from tidegauge.llm.common import table


def op1_token_files(spark, sf_dir):
    parts = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(parts)


def op2_ngram_join(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    return lines.digests(table(spark, sf_dir, "documents"), min_docs=10)


def op5_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language_model.score(documents, language_model.train(documents))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark, sf_dir):
    return sharding.digests(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), every=100, label=label)


def op12_exact_topk(spark, sf_dir):
    return exact_topk.top(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


def queries() -> dict:
    return {"op1_token_files": op1_token_files, "op2_ngram_join": op2_ngram_join, "op3_decontaminate": op3_decontaminate, "op4_line_dedup": op4_line_dedup, "op5_quality_classifier": op5_quality_classifier, "op6_secret_scan": op6_secret_scan, "op7_lm_scoring": op7_lm_scoring, "op8_embedding_dedup": op8_embedding_dedup, "op9_sharding": op9_sharding, "op10_byte_bpe": op10_byte_bpe, "op11_hard_negatives": op11_hard_negatives, "op12_exact_topk": op12_exact_topk, "op13_merkle_manifest": op13_merkle_manifest}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": lines.ORACLE_SQL, "op9_sharding": sharding.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_exact_topk": exact_topk.ORACLE_SQL, "op13_merkle_manifest": merkle.ORACLE_SQL}
