"""Quality classifier: perplexity under a Kneser-Ney n-gram model of trusted text, cut at quantiles of each language.

Trusted are all documents labelled as good and not toxic. A hash of the id deals them in halves: one trains, and a
language's threshold is the ``QUANTILE`` quantile of the perplexities of the other, as text that a model has seen tells nothing
about text that it has not. Documents above it are rejected. A caller may bound the trusted documents of a language (``most``).

The model is that of ``language_model``, of ``ORDER`` 3 (or 2), with capital letters apart: its count tables lie in shards in the
shared folder, and the tokens of every document are joined with them shard by shard, in Arrow batches against the mapped
shards. A broadcast of these tables would pass the driver's memory (README.md has figures), and a shuffle of all tokens the
disk. The ids that train lie in sorted shards there too, so neither they nor texts are broadcast or shuffled.

Edge cases: a null text is empty and has the end token only; rows that share an id are scored as one document; rows
with a null id and languages without calibration documents (a null language is one of its own) are kept; without
labels nothing is rejected; a null in quality or toxic, or labels that contradict each other, make no document
trusted. ``keep`` passes all columns through; ``scores`` reads doc_id, text and lang only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import language_model
from tidegauge.llm.common import batch_of, cut, drop, map_file, remove, shared_dir, small_batches, write_file

ORDER = 3
QUANTILE = 0.975  # chosen on half of sf0.1's held-out labels; README.md has the other half's figures
ACCURACY = 100_000  # ranks of a threshold are off by 1 / ACCURACY of the calibration documents at most
SHARD_ROWS = 1_000_000
MOST_BROADCAST_ROWS = 1_000_000
PARTS = 1 << 30  # of the ids' hashes


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def good(labels: DataFrame) -> DataFrame:
    """(doc_id): documents that every label of theirs calls good and not toxic."""
    clean = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.groupBy("doc_id").agg(F.bool_and(clean).alias("good")).where("good").select("doc_id")


def trusted(df: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, lang, trains): the trusted documents, and which half trains. With ``most``, a hash of the id chooses about
    so many of a language, and no language's documents gather anywhere."""
    own = df.select("doc_id", "lang").join(good(labels), "doc_id")
    if most is not None:
        known = cut(own, "trusted-all")
        sizes = known.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n"))  # a row a language
        told = known.join(F.broadcast(sizes), known["lang"].eqNullSafe(sizes["of"]))
        own = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) * F.col("n") < F.lit(PARTS * most))
    out = cut(own.select("doc_id", "lang", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("trains")), "trusted")
    if most is not None:
        drop(known)
    return out


def _stored(ids: DataFrame, folder: str) -> int:
    """Write ids (doc_id) in sorted shards; the number of shards."""
    shards = max(1, -(-ids.count() // SHARD_ROWS))
    written = pa.schema([("shard", pa.int32())])

    def write(batches):
        found = [[b[c].to_numpy() for c in ("shard", "doc_id")] for b in batches if b.num_rows]
        if found:
            shard, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            write_file(f"{folder}/ids-{shard[0]:06d}.bin", [np.sort(keys).astype("<i8")])
            yield batch_of(written, [shard[0]])

    rows = ids.select(F.pmod("doc_id", F.lit(shards)).cast("int").alias("shard"), "doc_id")
    rows.repartitionById(shards, "shard").mapInArrow(write, "shard int").count()
    return shards


def _among(ids: np.ndarray, shards: int, folder: str) -> np.ndarray:
    """Whether ids are stored."""
    out, shard = np.zeros(len(ids), bool), ids % shards
    for k in np.unique(shard).tolist():
        try:
            stored = map_file(f"{folder}/ids-{k:06d}.bin", "<i8")
        except FileNotFoundError:  # no id fell there
            continue
        own = np.flatnonzero(shard == k)
        out[own] = stored[np.minimum(np.searchsorted(stored, ids[own]), len(stored) - 1)] == ids[own]
    return out


def scores(df: DataFrame, train: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, perplexity) of every document under a model of those whose ids ``train`` (doc_id) has."""
    spark = df.sparkSession
    folder, texts = shared_dir(spark, "trusted-model"), _texts(df)
    shards = _stored(train, folder)
    chosen = lambda batch: batch.filter(pa.array(_among(batch["doc_id"].to_numpy(), shards, folder)))
    model = language_model.train(texts, folder, order, chosen, lower=False)
    sums = language_model.score(texts, model).groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"))
    out = cut(sums.select("doc_id", "n_tokens", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")), "scores")
    remove(spark, folder)
    return out


def classify(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most: int | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, kept): a row for each id and language."""
    small_batches(df.sparkSession)
    documents = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sample = trusted(documents, labels, most)
    train = sample.where("trains").select("doc_id").distinct()
    scored = scores(documents, train, order)
    rows = documents.where("doc_id IS NOT NULL").select("doc_id", "lang").distinct().join(scored, "doc_id")
    calibration = rows.join(good(labels), "doc_id", "left_semi").join(train, "doc_id", "left_anti")
    thresholds = calibration.groupBy(F.col("lang").alias("__lang")).agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(ACCURACY)).alias("threshold"))
    told = rows.join(thresholds, rows["lang"].eqNullSafe(thresholds["__lang"]), "left").drop("__lang")
    out = cut(told.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))), "classified")
    drop(sample, scored)
    return out


def keep(df: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most: int | None = None) -> DataFrame:
    """Rows of ``df`` but those of rejected documents."""
    told = classify(df, labels, quantile, most)
    gone = cut(told.where("NOT kept").select("doc_id").distinct(), "rejected")
    drop(told)
    few = gone.count() <= MOST_BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*df.columns)
