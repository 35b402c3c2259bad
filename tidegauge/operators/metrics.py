"""Quality of detectors from labelled scores (label 0/1, score, predicted 0/1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def confusion(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, precision, recall, f1, fpr, fnr; a rate without cases is 0."""
    n = lambda p, y: F.count_if((F.col("predicted") == p) & (F.col("label") == y))
    counts = rows.agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 0).alias("tn"), n(0, 1).alias("fn"))
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rates = counts.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "fpr": rate(fp, fp + tn), "fnr": rate(fn, fn + tp)})
    return rates.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _by_score(rows: DataFrame) -> DataFrame:
    return rows.where("score IS NOT NULL AND label IS NOT NULL").groupBy("score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))


def _cumulative(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(score, p, n, p_below, n_below): positives and rows of each distinct score, and those of smaller scores.

    Scores are cut into ranges at approximate quantiles; sums run within a range, and each range starts from the totals
    of those before it, a row a range.
    """
    groups = _by_score(rows)
    cuts = groups.agg(F.percentile_approx("score", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10_000))).first()[0] or []
    placed = groups.withColumn("range", sum((F.when(F.col("score") > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    bases = totals.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in ("p", "n")])
    line = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(bases), "range").select("score", "p", "n", *[(F.col(f"{c}_base") + F.coalesce(F.sum(c).over(line), F.lit(0))).alias(f"{c}_below") for c in ("p", "n")])


def auroc(rows: DataFrame) -> DataFrame:
    """One row: auroc, the chance that a positive outscores a negative, ties half."""
    p, negatives = F.col("p"), F.col("n") - F.col("p")
    wins = _cumulative(rows).select("p", "n", (p * (F.col("n_below") - F.col("p_below") + negatives / 2)).alias("wins"))
    return wins.agg(F.when((F.sum("p") == 0) | (F.sum(negatives) == 0), 0.0).otherwise(F.sum("wins") / F.sum("p") / F.sum(negatives)).alias("auroc"))


def auprc(rows: DataFrame) -> DataFrame:
    """One row: auprc, average precision over distinct thresholds."""
    told = _cumulative(rows)
    all_of = told.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    above = told.join(F.broadcast(all_of)).select("p", (F.col("p") * (F.col("all_p") - F.col("p_below")) / (F.col("all_n") - F.col("n_below"))).alias("area"))
    return above.agg(F.when(F.sum("p") == 0, 0.0).otherwise(F.sum("area") / F.sum("p")).alias("auprc"))


def detection_delay(windows: DataFrame, onsets: DataFrame) -> DataFrame:
    """run_id, onset_index, first_detected, delay: first anomalous window that starts at or after a run's onset."""
    told = windows.join(onsets, "run_id")
    hit = F.when(F.col("anomalous") & (F.col("start_sample") >= F.col("onset_index")), F.col("start_sample"))
    return told.groupBy("run_id", "onset_index").agg(F.min(hit).alias("first_detected")).withColumn("delay", F.col("first_detected") - F.col("onset_index"))


def delay_summary(delays: DataFrame) -> DataFrame:
    return delays.agg(F.avg("delay").alias("mean_delay"), F.count_if(F.col("delay").isNull()).alias("missed"))


def labelled(windows: DataFrame, onsets: DataFrame, include_preonset: bool = False) -> DataFrame:
    """Windows of fault runs with label: 1 from the onset on; earlier ones are left out, or 0 with include_preonset."""
    told = windows.join(onsets, "run_id").withColumn("label", (F.col("start_sample") >= F.col("onset_index")).cast("int")).withColumn("predicted", F.col("anomalous").cast("int"))
    return told if include_preonset else told.where("label = 1")
