"""A fitted detector as files: baseline, threshold, settings and, where one was fitted, the PCA or recurrent scorer."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import recurrent, scoring
from tidegauge.sources import files

SCORERS = {scoring.PCAScorer: "pca", recurrent.RecurrentScorer: "recurrent"}
BASELINE = "sensor int, mean double, std double, low double, high double, n long"


def merged(base: dict, over: dict) -> dict:
    """Settings with those of ``over`` put over them, at every depth; neither argument is changed."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


@dataclass
class Fitted:
    """baseline (a row a sensor), threshold, settings (size and stride at least), and a scorer or None."""

    baseline: DataFrame
    threshold: float
    settings: dict
    scorer: scoring.PCAScorer | recurrent.RecurrentScorer | None = None

    def scores(self, matrix: DataFrame) -> DataFrame:
        """Scores of all windows of a matrix with threshold and anomalous."""
        size, stride = self.settings["size"], self.settings["stride"]
        found = self.scorer.scores(matrix, size, stride) if self.scorer else scoring.matrix_scores(matrix, self.baseline, size, stride)
        return scoring.flagged(found, self.threshold)

    def describe(self) -> dict:
        """What the detector is, in a few plain values."""
        return {"scorer": SCORERS[type(self.scorer)] if self.scorer else "baseline", "n_sensors": self.baseline.count(), "threshold": self.threshold, **self.settings}


def save(fitted: Fitted, path: str) -> None:
    """Write a detector under a folder, over one that is there."""
    spark = fitted.baseline.sparkSession
    kept = fitted.baseline.select(*[f.split()[0] for f in BASELINE.split(", ")])
    files.write_artifact(kept.coalesce(1), f"{path}/baseline")  # a row a sensor
    scorer = json.dumps(fitted.scorer.saved()) if fitted.scorer else None
    row = spark.createDataFrame([(fitted.threshold, json.dumps(fitted.settings), scorer)], "threshold double, settings string, scorer string")
    files.write_artifact(row, f"{path}/detector")


def load(spark: SparkSession, path: str) -> Fitted:
    """A detector that ``save`` wrote. A missing part is an error now and not at the first score."""
    base = files.read_artifact(spark, f"{path}/baseline", BASELINE)
    row = files.read_artifact(spark, f"{path}/detector", "threshold double, settings string, scorer string").first()
    if row is None or row["threshold"] is None or not base.where(F.col("mean").isNotNull()).count():
        raise ValueError(f"no whole detector under {path}")
    scorer = None
    if row["scorer"]:
        numbers = json.loads(row["scorer"])
        kinds = {name: kind for kind, name in SCORERS.items()}
        scorer = kinds[numbers.get("kind", "pca")].restored(numbers)
    return Fitted(base, row["threshold"], json.loads(row["settings"]), scorer)
