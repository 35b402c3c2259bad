"""Baseline of each sensor over normal rows, and scaling by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C


def baseline(long: DataFrame) -> DataFrame:
    """sensor, mean, std (population), low, high, n: a row a sensor."""
    return long.groupBy("sensor").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


def scaled(long: DataFrame, base: DataFrame, method: str = "standard") -> DataFrame:
    """``long`` with ``scaled``; method standard, minmax, zscore or percent."""
    forms = {"standard": C.standard("value", "mean", "std"), "minmax": C.min_max("value", "low", "high"), "zscore": C.z_score("value", "mean", "std"), "percent": C.percent_deviation("value", "mean", "std")}
    if method not in forms:
        raise ValueError(f"method {method!r} is none of {sorted(forms)}")
    return long.join(base, "sensor").withColumn("scaled", forms[method]).select(*long.columns, "scaled")


def restored(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Inverse of the standard form of ``scaled``."""
    return rows.join(base, "sensor").withColumn("value", C.unscaled("scaled", "mean", "std")).select(*rows.columns)
