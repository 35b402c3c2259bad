"""The detector's tables as temporary views, and window functions for SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidegauge.functions import columns as C
from tidegauge.operators import events, scaling, scoring, windows
from tidegauge.sources import artifacts, tables


class WindowsOf:
    """The windows of ``size`` samples, every ``stride``, that hold sample i of a run whose last one is ``last``."""

    def eval(self, i: int, last: int, size: int, stride: int):
        if i is not None and last is not None:
            for k in range(max(0, -((size - 1 - i) // stride)), i // stride + 1):
                if k * stride + size - 1 <= last:
                    yield k, i - k * stride


class WindowIndex:
    """All windows of a run of n samples."""

    def eval(self, n: int, size: int, stride: int):
        for k in range(max(0, ((n or 0) - size) // stride + 1)):
            yield k, k * stride, k * stride + size - 1


def register_functions(spark: SparkSession) -> None:
    """``windows_of(i, last, size, stride)`` -> window_id, pos and ``window_index(n, size, stride)`` -> window_id, start_sample,
    end_sample, for LATERAL in SQL."""
    spark.udtf.register("windows_of", udtf(WindowsOf, returnType="window_id long, pos long"))
    spark.udtf.register("window_index", udtf(WindowIndex, returnType="window_id long, start_sample long, end_sample long"))


@dataclass
class Views:
    """Settings of the views, and the tables under them once ``register`` was called."""

    size: int = 60
    stride: int = 5
    percentile: float = 99.0
    confirm: int = 3
    separate: int = 20
    flush: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def register(self, matrix: DataFrame, normal: DataFrame | None = None, followups: DataFrame | None = None, fitted: artifacts.Fitted | None = None) -> dict[str, DataFrame]:
        """Create (or replace) the views of a matrix. Baseline, threshold and scores are those of ``fitted`` where it is
        given; else they come from ``normal``, all of the matrix by default.

        samples (run_id, sample_index, last), sensor_long, baseline, windows, scores (with threshold and anomalous), event_windows,
        anomaly_events and, where given, followups.
        """
        spark = matrix.sparkSession
        register_functions(spark)
        if fitted is None:
            fit_on = matrix if normal is None else normal
            base = scaling.baseline(tables.to_long(fit_on))
            limit = scoring.threshold_value(scoring.matrix_scores(fit_on, base, self.size, self.stride), percentile=self.percentile)
            fitted = artifacts.Fitted(base, limit, {"size": self.size, "stride": self.stride})
        base, scores = fitted.baseline, fitted.scores(matrix)
        lasts = matrix.groupBy("run_id").agg(F.max("sample_index").alias("last"))
        own = events.event_windows(scores, self.confirm, self.separate, self.flush).withColumn("event_id", C.event_name("event_number"))
        self.tables = {
            "samples": matrix.select("run_id", "sample_index").join(lasts, "run_id"),
            "sensor_long": tables.to_long(matrix),
            "baseline": base,
            "windows": windows.index(matrix, self.size, self.stride),
            "scores": scores,
            "event_windows": own,
            "anomaly_events": events.summary(own),
        }
        if followups is not None:
            self.tables["followups"] = followups
        for name, table in self.tables.items():
            table.createOrReplaceTempView(name)
        return self.tables
