"""The library as one object: fit on normal runs, detect, explain, watch streams, keep events, ask by SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions import columns as C
from tidegauge.operators import events, evidence, reports, scaling, scoring, store
from tidegauge.plans.views import Views
from tidegauge.sources import artifacts, tables
from tidegauge.streaming import detector, online

SETTINGS = {"size": 60, "stride": 5, "percentile": 99.0, "confirm": 3, "separate": 20, "flush": True}


class Monitor:
    """A fitted detector with its settings: size, stride, percentile, confirm, separate, flush."""

    def __init__(self, fitted: artifacts.Fitted):
        self.fitted, self.settings = fitted, artifacts.merged(SETTINGS, fitted.settings)

    @classmethod
    def fit(cls, normal: DataFrame, scorer=None, **settings) -> Monitor:
        """From a matrix of normal runs: baseline, threshold, and a scorer (``PCAScorer``, ``RecurrentScorer``) where one is given."""
        own = artifacts.merged(SETTINGS, settings)
        base = scaling.baseline(tables.to_long(normal))
        fitted = artifacts.Fitted(base, 0.0, own, scorer)
        found = scorer.scores(normal, own["size"], own["stride"]) if scorer else scoring.matrix_scores(normal, base, own["size"], own["stride"])
        fitted.threshold = scoring.threshold_value(found, percentile=own["percentile"])
        return cls(fitted)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Monitor:
        return cls(artifacts.load(spark, path))

    def save(self, path: str) -> None:
        artifacts.save(self.fitted, path)

    def scores(self, matrix: DataFrame) -> DataFrame:
        return self.fitted.scores(matrix)

    def event_windows(self, matrix: DataFrame) -> DataFrame:
        s = self.settings
        return events.event_windows(self.scores(matrix), s["confirm"], s["separate"], s["flush"])

    def events(self, matrix: DataFrame) -> DataFrame:
        return events.summary(self.event_windows(matrix))

    def evidence(self, matrix: DataFrame) -> DataFrame:
        """A row an event with its evidence."""
        s, own = self.settings, self.event_windows(matrix)
        errors = scoring.matrix_errors(matrix, self.fitted.baseline, s["size"], s["stride"])
        rows = scoring.by_sensor(errors.join(own.select("run_id", "window_id", "rn", C.event_name("event_number").alias("event_id")), ["run_id", "window_id"]))
        return evidence.documents(rows, self.fitted.baseline, events.summary(own), s["stride"])

    def reports(self, matrix: DataFrame, model: Callable | None = None) -> DataFrame:
        """Evidence and report of each event, by a text model where one is given."""
        return reports.model_reports(self.evidence(matrix), model) if model else reports.reports(self.evidence(matrix))

    def watch(self, stream: DataFrame, kept: store.EventStore, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
        """Run a stream of records; events that close go to the store with evidence and report."""
        s, base, limit = self.settings, self.fitted.baseline, self.fitted.threshold
        found = detector.events(stream, base, limit, s["size"], s["stride"], s["confirm"], s["separate"], **options)
        return online.start(found, base, limit, kept, checkpoint, s["stride"], once=once)

    def views(self, matrix: DataFrame, followups: DataFrame | None = None) -> dict[str, DataFrame]:
        """Temporary views of a matrix for SQL, scored by this detector."""
        s = self.settings
        return Views(s["size"], s["stride"], s["percentile"], s["confirm"], s["separate"], s["flush"]).register(matrix, followups=followups, fitted=self.fitted)
