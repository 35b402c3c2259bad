"""Scores of windows against the baseline, thresholds and flags.

The default scorer predicts every sensor's normal mean, so a window's error is the mean of squared z over its samples
and its score the mean over sensors. Both are averages of per-sample terms, so a rolling frame gives them without
copying samples into windows. ``PCAScorer`` is the plug-in for correlated sensors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import scaling, selection, windows


def squared(long: DataFrame, base: DataFrame) -> DataFrame:
    """run_id, sample_index, sensor, value, q: squared z."""
    z = C.standard("value", "mean", "std")
    return long.join(base, "sensor").select("run_id", "sample_index", "sensor", "value", (z * z).alias("q"))


def window_errors(terms: DataFrame, size: int, stride: int, bucket: int = windows.BUCKET, phase: str = "full") -> DataFrame:
    """run_id, sensor, window_id, start_sample, end_sample, error, mean_value."""
    return windows.rolling(terms, size, stride, ["run_id", "sensor"], {"error": F.col("q"), "mean_value": F.col("value")}, bucket, phase)


def window_scores(terms: DataFrame, size: int, stride: int, bucket: int = windows.BUCKET, phase: str = "full") -> DataFrame:
    """run_id, window_id, start_sample, end_sample, score, from ``squared`` terms."""
    samples = terms.groupBy("run_id", "sample_index").agg(F.avg("q").alias("q"))
    return windows.rolling(samples, size, stride, ["run_id"], {"score": F.col("q")}, bucket, phase)


def matrix_scores(matrix: DataFrame, base: DataFrame, size: int, stride: int, bucket: int = windows.BUCKET, phase: str = "full") -> DataFrame:
    """``window_scores`` of a matrix: a sample's term is summed within its row against the baseline's few numbers, so
    samples are neither exploded nor shuffled to be put together again. A vector whose length is not the baseline's is
    an error; null components make no term, and a sample without any has no score."""
    known = base.orderBy("sensor").select("mean", "std").collect()  # a row a sensor
    means, scales = F.lit([b["mean"] for b in known]), F.lit([b["std"] or 1.0 for b in known])
    z = F.zip_with(F.zip_with("values", means, lambda v, m: v - m), scales, lambda x, s: x / s)
    terms = F.filter(z, lambda x: x.isNotNull())
    mean = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(terms), F.lit(0))
    wrong = F.raise_error(F.lit(f"a vector has not the {len(known)} components of the baseline")).cast("double")
    q = F.when(F.col("values").isNull(), F.lit(None).cast("double")).when(F.size("values") == len(known), mean).otherwise(wrong)
    return windows.rolling(matrix, size, stride, ["run_id"], {"score": q}, bucket, phase)


ERRORS = "run_id string, window_id long, start_sample long, end_sample long, errors array<double>, means array<double>"
ERROR_BUCKET = 16_384


def matrix_errors(matrix: DataFrame, base: DataFrame, size: int, stride: int, bucket: int = ERROR_BUCKET, phase: str = "full") -> DataFrame:
    """run_id, window_id, start_sample, end_sample, and the error and the mean of each sensor over the window, as arrays.

    Samples stay vectors: a row a window leaves a task instead of one a sample and sensor. Null components count for
    nothing; a sensor without any value in a window has a null there.
    """
    known = base.orderBy("sensor").select("mean", "std").collect()  # a row a sensor
    mean, scale = np.array([b["mean"] for b in known], float), np.array([b["std"] or 1.0 for b in known], float)
    first = windows.first_end(size, stride, phase) - 1

    def run(groups):
        for name, at, x, ends in groups:
            if x.shape[1] != len(mean):
                raise ValueError(f"a vector has {x.shape[1]} components, the baseline has {len(mean)}")
            if not len(ends):
                continue
            has = ~np.isnan(x)
            sums = [np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(np.where(has, v, 0.0), 0)]) for v in (1.0, np.square((x - mean) / scale), x - mean)]
            n, error, value = (s[ends + 1] - s[ends + 1 - size] for s in sums)
            with np.errstate(invalid="ignore", divide="ignore"):
                error, value = np.maximum(error, 0) / n, mean + value / n
            lists = [pa.ListArray.from_arrays(np.arange(len(ends) + 1) * len(mean), pa.array(v.ravel(), mask=n.ravel() == 0)) for v in (error, value)]
            columns = [pa.array([name] * len(ends)), pa.array((at[ends] - first) // stride), pa.array(at[ends] - size + 1), pa.array(at[ends]), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ERRORS.split(", ")])

    return windows.by_buckets(matrix, size, stride, phase, run, ERRORS, bucket)


def by_sensor(errors: DataFrame) -> DataFrame:
    """Rows of ``matrix_errors`` with sensor, error and mean_value in place of the arrays."""
    rest = [c for c in errors.columns if c not in ("errors", "means")]
    told = errors.select(*rest, F.posexplode(F.arrays_zip("errors", "means")).alias("sensor", "w"))
    return told.select(*rest, "sensor", F.col("w.errors").alias("error"), F.col("w.means").alias("mean_value"))


def record_results(matrix: DataFrame, base: DataFrame, limit: float, size: int, stride: int) -> DataFrame:
    """What each record tells when it comes: run_id, sample_index, window_id (counts full buffers; null in the warm-up),
    score (null unless the record's number is a multiple of the stride) and anomalous (false where nothing is scored)."""
    i = F.col("sample_index")
    scores = matrix_scores(matrix, base, size, stride, phase="stride").select("run_id", F.col("end_sample").alias("sample_index"), "score")
    told = matrix.select("run_id", "sample_index").join(scores, ["run_id", "sample_index"], "left")
    return told.select("run_id", "sample_index", F.when(i >= size - 1, i - (size - 1)).alias("window_id"), "score", F.coalesce(F.col("score") > limit, F.lit(False)).alias("anomalous"))


METHODS = ("percentile", "validation_percentile", "mean_std")
STATS = "n long, mean_score double, std_score double, max_score double"


def _stats(scores: DataFrame):
    return scores.agg(F.count("score").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.max("score").alias("max_score")).first()


def threshold(scores: DataFrame, method: str = "percentile", percentile: float = 99.0, k: float = 3.0) -> DataFrame:
    """One row: threshold, method, n, mean_score, std_score, max_score. Fit on scores of normal windows.

    A percentile is exact and comes from ``selection``, so it runs jobs when it is called.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {sorted(METHODS)}")
    told = _stats(scores)
    if method == "mean_std":
        limit = told["mean_score"] + k * told["std_score"] if told["n"] else None
    else:
        (limit,) = selection.percentiles(scores, "score", [percentile / 100], told["n"])
    return scores.sparkSession.createDataFrame([(limit, method, *told)], f"threshold double, method string, {STATS}")


def threshold_value(scores: DataFrame, **options) -> float:
    """The threshold as a number; no scores are an error."""
    row = threshold(scores, **options).first()
    if not row["n"]:
        raise ValueError("no scores to derive a threshold from")
    return row["threshold"]


def summary(scores: DataFrame) -> DataFrame:
    """One row: n, mean_score, std_score, max_score, p99."""
    told = _stats(scores)
    return scores.sparkSession.createDataFrame([(*told, *selection.percentiles(scores, "score", [0.99], told["n"]))], f"{STATS}, p99 double")


def flagged(scores: DataFrame, limit: float) -> DataFrame:
    """``scores`` with threshold and anomalous (strictly above it)."""
    return scores.withColumn("threshold", F.lit(limit)).withColumn("anomalous", F.col("score") > F.lit(limit))


class PCAScorer:
    """Reconstruction from the leading components of the scaled sensors' covariance.

    Fitting sums outer products on the executors; the covariance has sensors x sensors cells whatever the rows.
    """

    def __init__(self, components: int):
        self.n, self.mean, self.std, self.axes = components, None, None, None

    def fit(self, matrix: DataFrame) -> PCAScorer:
        def moments(batches):
            total = None
            for batch in batches:
                x = np.array(batch["values"].to_pylist(), float)
                if len(x):
                    own = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = matrix.select("values").mapInArrow(moments, "sums array<double>")
        sums = parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k")
        flat = np.array([r["v"] for r in sums.toLocalIterator()])  # 1 + F + F * F numbers
        f = round((-1 + np.sqrt(4 * len(flat) - 3)) / 2)
        n, self.mean = flat[0], flat[1 : 1 + f] / flat[0]
        covariance = flat[1 + f :].reshape(f, f) / n - np.outer(self.mean, self.mean)
        self.std = np.sqrt(np.maximum(np.diag(covariance), 0))
        scale = np.where(self.std == 0, 1, self.std)
        _, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
        self.axes = vectors[:, ::-1][:, : self.n]
        return self

    def saved(self) -> dict:
        """The fitted scorer as plain numbers, for ``artifacts.save``."""
        return {"components": self.n, "mean": self.mean.tolist(), "std": self.std.tolist(), "axes": self.axes.tolist()}

    @classmethod
    def restored(cls, numbers: dict) -> PCAScorer:
        own = cls(numbers["components"])
        own.mean, own.std, own.axes = (np.asarray(numbers[k], float) for k in ("mean", "std", "axes"))
        return own

    def terms(self, matrix: DataFrame) -> DataFrame:
        """run_id, sample_index, q: mean squared residual of a sample; feed for ``windows.rolling``."""
        mean, scale, axes = self.mean, np.where(self.std == 0, 1, self.std), self.axes

        def run(batches):
            for batch in batches:
                z = (np.array(batch["values"].to_pylist(), float).reshape(batch.num_rows, -1) - mean) / scale
                rest = z - z @ axes @ axes.T
                yield pa.RecordBatch.from_arrays([batch["run_id"], batch["sample_index"], pa.array((rest * rest).mean(1))], names=["run_id", "sample_index", "q"])

        return matrix.select("run_id", "sample_index", "values").mapInArrow(run, "run_id string, sample_index long, q double")

    def scores(self, matrix: DataFrame, size: int, stride: int) -> DataFrame:
        return windows.rolling(self.terms(matrix), size, stride, ["run_id"], {"score": F.col("q")})


def fit_and_score(long: DataFrame, size: int, stride: int, normal: DataFrame | None = None) -> DataFrame:
    """Baseline over ``normal`` (all rows by default), then window scores."""
    return window_scores(squared(long, scaling.baseline(normal if normal is not None else long)), size, stride)
