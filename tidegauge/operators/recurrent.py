"""A recurrent scorer: a sequence encoder and decoder (long short-term memory) that reconstruct whole windows.

Weights are plain arrays that an artifact holds, in the usual layout: for each layer w_in (4h x inputs), w_own (4h x h),
b_in and b_own, gates in order input, forget, cell, output. They come from elsewhere, or ``fit`` draws recurrent
weights from a seed and trains the read-out by least squares over all windows (sums of outer products, made on the
executors). A run is cut into buckets; a task takes a bucket's samples, with the ones before that its first windows need, and runs all
their windows side by side as matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import windows

BATCH = 1024  # windows side by side
BUCKET = 4096  # samples


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _layer(x: np.ndarray | None, steps: int, w: dict, h: np.ndarray, c: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(outputs of all steps, last output) of one layer over x (windows, steps, inputs); None is an input of zeros."""
    k, out = h.shape[1], np.empty((len(h), steps, h.shape[1]))
    fed = None if x is None else x @ w["w_in"].T
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        gates = h @ w["w_own"].T + w["b_in"] + w["b_own"]
        if fed is not None:
            gates = gates + fed[:, t]
        i, f, o = (_sigmoid(gates[:, a * k : a * k + k]) for a in (0, 1, 3))
        c = f * c + i * np.tanh(gates[:, 2 * k : 3 * k])
        h = o * np.tanh(c)
        out[:, t] = h
    return out, h


def encoded(x: np.ndarray, weights: dict) -> np.ndarray:
    """Latent vectors of windows (n, steps, features): the last layer's last output (of both directions), projected."""
    for layer in weights["encoder"]:
        parts = [_layer(x, x.shape[1], w, *[np.zeros((len(x), w["w_own"].shape[1]))] * 2, backward=bool(k)) for k, w in enumerate(layer)]
        x = np.concatenate([out for out, _ in parts], 2)
    last = parts[-1][1] if len(parts) == 1 else parts[1][1]
    return (last if len(parts) == 1 else np.concatenate([parts[0][1], last], 1)) @ weights["project"]["w"].T + weights["project"]["b"]


def decoded(latent: np.ndarray, steps: int, weights: dict) -> np.ndarray:
    """Outputs of the last layer of the decoder (n, steps, hidden): the latent vector gives the first state of each layer."""
    start = latent @ weights["start"]["w"].T + weights["start"]["b"]
    k = weights["decoder"][0]["w_own"].shape[1]
    # each window's own projection gives the states of its layers, so a window's score does not depend on those beside it
    first = start.reshape(len(latent), len(weights["decoder"]), k).transpose(1, 0, 2)
    x = None
    for w, h in zip(weights["decoder"], first, strict=True):
        x, _ = _layer(x, steps, w, h, np.zeros_like(h))
    return x


def _drawn(rng, hidden: int, inputs: int) -> dict:
    bound = 1 / np.sqrt(hidden)
    bias = np.repeat([0.0, 2.0, 0.0, 0.0], hidden)  # forget gates begin open, so that a window's beginning is not lost
    return {"w_in": rng.uniform(-bound, bound, (4 * hidden, inputs)), "w_own": rng.uniform(-bound, bound, (4 * hidden, hidden)), "b_in": bias, "b_own": np.zeros(4 * hidden)}


def drawn(features: int, hidden: int = 32, layers: int = 2, latent: int = 16, both: bool = False, seed: int = 0) -> dict:
    """Weights from a seed: an encoder (``both``: of two directions) and a decoder; the read-out is zero."""
    rng = np.random.default_rng(seed)
    ways = 2 if both else 1
    line = lambda out, inputs: {"w": rng.uniform(-1, 1, (out, inputs)) / np.sqrt(inputs), "b": np.zeros(out)}
    return {
        "encoder": [[_drawn(rng, hidden, features if k == 0 else hidden * ways) for _ in range(ways)] for k in range(layers)],
        "project": line(latent, hidden * ways),
        "start": line(hidden * layers, latent),
        "decoder": [_drawn(rng, hidden, features if k == 0 else hidden) for k in range(layers)],
        "out": {"w": np.zeros((features, hidden)), "b": np.zeros(features)},
    }


def _plain(x):
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else [_plain(v) for v in x] if isinstance(x, list) else np.asarray(x).tolist()


def _arrays(x):
    if isinstance(x, dict):
        return {k: np.asarray(v, float) if k in ("w", "b", "w_in", "w_own", "b_in", "b_own") else _arrays(v) for k, v in x.items()}
    return [_arrays(v) for v in x]


class RecurrentScorer:
    """Scores of windows by how well they are reconstructed; the interface is that of ``scoring.PCAScorer``."""

    def __init__(self, weights: dict, mean, std):
        self.weights, self.mean, self.std = weights, np.asarray(mean, float), np.asarray(std, float)

    @classmethod
    def fit(cls, matrix: DataFrame, base: DataFrame, size: int, stride: int, ridge: float = 1e-3, **shape) -> RecurrentScorer:
        """Scaling from ``base``, recurrent weights from a seed, the read-out by least squares over the matrix's windows."""
        known = base.orderBy("sensor").select("mean", "std").collect()  # a row a sensor
        own = cls(drawn(len(known), **shape), [r["mean"] for r in known], [r["std"] for r in known])
        weights, n = own.weights, own.weights["decoder"][0]["w_own"].shape[1] + 1

        def sums(groups):
            total = None
            for _, _, x in groups:
                h = decoded(encoded(x, weights), x.shape[1], weights).reshape(-1, n - 1)
                h = np.concatenate([h, np.ones((len(h), 1))], 1)
                part = np.concatenate([(h.T @ h).ravel(), (h.T @ x.reshape(len(h), -1)).ravel()])
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        parts = own._over_windows(matrix, size, stride, "full", sums, "sums array<double>")
        flat = np.array([r["v"] for r in parts.select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toLocalIterator()])
        if len(flat):  # hidden x (hidden + sensors) numbers
            solved = np.linalg.solve(flat[: n * n].reshape(n, n) + ridge * np.eye(n), flat[n * n :].reshape(n, -1))
            weights["out"] = {"w": solved[:-1].T.copy(), "b": solved[-1].copy()}
        return own

    def saved(self) -> dict:
        """The scorer as plain numbers, for ``artifacts.save``."""
        return {"kind": "recurrent", "weights": _plain(self.weights), "mean": self.mean.tolist(), "std": self.std.tolist()}

    @classmethod
    def restored(cls, numbers: dict) -> RecurrentScorer:
        return cls(_arrays(numbers["weights"]), numbers["mean"], numbers["std"])

    def rebuilt(self, x: np.ndarray) -> np.ndarray:
        """Reconstruction of scaled windows (n, steps, features)."""
        return decoded(encoded(x, self.weights), x.shape[1], self.weights) @ self.weights["out"]["w"].T + self.weights["out"]["b"]

    def _over_windows(self, matrix: DataFrame, size: int, stride: int, phase: str, run, schema: str, bucket: int = BUCKET) -> DataFrame:
        """``run`` over (run_id, ends, scaled windows) of at most ``BATCH`` windows each, bucket by bucket."""
        mean, scale = self.mean, np.where(self.std == 0, 1.0, self.std)

        def cut(groups):
            for name, at, x, ends in groups:
                z = (x - mean) / scale
                for k in range(0, len(ends), BATCH):
                    own = ends[k : k + BATCH]
                    yield name, at[own], z[own[:, None] - np.arange(size - 1, -1, -1)]

        return windows.by_buckets(matrix, size, stride, phase, lambda groups: run(cut(groups)), schema, bucket)

    def errors(self, matrix: DataFrame, size: int, stride: int, phase: str = "full", bucket: int = BUCKET) -> DataFrame:
        """run_id, window_id, start_sample, end_sample, errors: the mean squared error of each sensor over a window."""
        first = windows.first_end(size, stride, phase) - 1
        names = ["run_id", "window_id", "start_sample", "end_sample", "errors"]

        def run(groups):
            for name, ends, x in groups:
                told = np.square(x - self.rebuilt(x)).mean(1)
                columns = [pa.array([name] * len(ends)), pa.array((ends - first) // stride), pa.array(ends - size + 1), pa.array(ends), pa.array(told.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return self._over_windows(matrix, size, stride, phase, run, "run_id string, window_id long, start_sample long, end_sample long, errors array<double>", bucket)

    def scores(self, matrix: DataFrame, size: int, stride: int, phase: str = "full", bucket: int = BUCKET) -> DataFrame:
        """run_id, window_id, start_sample, end_sample, score: the mean over sensors."""
        told = self.errors(matrix, size, stride, phase, bucket)
        return told.select("run_id", "window_id", "start_sample", "end_sample", (F.aggregate("errors", F.lit(0.0), lambda a, x: a + x) / F.size("errors")).alias("score"))
