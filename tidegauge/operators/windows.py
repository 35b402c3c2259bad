"""Count-based sliding windows.

A window holds ``size`` consecutive samples of a run and is named by its first one; starts are 0, stride, 2 stride and
so on, and an incomplete tail has no window. Frames never gather a run in one task: a run is cut into buckets of
samples, and the size - 1 samples before a bucket are dealt to it too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import scans

BUCKET = 100_000


def rolling(rows: DataFrame, size: int, stride: int, keys: list[str], values: dict[str, Column], bucket: int = BUCKET, phase: str = "full") -> DataFrame:
    """keys, window_id, start_sample, end_sample and means over each window, by frame: ``values`` names them.

    ``rows`` has run_id and sample_index, dense from 0. ``values`` are expressions of a row. ``phase`` is that of ``index``.
    """
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    i = F.col("sample_index")
    own = rows.select(*keys, i, *[v.alias(k) for k, v in values.items()])
    spread = own.withColumn("bucket", F.explode(F.sequence(F.floor(i / bucket), F.floor((i + size - 1) / bucket))))
    frame = Window.partitionBy(*keys, "bucket").orderBy("sample_index").rowsBetween(-(size - 1), 0)
    framed = spread.select(*keys, i, "bucket", *[F.avg(k).over(frame).alias(k) for k in values])
    first = first_end(size, stride, phase) - 1
    ends = framed.where((F.floor(i / bucket) == F.col("bucket")) & (i >= first) & ((i - first) % stride == 0))
    start = i - (size - 1)
    return ends.select(*keys, F.floor((i - first) / stride).cast("long").alias("window_id"), start.alias("start_sample"), i.alias("end_sample"), *values)


def first_end(size: int, stride: int, phase: str) -> int:
    """Samples up to the end of a run's first window; phase "full" or "stride"."""
    if phase not in ("full", "stride"):
        raise ValueError(f"phase {phase!r} is neither 'full' nor 'stride'")
    return size if phase == "full" else -(-size // stride) * stride


def exploded(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """A row for each sample and window that holds it, for models that need whole windows: window_id, pos.

    An equi-join key instead of a range join. Windows past the end of a run are left out.
    """
    i = F.col("sample_index")
    last = rows.groupBy("run_id").agg(F.max("sample_index").alias("last"))
    first = F.greatest(F.ceil((i - size + 1) / stride), F.lit(0))
    spread = rows.join(last, "run_id").withColumn("window_id", F.explode(F.when(first <= F.floor(i / stride), F.sequence(first, F.floor(i / stride))).otherwise(F.array().cast("array<bigint>"))))
    return spread.where(F.col("window_id") * stride + size - 1 <= F.col("last")).withColumn("pos", i - F.col("window_id") * stride).drop("last")


def gathered(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """run_id, window_id, values: whole windows, each an array of its samples' vectors in order."""
    spread = exploded(rows.select("run_id", "sample_index", "values"), size, stride)
    one = spread.groupBy("run_id", "window_id").agg(F.sort_array(F.collect_list(F.struct("pos", "values"))).alias("w"))
    return one.select("run_id", "window_id", F.col("w.values").alias("values"))


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Cut runs into blocks that no window crosses: run_id becomes run:block, sample_index starts anew."""
    number = F.floor(F.col("sample_index") / block)
    return rows.withColumn("segment", number).withColumn("run_id", F.concat_ws(":", "run_id", number.cast("string"))).withColumn("sample_index", F.col("sample_index") % block)


def by_buckets(matrix: DataFrame, size: int, stride: int, phase: str, run, schema: str, bucket: int) -> DataFrame:
    """``run`` over groups (run_id, samples, vectors, own) of a matrix in Arrow batches: the samples of a bucket and the
    size - 1 before it, in order, their vectors (nulls are NaN), and places where a window of this bucket ends."""
    first = first_end(size, stride, phase) - 1

    def group(table: pa.Table):
        at, lists = table["sample_index"].to_numpy(), table["values"].combine_chunks()
        sizes = np.asarray(pc.list_value_length(lists).fill_null(0))
        if len(np.unique(sizes)) > 1:
            raise ValueError(f"vectors of a run have from {sizes.min()} to {sizes.max()} components")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
        ends = (at >= max(first, size - 1)) & ((at - first) % stride == 0) & (at // bucket == table["bucket"][0].as_py()) & (np.arange(len(at)) >= size - 1)
        return table["run_id"][0].as_py(), at, x, np.flatnonzero(ends)

    def groups(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            if not table.num_rows:
                continue
            names, numbers = np.array(table["run_id"].to_pylist(), object), table["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield group(table.slice(a, b - a))
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield group(held)

    rows = scans.overlapping(matrix.select("run_id", "sample_index", "values"), "sample_index", size - 1, bucket).drop("here")
    return rows.repartition("run_id", "bucket").sortWithinPartitions("run_id", "bucket", "sample_index").mapInArrow(lambda batches: run(groups(batches)), schema)


def index(rows: DataFrame, size: int, stride: int, phase: str = "full") -> DataFrame:
    """run_id, window_id, start_sample, end_sample of all windows, from the runs' lengths alone.

    phase "full": the first window ends at sample ``size``; "stride": windows end at multiples of the stride.
    """
    runs = rows.groupBy("run_id").agg((F.max("sample_index") + 1).alias("n"))
    first = first_end(size, stride, phase)
    ends = F.when(F.col("n") >= first, F.sequence(F.lit(first).cast("long"), F.col("n"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return runs.select("run_id", F.posexplode(ends).alias("window_id", "stop")).select("run_id", F.col("window_id").cast("long").alias("window_id"), (F.col("stop") - size).alias("start_sample"), (F.col("stop") - 1).alias("end_sample"))


def replay_index(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows of a replayed run: they never skip samples (the step is at most the size), and window_id counts strides
    of the records read so far, so it has gaps or repeats where stride and size differ much."""
    return index(rows, size, min(stride, size)).withColumn("window_id", F.floor((F.col("end_sample") + 1) / stride).cast("long"))


def split_segments(segments: list[int], validation: float, test: float, seed: int) -> dict[int, str]:
    """Whole segments to train, val and test. The order is a seeded shuffle of the classic Mersenne generator."""
    order = list(segments)
    np.random.RandomState(seed).shuffle(order)
    n_test, n_val = round(len(order) * test), round(len(order) * validation)
    return {s: "test" if k < n_test else "val" if k < n_test + n_val else "train" for k, s in enumerate(order)}


def with_split(rows: DataFrame, assignment: dict[int, str]) -> DataFrame:
    """``rows`` (with segment) and their split."""
    table = rows.sparkSession.createDataFrame(sorted(assignment.items()), "segment long, split string")
    return rows.join(table, "segment")
