"""Repair of missing values in long grids (run_id, sample_index, name, value), by buckets of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import scans

STRATEGIES = ("drop", "ffill", "interpolate")


def clean(grid: DataFrame) -> DataFrame:
    """NaN is null."""
    return grid.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def drop(grid: DataFrame, bucket: int = scans.BUCKET) -> DataFrame:
    """Samples without any null, numbered anew."""
    whole = grid.groupBy("run_id", "sample_index").agg(F.bool_and(F.col("value").isNotNull()).alias("whole")).where("whole").drop("whole")
    return grid.join(scans.placed(whole, ["run_id"], "sample_index", bucket), ["run_id", "sample_index"]).select("run_id", F.col("place").alias("sample_index"), "name", "value")


def ffill(grid: DataFrame, bucket: int = scans.BUCKET) -> DataFrame:
    """The last value before, or at the start the first one behind."""
    told = scans.known(grid, ["run_id", "name"], "sample_index", F.col("value"), bucket)
    return told.withColumn("value", F.coalesce("back", "ahead")).select(*grid.columns)


def interpolate(grid: DataFrame, bucket: int = scans.BUCKET) -> DataFrame:
    """Linear by position between neighbours that have values; ends take the nearest."""
    at = F.when(F.col("value").isNotNull(), F.struct(F.col("sample_index").alias("i"), F.col("value").alias("v")))
    near = scans.known(grid, ["run_id", "name"], "sample_index", at, bucket)
    a, b = F.col("back"), F.col("ahead")
    between = a["v"] + (b["v"] - a["v"]) * ((F.col("sample_index") - a["i"]) / (b["i"] - a["i"]))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)
    return near.withColumn("value", value).select(*grid.columns)


def repair(grid: DataFrame, strategy: str, bucket: int = scans.BUCKET) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    return {"drop": drop, "ffill": ffill, "interpolate": interpolate}[strategy](clean(grid), bucket)


def repair_matrix(matrix: DataFrame, strategy: str, features: int | None = None, bucket: int = scans.BUCKET) -> DataFrame:
    """A matrix (run_id, sample_index, values, ...) repaired sensor by sensor; ``features`` truncates its vectors after that.

    Columns besides the vector stay with their sample; ``drop`` numbers the samples that stay anew.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    rest = [c for c in matrix.columns if c not in ("run_id", "sample_index", "values")]
    if strategy == "drop":
        # a sample is whole or not by itself, so vectors are neither taken apart nor put together
        whole = matrix.where(F.col("values").isNotNull() & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v)))
        out = scans.placed(whole, ["run_id"], "sample_index", bucket).withColumn("sample_index", F.col("place")).drop("place")
    else:
        long = matrix.select("run_id", "sample_index", F.posexplode("values").alias("name", "value"))
        cells = repair(long, strategy, bucket).groupBy("run_id", "sample_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "value"))), lambda x: x["value"]).alias("values"))
        out = matrix.drop("values").join(cells, ["run_id", "sample_index"])
    values = F.col("values") if features is None else F.slice("values", 1, features)
    return out.select("run_id", "sample_index", values.alias("values"), *rest)
