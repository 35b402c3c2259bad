"""Tables in the shapes the operators take.

matrix: run_id, sample_index, values (array<double>), fault_label - a row a sample, in time order.
long:   run_id, sample_index, sensor, value - a row a sample and sensor.
grid:   run_id, sample_index, bucket, and a nullable column for each kind of event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run from ``embeddings``: its ids are sample numbers, its components sensors."""
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.lit("run0").alias("run_id"), F.col("vec_id").alias("sample_index"), values.alias("values"), F.col("label").alias("fault_label"))


def to_long(matrix: DataFrame) -> DataFrame:
    return matrix.select("run_id", "sample_index", F.posexplode("values").alias("sensor", "value"))


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value of each kind of event an hour; hours without any event are no rows, as positions count samples."""
    events = table(spark, sf_dir, "events").withColumn("bucket", F.date_trunc("hour", F.col("ts")))
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful of kinds
    cells = [F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(kind) for kind in kinds]
    hours = events.groupBy("bucket").agg(*cells)
    return hours.select(F.lit("run0").alias("run_id"), (F.row_number().over(Window.partitionBy(F.lit("run0")).orderBy("bucket")) - 1).cast("long").alias("sample_index"), "bucket", *kinds)


def grid_long(grid: DataFrame) -> DataFrame:
    """run_id, sample_index, name, value (nullable) of a grid."""
    kinds = [c for c in grid.columns if c not in ("run_id", "sample_index", "bucket")]
    return grid.unpivot(["run_id", "sample_index"], kinds, "name", "value")


def vector(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])
