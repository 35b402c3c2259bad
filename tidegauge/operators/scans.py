"""Scans along long runs, on two levels.

A run is cut into buckets of ``bucket`` numbers. Rows of a bucket are ordered by themselves; each bucket gives one row
that tells what later (or earlier) ones need, and a window over a run's bucket rows carries that along. So no task
orders a run, only its buckets' rows. All frames grow with the rows; those that look ahead do so in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000


def in_buckets(rows: DataFrame, order: str, bucket: int) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col(order) / bucket))


def known(rows: DataFrame, keys: list[str], order: str, value: Column, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with back and ahead: the last non-null ``value`` up to a row and the first from it on, along ``order``."""
    cut = in_buckets(rows, order, bucket).withColumn("own", value)
    by = [*keys, "bucket"]
    has = F.when(F.col("own").isNotNull(), F.col(order))
    pieces = cut.groupBy(*by).agg(F.min_by("own", has).alias("first"), F.max_by("own", has).alias("last"))
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(*by, F.last("last", ignorenulls=True).over(up).alias("before"), F.last("first", ignorenulls=True).over(down).alias("behind"))
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    told = cut.join(carried, by).withColumn("back", F.coalesce(F.last("own", ignorenulls=True).over(up), "before"))
    told = told.withColumn("ahead", F.coalesce(F.last("own", ignorenulls=True).over(down), "behind"))
    return told.drop("bucket", "own", "before", "behind")


def placed(rows: DataFrame, keys: list[str], order: str, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with place: how many rows of the same keys come before one along ``order``, which is unique among them."""
    cut = in_buckets(rows, order, bucket)
    by = [*keys, "bucket"]
    line = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    bases = pieces.select(*by, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return cut.join(bases, by).withColumn("place", (F.col("base") + own - 1).cast("long")).drop("bucket", "base")


def overlapping(rows: DataFrame, order: str, before: int, bucket: int = BUCKET) -> DataFrame:
    """``rows`` dealt to buckets, each with the ``before`` numbers ahead of it; ``here`` is whether a row is the bucket's own."""
    at = F.col(order)
    spread = rows.withColumn("bucket", F.explode(F.sequence(F.floor(at / bucket), F.floor((at + before) / bucket))))
    return spread.withColumn("here", F.floor(at / bucket) == F.col("bucket"))
