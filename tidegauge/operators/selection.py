"""Exact order statistics of a column of any length.

Ranks are found by ranges: approximate quantiles cut the values into ranges (each cut is a range of its own, so ties do
not stay together with others), the ranges are counted, and only the one that holds a rank is looked into; it is cut again while it has
more than ``BOUND`` rows. No task sorts more than that, and the driver sees a row a range.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 256
BOUND = 1_000_000


def _at(rows: DataFrame, ranks: list[int], n: int, bound: int, ranges: int) -> dict[int, float]:
    """Values of ``rows`` (v, n of them) at these ranks, from 0."""
    if n <= bound:
        ordered = rows.agg(F.sort_array(F.collect_list("v")).alias("v"))
        return dict(zip(ranks, ordered.select(*[F.element_at("v", k + 1).alias(f"r{k}") for k in ranks]).first(), strict=True))
    cuts = rows.agg(F.percentile_approx("v", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(40 * ranges))).first()[0]
    cuts = F.lit(sorted(set(cuts)))
    # even numbers lie between two cuts, odd ones are a cut
    place: Column = F.size(F.filter(cuts, lambda c: c < F.col("v"))) * 2 + F.array_contains(cuts, F.col("v")).cast("int")
    placed = rows.withColumn("range", place)
    told = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("range").collect()  # a row a range
    out, before = {}, 0
    for r in told:
        own = [k for k in ranks if before <= k < before + r["n"]]
        if own and r["low"] == r["high"]:
            out |= dict.fromkeys(own, r["low"])
        elif own:
            inner = _at(placed.where(F.col("range") == r["range"]).select("v"), [k - before for k in own], r["n"], bound, ranges)
            out |= {k + before: v for k, v in inner.items()}
        before += r["n"]
    return out


def percentiles(rows: DataFrame, column: str, shares: list[float], n: int | None = None, bound: int = BOUND, ranges: int = RANGES) -> list[float | None]:
    """Exact percentiles (shares of 1), linear between neighbours, of the non-null values; None where there are none.
    ``n`` is their number, where it is known."""
    own = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = own.count() if n is None else n
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    ranks = sorted({k for p in places for k in (floor(p), ceil(p))})
    at = _at(own, ranks, n, bound, ranges)
    value = lambda p, a, b: at[a] if at[a] == at[b] else (b - p) * at[a] + (p - a) * at[b]
    return [value(p, floor(p), ceil(p)) for p in places]
