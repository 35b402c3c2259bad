"""Column expressions: deviations, severity, counters, text normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def standard(value, mean, std) -> Column:
    """z with a constant sensor left at scale 1."""
    return (F.col(value) - F.col(mean)) / F.when(F.col(std) == 0, 1.0).otherwise(F.col(std))


def min_max(value, low, high) -> Column:
    span = F.col(high) - F.col(low)
    return (F.col(value) - F.col(low)) / F.when(span == 0, 1.0).otherwise(span)


def unscaled(value, mean, std) -> Column:
    """Inverse of ``standard``."""
    return F.col(value) * F.when(F.col(std) == 0, 1.0).otherwise(F.col(std)) + F.col(mean)


def z_score(value, mean, std) -> Column:
    return (F.col(value) - F.col(mean)) / (F.col(std) + EPSILON)


def percent_deviation(value, mean, std) -> Column:
    """Percent of the mean; where that is nearly 0, hundredfold z."""
    return F.when(F.abs(F.col(mean)) > EPSILON, (F.col(value) - F.col(mean)) / F.col(mean) * 100).otherwise(z_score(value, mean, std) * 100)


def severity(score, threshold) -> Column:
    ratio = F.col(score) / F.greatest(F.col(threshold), F.lit(1e-9))
    return F.when(ratio >= 3.0, "critical").when(ratio >= 1.8, "high").when(ratio >= 1.2, "medium").otherwise("low")


def event_name(number) -> Column:
    return F.format_string("ANOM-%04d", number)


def normalized(text) -> Column:
    """Lower case; runs of anything but letters and digits become one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_overlap(predicted, reference, k: int) -> Column:
    """Whether two texts share at least min(k, tokens of the reference) tokens, one at least."""
    words = lambda x: F.array_distinct(F.filter(F.split(normalized(x), " "), lambda w: w != ""))
    ref = words(reference)
    return (F.size(ref) > 0) & (F.size(F.array_intersect(words(predicted), ref)) >= F.greatest(F.lit(1), F.least(F.lit(k), F.size(ref))))
