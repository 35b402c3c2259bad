"""Evidence of events: leading sensors, deviations, trends, onsets, context, candidate subsystem.

Input is a row for each event, window and sensor: event_id, rn (place of the window in the event), sensor, error,
mean_value; and the baseline, a row a sensor. Everything is keyed by event and sensor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import taxonomy


def sensor_errors(rows: DataFrame) -> DataFrame:
    """event_id, sensor, worst, mean_error, event_mean."""
    return rows.groupBy("event_id", "sensor").agg(F.max("error").alias("worst"), F.avg("error").alias("mean_error"), F.avg("mean_value").alias("event_mean"))


def contributions(errors: DataFrame, column: str = "worst") -> DataFrame:
    """``errors`` with contribution: a sensor's share of its event's total, 0 where the total is."""
    total = F.sum(column).over(Window.partitionBy("event_id"))
    return errors.withColumn("contribution", F.when(total > 0, F.col(column) / total).otherwise(0.0))


def top_sensors(errors: DataFrame, k: int = 5) -> DataFrame:
    """The k sensors of largest worst error of each event with rank; of equals the later sensor comes first."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("worst"), F.desc("sensor")))
    return contributions(errors).withColumn("rank", rank).where(F.col("rank") <= k)


def deviations(errors: DataFrame, base: DataFrame) -> DataFrame:
    """``errors`` with current_value, baseline_value, deviation_percent, z_score."""
    told = errors.join(base.select("sensor", "mean", "std"), "sensor")
    return told.select(*errors.columns, F.col("event_mean").alias("current_value"), F.col("mean").alias("baseline_value"), C.percent_deviation("event_mean", "mean", "std").alias("deviation_percent"), C.z_score("event_mean", "mean", "std").alias("z_score"))


def strong(rows: DataFrame, least: float, forced: DataFrame | None = None) -> DataFrame:
    """Deviations of at least ``least`` percent, and those of ``forced`` (event_id, sensor) whatever they are."""
    keep = F.abs("deviation_percent") >= least
    if forced is None:
        return rows.where(keep)
    return rows.join(forced.select("event_id", "sensor", F.lit(True).alias("forced")), ["event_id", "sensor"], "left").where(keep | F.coalesce("forced", F.lit(False))).drop("forced")


def by_size(rows: DataFrame) -> DataFrame:
    """Deviations with place: an event's sensors from the largest deviation (up or down) on; of equals the earlier sensor comes first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc(F.abs("deviation_percent")), "sensor")))


def trends(rows: DataFrame, smoothing: int = 8, limit: float = 0.02) -> DataFrame:
    """event_id, sensor, slope, trend: least-squares slope of the (smoothed) window means relative to their largest size.

    Smoothing is a moving sum over the width divided by the width, zeros past the ends; only for longer series.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("event_id", "sensor"))
    frame = Window.partitionBy("event_id", "sensor").orderBy("rn").rowsBetween(-(smoothing // 2), smoothing - 1 - smoothing // 2)
    series = rows.withColumn("n", n).withColumn("v", F.when(F.col("n") > smoothing, F.sum("mean_value").over(frame) / smoothing).otherwise(F.col("mean_value")))
    fit = series.groupBy("event_id", "sensor").agg(F.regr_slope("v", F.col("rn").cast("double")).alias("slope"), F.max(F.abs("v")).alias("size"), F.max("n").alias("n"))
    relative = F.col("slope") / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size")) * F.col("n")
    trend = F.when(F.col("n") < 3, "stable").when(relative > limit, "increasing").when(relative < -limit, "decreasing").otherwise("stable")
    return fit.select("event_id", "sensor", F.coalesce("slope", F.lit(0.0)).alias("slope"), trend.alias("trend"))


def onsets(rows: DataFrame, sensitivity: float = 1.5, least_share: float = 0.25) -> DataFrame:
    """event_id, sensor, onset (place of the first window above the sensor's own limit), mean_after.

    The limit is the larger of ``sensitivity`` deviations and half the maximum of the sensor's errors in the event;
    sensors whose maximum is below a share of the event's largest are left out.
    """
    by = Window.partitionBy("event_id", "sensor")
    told = rows.withColumn("most", F.max("error").over(by)).withColumn("all", F.max("error").over(Window.partitionBy("event_id")))
    limit = F.greatest(F.lit(sensitivity) * (F.stddev_pop("error").over(by) + 1e-9), 0.5 * (F.col("most") + 1e-9))
    above = told.where(F.col("most") >= least_share * F.col("all")).withColumn("limit", limit)
    first = above.withColumn("onset", F.min(F.when(F.col("error") > F.col("limit"), F.col("rn"))).over(by)).where("onset IS NOT NULL")
    return first.groupBy("event_id", "sensor").agg(F.min("onset").alias("onset"), F.avg(F.when(F.col("rn") >= F.col("onset"), F.col("error"))).alias("mean_after"))


def sequence(onset: DataFrame, stride: int, most: int = 6, samples_per_minute: float = 1.0) -> DataFrame:
    """event_id, place, sensor, onset, relative_minutes: the first ``most`` onsets after the earliest."""
    line = Window.partitionBy("event_id").orderBy("onset", "sensor")
    relative = (F.col("onset") - F.min("onset").over(Window.partitionBy("event_id"))) * (stride / max(samples_per_minute, 1e-9) / 60.0)
    return onset.select("event_id", F.row_number().over(line).alias("place"), "sensor", "onset", F.round(relative, 2).alias("relative_minutes")).where(F.col("place") <= most)


def context(rows: DataFrame, first: int = 20) -> DataFrame:
    """event_id, sensor, pre_mean (first windows of the event), post_mean (all), delta."""
    told = rows.groupBy("event_id", "sensor").agg(F.avg(F.when(F.col("rn") <= max(first, 1), F.col("mean_value"))).alias("pre_mean"), F.avg("mean_value").alias("post_mean"))
    return told.withColumn("delta", F.col("post_mean") - F.col("pre_mean"))


def documents(rows: DataFrame, base: DataFrame, events: DataFrame, stride: int, top: int = 5, first: int = 20, smoothing: int = 8, sensitivity: float = 1.5, most: int = 6) -> DataFrame:
    """One row an event: event_id, evidence (nested) and the per-sensor series, for events of ``events.summary``."""
    errors = sensor_errors(rows)
    leading = taxonomy.named(deviations(top_sensors(errors, top), base).join(trends(rows, smoothing), ["event_id", "sensor"]))
    info = F.struct("rank", F.col("sensor").alias("index"), "name", "display_name", F.col("worst").alias("error"), "contribution", "current_value", "baseline_value", "deviation_percent", "z_score", "trend")
    sensors = leading.groupBy("event_id").agg(F.sort_array(F.collect_list(info)).alias("top_anomalous_sensors"))
    best = taxonomy.candidates(leading, 1).select("event_id", F.col("subsystem").alias("candidate_subsystem"), (F.col("matched") / max(top, 1)).alias("candidate_subsystem_score"))
    steps = taxonomy.named(sequence(onsets(rows, sensitivity), stride, most))
    step = F.struct("place", F.col("name").alias("sensor"), "display_name", F.lit("became_anomalous").alias("event"), F.col("relative_minutes").alias("relative_time_minutes"), F.col("onset").alias("onset_window"))
    ordered = steps.groupBy("event_id").agg(F.sort_array(F.collect_list(step)).alias("temporal_sequence"))
    both = context(rows, first).join(errors.select("event_id", "sensor", "mean_error"), ["event_id", "sensor"])
    list_of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("sensor", c))), lambda x: x[c]).alias(c)
    series = both.groupBy("event_id").agg(list_of("mean_error"), list_of("post_mean"), list_of("delta"))
    told = events.join(sensors, "event_id").join(best, "event_id").join(ordered, "event_id", "left").join(series, "event_id")
    evidence = F.struct(
        "event_id",
        F.col("max_score").alias("anomaly_score"),
        "severity",
        F.struct(F.round(F.lit(first * stride / 60.0), 2).alias("duration_minutes"), F.lit("normal").alias("status")).alias("pre_anomaly_context"),
        "top_anomalous_sensors",
        F.coalesce("temporal_sequence", F.array().cast(ordered.schema["temporal_sequence"].dataType)).alias("temporal_sequence"),
        "candidate_subsystem",
        "candidate_subsystem_score",
        F.array(F.lit("Deviations are relative to the baseline of normal operation."), F.lit("Onset order is evidence in time, no proof of a cause."), F.format_string("Subsystem '%s' is a candidate from the deviating sensors; verify it.", "candidate_subsystem")).alias("reasoning_notes"),
        F.lit("model_derived_evidence").alias("evidence_type"),
        F.lit("Deviations and the candidate go together in time; a check on site has to confirm the cause.").alias("uncertainty"),
    )
    return told.select("event_id", "run_id", "start_sample", "last_sample", (F.col("start_sample") + F.col("n_windows") * stride).alias("end_sample"), "n_windows", "max_score", "mean_score", "severity", evidence.alias("evidence"), F.struct(F.col("mean_error").alias("per_sensor_mean_error"), "post_mean", "delta").alias("sensor_time_series"))
