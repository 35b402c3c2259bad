"""Synthetic instruction data from a fault knowledge base, reproducible row by row from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_of(fault, validation: list[int], test: list[int]) -> Column:
    """Whole faults to train, val and test."""
    return F.when(F.col(fault).isin(validation), "val").when(F.col(fault).isin(test), "test").otherwise("train")


def _uniform(low: float, high: float, seed: int, *parts) -> Column:
    """A number in [low, high) that depends on the seed and the row's key only."""
    return F.lit(low) + (high - low) * (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30))


def synthetic_events(faults: DataFrame, sensors: DataFrame, per_fault: int | Column, validation: list[int], test: list[int], seed: int = 42, top: int = 3) -> DataFrame:
    """fault_id, subsystem, severity, split, n, evidence: ``per_fault`` events (a number, or a column of
    ``faults``) of a training fault, else half, 3 at least.

    ``sensors`` (subsystem, display_name) are those an event of the subsystem may show.
    """
    own_number = per_fault if isinstance(per_fault, Column) else F.lit(per_fault)
    other = F.greatest(F.lit(3), F.floor(own_number / 2).cast("int"))
    told = faults.withColumn("split", split_of("fault_id", validation, test))
    rows = told.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("split") == "train", own_number.cast("int")).otherwise(other))))
    own = sensors.groupBy("subsystem").agg(F.array_sort(F.collect_set("display_name")).alias("own"))
    full = rows.join(own, "subsystem", "left").withColumn("own", F.coalesce("own", F.array(F.lit("unknown"))))
    key = lambda x: ("fault_id", "n", x)
    picked = F.slice(F.array_sort(F.transform("own", lambda s: F.struct(F.xxhash64(F.lit(seed), "fault_id", "n", s).alias("h"), s.alias("s")))), 1, top)
    up = lambda s: F.pmod(F.xxhash64(F.lit(seed + 1), "fault_id", s), F.lit(2)) == 0
    sensor = lambda x: F.struct(
        x["s"].alias("display_name"),
        F.round(F.when(up(x["s"]), 1).otherwise(-1) * _uniform(3, 45, seed + 2, *key(x["s"])), 1).alias("deviation_percent"),
        F.when(up(x["s"]), "increasing").otherwise("decreasing").alias("trend"),
        F.round(_uniform(0.1, 1, seed + 3, *key(x["s"])), 3).alias("contribution"),
    )
    evidence = F.struct(F.format_string("ANOM-T%04d-%02d", "fault_id", "n").alias("event_id"), F.round(_uniform(1.2, 3.8, seed + 4, *key(F.lit("score"))), 3).alias("anomaly_score"), F.col("severity"), F.transform(picked, sensor).alias("top_anomalous_sensors"), F.col("subsystem").alias("candidate_subsystem"))
    return full.select("fault_id", "subsystem", "severity", "split", "n", evidence.alias("evidence"))


def samples(events: DataFrame) -> DataFrame:
    """fault_id, split, kind, question, answer: a report and four follow-ups for each event."""
    place = F.regexp_replace("subsystem", "_", " ")
    names = F.array_join(F.transform("evidence.top_anomalous_sensors", lambda s: s["display_name"]), ", ")
    report = F.to_json(F.struct(F.format_string("Anomaly of score %.2f in %s.", "evidence.anomaly_score", names).alias("summary"), F.concat(F.lit("candidate: "), "subsystem").alias("root_cause"), F.col("subsystem").alias("affected_subsystem"), F.col("severity")))
    pair = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"))
    all_five = F.array(
        pair("report", F.concat(F.lit("What is the likely cause? Sensors: "), names), report),
        pair("followup", F.concat(F.lit("Why is "), place, F.lit(" the candidate?")), F.concat(F.lit("Its sensors deviate most: "), names, F.lit("; the order supports it without proving it."))),
        pair("followup", F.lit("How severe is it?"), F.concat(F.lit("It is rated "), F.col("severity"), F.lit(" from the size of the deviations."))),
        pair("followup", F.lit("What should be inspected?"), F.concat(F.lit("Begin with "), names, F.lit("."))),
        pair("followup", F.lit("Can it be something else?"), F.lit("Yes; order and size are evidence, and a check on site has to confirm the cause.")),
    )
    return events.select("fault_id", "split", F.explode(all_five).alias("x")).select("fault_id", "split", "x.kind", "x.question", "x.answer")


def write(rows: DataFrame, path: str) -> DataFrame:
    """Write JSON lines by split and return the split's counts."""
    rows.write.mode("overwrite").partitionBy("split").json(path)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"))
