"""Evaluation of text answers against references and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import columns as C

# Words that soften a claim.
HEDGES = ["likely", "probably", "consistent with", "suggests", "supports", "may", "might", "candidate", "temporal evidence", "verify"]
# Patterns of claims that go too far.
OVERCLAIMS = r"(?i)\b(caused|proves?|definitely|certainly|guaranteed)\b|\b(root cause is\b.*!|must be\b)"
# Words that an answer may use beside the names of sensors.
ALLOWED = """the a an and of to in on is are was be that this it for with as at by from likely cause anomaly evidence
sensor flow temperature pressure reactor system process root subsystem cooling water feed level valve condenser
stripper separator purge compressor recycle stream component minutes min later decreased increased consistency high
medium low critical confidence recommended action summary reasoning uncertainty analysis report""".split()
SEVERITIES = ("low", "medium", "high", "critical")


def hedging(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with hedged and overclaiming (only where nothing is hedged)."""
    lower = F.lower(text)
    hedged = F.coalesce(F.exists(F.array(*[F.lit(h) for h in HEDGES]), lambda h: F.contains(lower, h)), F.lit(False))
    return rows.withColumn("hedged", hedged).withColumn("overclaiming", ~F.col("hedged") & F.coalesce(F.rlike(text, F.lit(OVERCLAIMS)), F.lit(False)))


def foreign(rows: DataFrame, text: str = "text", sensors: str | None = None) -> DataFrame:
    """``rows`` with foreign_tokens: distinct words of a text that neither the allow-list nor ``sensors`` (array) has."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_]+)"), F.lit(1)), lambda w: C.normalized(w))
    known = F.array(*[F.lit(w) for w in ALLOWED])
    if sensors:
        known = F.concat(known, F.transform(sensors, lambda s: C.normalized(s)))
    return rows.withColumn("foreign_tokens", F.array_sort(F.array_except(F.array_distinct(words), known)))


def recommends(action) -> F.Column:
    """A recommendation of more than 15 characters that does not begin with "unable"."""
    return (F.length(action) > 15) & ~F.startswith(F.lower(action), F.lit("unable"))


def root_cause_hit(predicted, reference, k: int = 3) -> F.Column:
    ref = C.normalized(reference)
    return (ref != "") & (F.contains(C.normalized(predicted), ref) | C.token_overlap(predicted, reference, k))


def fault_class_hit(subsystem, cause, ref_subsystem, ref_name) -> F.Column:
    ref = C.normalized(ref_subsystem)
    named = (ref != "") & (F.contains(C.normalized(subsystem), ref) | F.contains(C.normalized(cause), ref))
    return named | root_cause_hit(cause, ref_name, 2)


def clean_field(name: str, value) -> F.Column:
    """A field of a parsed answer: empty texts, evidence an array, confidence within [0, 1] else 0, known severity."""
    if name == "confidence":
        return F.when(value.between(0, 1), value).otherwise(0.0)
    if name == "severity":
        return F.when(F.lower(value).isin(*SEVERITIES), F.lower(value)).otherwise("unknown")
    if name == "evidence":
        return F.coalesce(value, F.array().cast("array<string>"))
    if name in ("summary", "root_cause", "affected_subsystem", "reasoning", "recommended_action", "uncertainty"):
        return F.coalesce(value, F.lit(""))
    return value


def sanitized(answers: DataFrame) -> DataFrame:
    """Parsed answers with each column as ``clean_field`` leaves it."""
    return answers.select(*[clean_field(c, F.col(c)).alias(c) for c in answers.columns])


def evaluate(answers: DataFrame, k: int = 3) -> DataFrame:
    """One row of rates over answers (answer struct or null where it is no JSON, evidence_sensors array, fault_name,
    subsystem, severity)."""
    a = lambda c: F.col(f"answer.{c}")
    reason = F.concat_ws(" ", a("reasoning"), F.array_join(a("evidence"), " "))
    rows = answers.withColumn("__reason", F.coalesce(reason, F.lit(""))).withColumn("__all", F.coalesce(F.to_json("answer"), F.lit("")))
    rows = foreign(hedging(rows, "__reason"), "__all", "evidence_sensors")
    parsed = F.col("answer").isNotNull()
    rate = lambda flag: F.avg(F.coalesce((parsed & flag), F.lit(False)).cast("int"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_samples"),
        rate(root_cause_hit(a("root_cause"), F.col("fault_name"), k)).alias("root_cause_accuracy"),
        rate(fault_class_hit(a("affected_subsystem"), a("root_cause"), F.col("subsystem"), F.col("fault_name"))).alias("fault_classification_accuracy"),
        rate(a("severity") == F.col("severity")).alias("severity_accuracy"),
        rate(F.size("foreign_tokens") == 0).alias("evidence_consistency"),
        rate(F.size("foreign_tokens") > 0).alias("hallucination_rate"),
        rate(F.col("hedged")).alias("hedged_reasoning_rate"),
        rate(recommends(a("recommended_action"))).alias("recommendation_rate"),
        rate(F.lit(True)).alias("json_validity_rate"),
        rate(F.col("overclaiming")).alias("overclaiming_rate"),
    )
