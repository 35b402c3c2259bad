"""Reports, prompts and chat text from evidence: made without a model, or by one that the caller gives.

A text model is a function of a column of prompts that returns a column of texts, such as a Pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.json_scan import extract_json
from tidegauge.operators import store, text_eval

REPORT = "summary string, root_cause string, affected_subsystem string, evidence array<string>, reasoning string, severity string, confidence double, recommended_action string, uncertainty string"
ANSWER_KEYS = ("summary", "root_cause", "affected_subsystem", "evidence", "reasoning", "severity", "confidence", "recommended_action", "uncertainty")
SYSTEM = "You analyse anomalies of an industrial process. Answer from the given evidence only, as one JSON object."


def sensor_lines(sensors, k: int | None = None) -> Column:
    """A line for each of the first k sensors: name, signed percent, trend, share."""
    own = F.slice(sensors, 1, k) if k else F.col(sensors) if isinstance(sensors, str) else sensors
    return F.transform(own, lambda s: F.format_string("%s changed by %+.1f%% (trend %s, contribution %.2f)", s["display_name"], s["deviation_percent"], s["trend"], s["contribution"]))


def reports(events: DataFrame) -> DataFrame:
    """``events`` (with evidence) and report, made without a model."""
    e = lambda name: F.col(f"evidence.{name}")
    steps = F.transform(F.slice(e("temporal_sequence"), 1, 3), lambda t: F.format_string("%s at %.1f min", t["display_name"], t["relative_time_minutes"]))
    report = F.struct(
        F.format_string("Anomaly of score %.2f; candidate subsystem '%s'.", e("anomaly_score"), e("candidate_subsystem")).alias("summary"),
        F.concat(F.lit("candidate: "), e("candidate_subsystem")).alias("root_cause"),
        e("candidate_subsystem").alias("affected_subsystem"),
        sensor_lines(e("top_anomalous_sensors"), 3).alias("evidence"),
        F.concat(F.lit("Order in time (no proof of a cause): "), F.array_join(steps, "; "), F.lit(" "), F.array_join(e("reasoning_notes"), " ")).alias("reasoning"),
        e("severity").alias("severity"),
        F.round(e("candidate_subsystem_score"), 2).alias("confidence"),
        F.format_string("Inspect the parts of %s and check the suspect sensors on site.", e("candidate_subsystem")).alias("recommended_action"),
        e("uncertainty").alias("uncertainty"),
    )
    return events.withColumn("report", report)


def prompts(events: DataFrame) -> DataFrame:
    """``events`` (with evidence) and prompt: the question that a text model gets."""
    e = lambda name: F.col(f"evidence.{name}")
    sensors = F.transform(e("top_anomalous_sensors"), lambda s: F.format_string("- %s: %+.1f%% (trend: %s, contribution: %.2f)", s["display_name"], s["deviation_percent"], s["trend"], s["contribution"]))
    steps = F.transform(e("temporal_sequence"), lambda t: F.format_string("%d. %s, %.1f min after the first onset", t["place"], t["display_name"], t["relative_time_minutes"]))
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Event: "), e("event_id")),
        F.format_string("Score: %.3f", e("anomaly_score")),
        F.lit("Sensors:"),
        F.when(F.size(sensors) > 0, F.array_join(sensors, "\n")).otherwise("- (none deviates strongly)"),
        F.lit("Onsets:"),
        F.when(F.size(steps) > 0, F.array_join(steps, "\n")).otherwise("(no clear order)"),
        F.concat(F.lit("Candidate subsystem: "), e("candidate_subsystem")),
        F.format_string("Before the event: %s for about %.2f min", e("pre_anomaly_context.status"), e("pre_anomaly_context.duration_minutes")),
        F.lit("What is the likely root cause? Answer with the keys " + ", ".join(ANSWER_KEYS) + "."),
    )
    return events.withColumn("prompt", prompt)


def model_reports(events: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """``events`` (with evidence) and report by a text model, raw: its text.

    The report is the first JSON object of the text, sanitized; where there is none, the text itself with cause
    unable_to_parse, confidence 0 and the evidence's subsystem and severity.
    """
    asked = prompts(events)
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    raw = asked.withColumn("raw", model(chat_prompt(message))).drop("prompt").withColumn("__read", F.from_json(extract_json("raw"), REPORT))
    names = [field.split()[0] for field in REPORT.split(", ")]
    parsed = F.struct(*[text_eval.clean_field(n, F.col("__read")[n]).alias(n) for n in names])
    e = lambda name: F.coalesce(F.col(f"evidence.{name}"), F.lit("unknown"))
    text = F.coalesce("raw", F.lit(""))
    failed = {"summary": text, "root_cause": F.lit("unable_to_parse"), "affected_subsystem": e("candidate_subsystem"), "evidence": F.array().cast("array<string>"), "reasoning": text, "severity": e("severity"), "confidence": F.lit(0.0)}
    failed |= {"recommended_action": F.lit("Look at the raw evidence and analyse again."), "uncertainty": F.lit("The model's answer held no JSON object.")}
    return raw.withColumn("report", F.when(F.col("__read").isNotNull(), parsed).otherwise(F.struct(*[failed[n].alias(n) for n in names]))).drop("__read")


def followup_prompts(questions: DataFrame, events: DataFrame, followups: DataFrame) -> DataFrame:
    """(event_id, question) with prompt: the event's evidence and report, the turns before, then the question.

    Questions on unknown events have a null prompt; past turns without text are left out.
    """
    turns = store.history(store.as_messages(followups).where("content != ''"), "event_id").select("event_id", "history")
    context = F.concat_ws(
        "\n",
        F.lit("An anomaly was found and analysed before. Answer the question about this anomaly from what follows."),
        F.concat(F.lit("Event: "), "event_id"),
        F.format_string("Score: %.3f", "max_score"),
        F.concat(F.lit("Evidence: "), F.to_json("evidence")),
        F.concat(F.lit("Report: "), F.to_json("report")),
    )
    told = questions.join(events.select("event_id", context.alias("context")), "event_id", "left").join(turns, "event_id", "left")
    turn = lambda c: F.struct(F.lit("user").alias("role"), F.col(c).alias("content"))
    past = F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))
    messages = F.concat(F.array(turn("context")), past, F.array(turn("question")))
    return told.select("event_id", "question", F.when(F.col("context").isNotNull(), chat_prompt(messages)).alias("prompt"))


def chat_prompt(messages, system: str = SYSTEM, answer_turn: bool = True) -> Column:
    """Chat text of ordered messages (array of role, content); an empty content leaves its turn open."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.when(F.coalesce(m["content"], F.lit("")) != "", F.concat(m["content"], F.lit("<|im_end|>"))).otherwise("")))
    text = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>"), F.array_join(turns, ""))
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if answer_turn else text


def followup_answers(questions: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, question) with the answer made without a model; questions on unknown events have a null answer."""
    own = events.select("event_id", F.size("evidence.top_anomalous_sensors").alias("n"), F.col("evidence.candidate_subsystem").alias("subsystem"))
    answer = F.format_string("Event %s has %d deviating sensors; the candidate subsystem is '%s'.", "event_id", "n", "subsystem")
    return questions.join(own, "event_id", "left").select("event_id", "question", F.when(F.col("n").isNotNull(), answer).alias("answer"))
