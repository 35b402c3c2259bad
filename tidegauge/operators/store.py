"""Event store: events and their follow-ups in runs of bucketed Parquet files under a log of versions.

A write adds a run: its rows, dealt to ``buckets`` folders by a hash of the event's id. A version of the store names its
runs and reserves numbers: that of the next event, the next follow-up's, and the first number of each recent batch of a stream. Runs
of one size class are merged once there are ``FAN`` of them, so a store of n writes has about FAN * log(n) runs, a row is rewritten
log(n) times, and no write looks at the whole history. The row of the highest version of a key counts.

A version is published whole or not at all, and of two writers of one version the second starts anew from the
other's. So a batch that died before its commit finds the same next number, and one that is run again after its commit finds
the number that it had. The last ``KEEP`` versions and what they name stay readable.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.sources.commits import CommitLog, Conflict

BUCKETS = 16
FAN = 8
KEEP = 20
BATCHES = 16
ATTEMPTS = 20
#: What every event has, and all of a follow-up; events may bring more columns, which are null in rows without them.
EVENTS = "event_id string, created_at timestamp, version long"
FOLLOWUPS = "id long, event_id string, question string, answer string, version long"


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of highest version of each key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    return rows.withColumn("__rn", newest).where("__rn = 1").drop("__rn")


def number(event_id: str = "event_id") -> Column:
    """The number of an event's id, by which ids are ordered: ANOM-10000 comes after ANOM-9999."""
    return F.regexp_extract(event_id, r"(\d+)$", 1).cast("long")


def recent(events: DataFrame, n: int, at: str = "last_sample") -> DataFrame:
    """The n newest events; of equals the one with the larger number comes first."""
    return events.orderBy(F.desc(at), number().desc()).limit(n)


def status(events: DataFrame) -> DataFrame:
    """n_events, last_event (of the largest number): one row."""
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_id", number()).alias("last_event"))


def history(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, n_messages, history: a conversation's messages (role, content) in order."""
    one = F.struct(F.col(order).alias("turn"), F.col("role"), F.col("content"))
    rows = messages.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("all"))
    return rows.select(key, F.size("all").cast("long").alias("n_messages"), F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def as_messages(followups: DataFrame) -> DataFrame:
    """event_id, turn, role, content: each question and answer becomes a user's and an assistant's message."""
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    rows = followups.select("event_id", "id", F.posexplode(both).alias("k", "m"))
    return rows.select("event_id", (F.col("id") * 2 + F.col("k")).alias("turn"), "m.role", "m.content")


def with_followups(events: DataFrame, followups: DataFrame) -> DataFrame:
    """``events`` and followups: array of (id, question, answer) in order, empty without any."""
    kind = "array<struct<id:bigint,question:string,answer:string>>"
    own = followups.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "question", "answer"))).alias("followups"))
    return events.join(own, "event_id", "left").withColumn("followups", F.coalesce(F.col("followups").cast(kind), F.array().cast(kind)))


def _joined(known: T.StructType, new: T.StructType) -> T.StructType:
    """``known`` and the columns of ``new`` that it has not; a column of two types is an error."""
    of = {f.name: f for f in known}
    for f in new:
        if f.name not in of:
            of[f.name] = T.StructField(f.name, f.dataType, True)
        elif of[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {of[f.name].dataType.simpleString()} in the store and {f.dataType.simpleString()} here")
    return T.StructType(list(of.values()))


class EventStore:
    """The tables events and followups under a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, self.path)
        _, told = self.log.last()
        self.buckets = told["buckets"] if told else buckets

    def _state(self) -> tuple[int, dict]:
        version, told = self.log.last()
        empty = {"runs": [], "schema": None}
        return version, told or {"buckets": self.buckets, "next_event": 1, "next_followup": 1, "batches": {}, "events": empty, "followups": empty}

    # runs
    def _bucket(self, event_id: str) -> int:
        return zlib.crc32(event_id.encode()) % self.buckets

    def _write(self, rows: DataFrame, order: int) -> dict:
        """A run of rows (with event_id), and which buckets it has."""
        name = uuid.uuid4().hex
        bucket = (F.crc32(F.col("event_id").cast("binary")) % self.buckets).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/runs/{name}")
        return {"name": name, "order": order, "buckets": [int(n.split("=")[1]) for n in self.log.names(f"runs/{name}") if n.startswith("bucket=")]}

    def _read(self, table: dict, bucket: int | None = None) -> DataFrame | None:
        """All rows of a table's runs, or of one bucket of them."""
        if not table["runs"]:
            return None
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        paths = [f"{self.path}/runs/{r['name']}/bucket={b}" for r in table["runs"] for b in r["buckets"] if bucket in (None, b)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _added(self, table: dict, run: dict, schema: T.StructType, key: str) -> dict:
        """A table with one more run; runs of a size class that is full become one of the next."""
        known = T.StructType.fromJson(json.loads(table["schema"])) if table["schema"] else T.StructType()
        out = {"runs": [*table["runs"], {**run, "size": 0}], "schema": json.dumps(_joined(known, schema).jsonValue())}
        size, made = 0, [run["name"]]
        while len(full := [r for r in out["runs"] if r["size"] == size]) >= FAN:
            # runs of a class follow each other in time: those behind are of smaller ones
            rows = latest(self._read({**out, "runs": full}), key, "version")
            merged = {**self._write(rows, max(r["order"] for r in full)), "size": size + 1}
            out["runs"] = sorted([*(r for r in out["runs"] if r["size"] != size), merged], key=lambda r: r["order"])
            made.append(merged["name"])
            size += 1
        for name in set(made) - {r["name"] for r in out["runs"]}:  # merged again before any version named it
            self.log.delete(f"runs/{name}")
        return out

    def _commit(self, change: Callable[[int, dict], dict]) -> dict:
        """Publish what ``change`` makes of the last version, as often as another writer is first."""
        for _ in range(ATTEMPTS):
            version, told = self._state()
            new = change(version + 1, told)
            try:
                self.log.publish(version + 1, new)
            except Conflict:
                continue
            gone = self.log.forget(KEEP)
            if gone:
                live = {r["name"] for v in self.log.versions() for t in ("events", "followups") for r in self.log.read(v)[t]["runs"]}
                for name in {r["name"] for old in gone for t in ("events", "followups") for r in old[t]["runs"]} - live:
                    self.log.delete(f"runs/{name}")
            return new
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def sweep(self, seconds: float = 7 * 24 * 3600) -> None:
        """Remove runs that no version names and that are older than this (of writers that died, or were second)."""
        live = {r["name"] for v in self.log.versions() for t in ("events", "followups") for r in self.log.read(v)[t]["runs"]}
        for name in set(self.log.older("runs", seconds)) - live:
            self.log.delete(f"runs/{name}")

    # events
    def next_number(self, before: int | None = None, stream: str = "stream") -> int:
        """The number of the next event; ``before``: the first one that this batch of a stream has or will have, or, where
        the batch had no events, the first batch behind it."""
        _, told = self._state()
        known = {} if before is None else {int(b): n for b, n in told["batches"].get(stream, {}).items() if int(b) >= before}
        return known[min(known)] if known else told["next_event"]

    def upsert(self, events: DataFrame, version: int | None = None, stream: str = "stream") -> None:
        """Add events, or replace those of the same event_id. ``version`` is the number of a stream's batch: repeating one is
        harmless, and ``next_number`` gives its first number again. created_at is now unless the rows have it already."""
        dated = events if "created_at" in events.columns else events.withColumn("created_at", F.current_timestamp())
        own = dated.drop("version", "bucket")

        def change(order: int, told: dict) -> dict:
            rows = own.withColumn("version", F.lit(order).cast("long"))
            run = self._write(rows, order)
            last = self._read({"runs": [run], "schema": json.dumps(rows.schema.jsonValue())}).agg(F.max(number())).first()[0]
            batches = dict(told["batches"])
            if version is not None:
                mine = {str(version): told["next_event"]} | batches.get(stream, {})
                batches[stream] = dict(sorted(mine.items(), key=lambda x: int(x[0]))[-BATCHES:])
            return {**told, "next_event": max(told["next_event"], (last or 0) + 1), "batches": batches, "events": self._added(told["events"], run, rows.schema, "event_id")}

        self._commit(change)

    def events(self) -> DataFrame:
        rows = self._read(self._state()[1]["events"])
        if rows is None:
            raise KeyError("the store has no events")
        return latest(rows, "event_id", "version")

    def get(self, event_id: str) -> DataFrame:
        """An event, from the files of its bucket."""
        rows = self._read(self._state()[1]["events"], self._bucket(event_id))
        if rows is None:
            raise KeyError("the store has no events")
        return latest(rows.where(F.col("event_id") == event_id), "event_id", "version")

    def recent(self, n: int = 50) -> DataFrame:
        return recent(self.events(), n)

    def update_report(self, event_id: str, report: Column, version: int | None = None) -> None:
        self.upsert(self.get(event_id).withColumn("report", report))

    def status(self) -> DataFrame:
        """n_events, last_event: over all events."""
        return status(self.events())

    # follow-ups
    def add_followup(self, event_id: str, question: str, answer: str | None) -> int:
        """Append a question and its answer; returns its id. An unknown event is an error."""
        if self.get(event_id).isEmpty():
            raise KeyError(f"unknown event {event_id}")
        schema = T.StructType.fromDDL(FOLLOWUPS)

        def change(order: int, told: dict) -> dict:
            row = self.spark.createDataFrame([(told["next_followup"], event_id, question, answer, order)], schema)
            return {**told, "next_followup": told["next_followup"] + 1, "followups": self._added(told["followups"], self._write(row, order), schema, "id")}

        return self._commit(change)["next_followup"] - 1

    def followups(self, event_id: str | None = None) -> DataFrame | None:
        """All follow-ups, or those of an event, from the files of its bucket; None where none was ever added."""
        rows = self._read(self._state()[1]["followups"], None if event_id is None else self._bucket(event_id))
        if rows is None:
            return None
        own = rows.drop("version")
        return own if event_id is None else own.where(F.col("event_id") == event_id)
