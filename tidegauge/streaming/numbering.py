"""Sample numbers for records in order of arrival, and replay of files as a numbered stream with a fault spliced in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidegauge.streaming import detector

NUMBERED = "run_id string, sample_index long, values array<double>, fault_label int"


class Numbering(StatefulProcessor):
    """State of a run: the next number. A batch's records of a run are put in order of arrival and numbered on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.next.get()[0] if self.next.exists() else 0
        own = pd.concat(list(rows)).sort_values(["time", "file", "block", "at"], kind="stable")
        self.next.update((first + len(own),))
        yield pd.DataFrame({"run_id": key[0], "sample_index": range(first, first + len(own)), "values": own["values"].to_list(), "fault_label": own["fault_label"].astype("Int32")})

    def close(self) -> None:
        pass


def numbered(stream: DataFrame) -> DataFrame:
    """run_id, sample_index, values, fault_label of a stream of records with ``arrival``: numbers go on from batch to
    batch, whatever files the records of a run come in. A batch of a run is put in order at once, so the source bounds it."""
    own = stream.select("run_id", "arrival.*", "values", F.col("fault_label").cast("int").alias("fault_label"))
    return own.groupBy("run_id").transformWithStateInPandas(Numbering(), NUMBERED, "append", "None")


def spliced(stream: DataFrame, fault: DataFrame, inject_at: int) -> DataFrame:
    """A numbered stream whose samples from ``inject_at`` on are those of a fault run (a table), over and over."""
    return detector.replay(stream, fault, inject_at)


def run(stream: DataFrame, base: DataFrame, limit: float, folder: str, fault: DataFrame | None = None, inject_at: int | None = None, **options) -> DataFrame:
    """Replay a stream to its end: number it where it has ``arrival``, splice a fault in where one is given, detect, and
    write under ``folder``. Returns the closed events and late records of ``detector.events`` as a table.

    Numbering is a query of its own, written as it goes; a second one reads what it wrote. Both may be started again in the same folder after a
    failure and go on from where they were.
    """
    spark = stream.sparkSession
    if "arrival" in stream.columns:
        _drain(numbered(stream), f"{folder}/numbered")
        stream = spark.readStream.schema(NUMBERED).parquet(f"{folder}/numbered/out")
    if fault is not None and inject_at is not None:
        stream = spliced(stream, fault, inject_at)
    found = detector.events(stream, base, limit, **options)
    _drain(found, f"{folder}/events")
    return spark.read.schema(found.schema).parquet(f"{folder}/events/out")


def _drain(rows: DataFrame, folder: str) -> None:
    """Run a stream over what its source has, into Parquet files."""
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
