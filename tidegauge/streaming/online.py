"""The online path: events that a stream closes get evidence and a report, and go to the event store, batch by batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions import columns as C
from tidegauge.operators import evidence, reports, store

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession) -> str:
    """A new folder of the stream's own in the shared folder; local sessions may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return f"{shared or 'file://' + tempfile.mkdtemp()}/stream-{uuid.uuid4().hex}"


def documents(closed: DataFrame, base: DataFrame, limit: float, stride: int, first_number: int = 1) -> DataFrame:
    """``evidence.documents`` of the events of ``detector.events``, with fault_label and detection_time.

    Late records are no events. Events are numbered from ``first_number`` by run and start: the window without
    partitions runs over a row an event of one batch, without its arrays.
    """
    real = closed.where("NOT late")
    number = F.row_number().over(Window.orderBy("run_id", "start_sample")) + first_number - 1
    ids = real.select("run_id", "start_sample").withColumn("event_id", C.event_name(number))
    own = real.join(ids, ["run_id", "start_sample"])
    pairs = own.select("event_id", F.posexplode(F.arrays_zip("errors", "means")).alias("at", "w"))
    cells = pairs.select("event_id", (F.col("at") + 1).alias("rn"), F.posexplode(F.arrays_zip("w.errors", "w.means")).alias("sensor", "c"))
    rows = cells.select("event_id", "rn", "sensor", F.col("c.errors").alias("error"), F.col("c.means").alias("mean_value"))
    told = own.withColumn("limit", F.lit(limit)).select("event_id", "run_id", "start_sample", "last_sample", "n_windows", "max_score", "mean_score", C.severity("max_score", "limit").alias("severity"))
    made = evidence.documents(rows, base, told, stride)
    return made.join(own.select("event_id", "fault_label"), "event_id").withColumn("detection_time", F.current_timestamp())


def start(
    closed: DataFrame,
    base: DataFrame,
    limit: float,
    events: store.EventStore,
    checkpoint: str,
    stride: int,
    report: Callable[[DataFrame], DataFrame] = reports.reports,
    late: Callable[[DataFrame], None] | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Run a stream of ``detector.events`` into a store; ``report`` adds the column report (``reports.model_reports``
    for a text model), ``late`` gets the late records of a batch.

    A batch that is run again after a failure numbers its events from the batches before it, so it writes the same ids
    at the same version, and the store's reads take each once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            if late is not None:
                late(rows.where("late"))
            if not rows.where("NOT late").isEmpty():
                made = report(documents(rows, base, limit, stride, events.next_number(before=number)))
                events.upsert(made, version=number)
        finally:
            rows.unpersist()

    writer = closed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
