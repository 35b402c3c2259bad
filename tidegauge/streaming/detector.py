"""The detector as a Structured Streaming query: windows, scores and events with state per run.

State of a run: a small value (numbers, the last ``size`` samples, the flags' run length), a list to which each window of the
open event is appended (start, score, error and mean of each sensor; at most ``cap`` of them), and a map of the records that wait.
Sample numbers are dense from 0; a record waits until those before it are there, in whatever order files and batches
come. A gap is given up, and the run goes on with the next number that is there (a run that begins late begins with its first), once more than
``hold`` records wait behind it or, where ``wait`` is given, once a timer of so many seconds that was set
with the gap has expired. A record whose number has passed is late; it is not used, and leaves as a row of its own (late, its
number as start and last sample). An event leaves the stream when it closes, with the errors and means of its windows,
from which ``online`` derives evidence and report; one still open at the end stays in the state. A record whose vector
has not the baseline's length is an error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "run_id string, start_sample long, last_sample long, n_windows int, max_score double, mean_score double, fault_label int, late boolean, errors array<array<double>>, means array<array<double>>"


class Detector(StatefulProcessor):
    def __init__(self, mean, std, limit: float, size: int, stride: int, confirm: int, separate: int, cap: int, hold: int, phase: str, wait: float | None = None):
        self.mean, self.scale = np.asarray(mean, float), np.where(np.asarray(std) == 0, 1.0, std)
        self.limit, self.size, self.stride, self.wait = limit, size, stride, wait
        self.confirm, self.separate, self.cap, self.hold = confirm, separate, cap, hold
        self.first = size if phase == "full" else -(-size // stride) * stride  # samples before the first window's end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # held, end: windows of the open event, and the last sample of the last of them; timer: when the gap is given up, 0 without one
        self.run = handle.getValueState("run", "last long, seen long, recent int, gap int, held int, end long, label int, waiting int, timer long, numbers array<bigint>, tail array<double>")
        self.windows = handle.getListState("windows", "start long, score double, error array<double>, mean array<double>")
        self.waiting = handle.getMapState("waiting", "i long", "sample array<double>, fault int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(key, rows, timerValues, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, (), timerValues, True)

    def _step(self, key, rows, timer_values, give_up: bool) -> Iterator[pd.DataFrame]:
        """Take in records; with ``give_up`` the first gap is passed over."""
        last, seen, recent, gap, held, end, label, waiting, timer, numbers, tail = self.run.get() if self.run.exists() else (-1, 0, 0, -1, 0, -1, None, 0, 0, [], [])
        f = len(self.mean)
        numbers, tail = deque(numbers, self.size), deque(np.reshape(tail, (-1, f)), self.size)
        out, opened, fresh = [], [], {}
        known = None  # numbers that wait, read once they are needed

        for rows_of in rows:
            for i, values, fault in zip(rows_of["sample_index"], rows_of["values"], rows_of["fault_label"], strict=True):
                i, fault = int(i), None if pd.isna(fault) else int(fault)
                if i <= last or i in fresh or (waiting and self.waiting.containsKey((i,))):
                    out.append((key[0], i, i, 0, None, None, fault, True, None, None))
                elif len(values) != f:
                    raise ValueError(f"record {i} of run {key[0]} has {len(values)} values, the baseline has {f}")
                else:
                    fresh[i] = (np.asarray(values, float), fault)

        def take(i):
            """A record that has come or waits."""
            nonlocal waiting
            if i in fresh:
                return fresh.pop(i)
            if waiting and self.waiting.containsKey((i,)):
                values, fault = self.waiting.getValue((i,))
                self.waiting.removeKey((i,))
                waiting -= 1
                return np.asarray(values, float), fault
            return None

        def first_waiting():
            nonlocal known
            if known is None:
                known = sorted(k[0] for k in self.waiting.keys()) if waiting else []
            while known and known[0] <= last:
                known.pop(0)
            return min([*known[:1], *([min(fresh)] if fresh else [])])

        def close():
            nonlocal held, label
            own = [*([(w[0], w[1], list(w[2]), list(w[3])) for w in self.windows.get()] if held > len(opened) else []), *opened]
            starts, scores, errors, means = zip(*own, strict=True)
            out.append((key[0], starts[0], end, len(own), max(scores), float(np.mean(scores)), label, False, list(errors), list(means)))
            self.windows.clear()
            opened.clear()
            held, label = 0, None

        while fresh or waiting:
            found = take(last + 1)
            if found is None:
                if not (give_up or len(fresh) + waiting > self.hold):
                    break
                give_up, timer = False, 0
                last = first_waiting() - 1
                continue
            values, fault = found
            last += 1
            seen += 1
            tail.append(values)
            numbers.append(last)
            if seen < self.first or (seen - self.first) % self.stride:
                continue
            window = np.array(tail)
            error, mean = np.square((window - self.mean) / self.scale).mean(0), window.mean(0)
            score = float(error.mean())
            hot = score > self.limit
            recent = recent + 1 if hot else 0
            if hot and (held or recent >= self.confirm):
                opened.append((numbers[0], score, error.tolist(), mean.tolist()))
                label = fault if fault is not None or not held else label
                held, gap, end = held + 1, 0, last
                if held >= self.cap and held > 1:
                    close()
            elif held:
                gap += 1
                if gap >= self.separate:
                    close()
        if opened:
            self.windows.appendList(opened)
        for i, (values, fault) in fresh.items():
            self.waiting.updateValue((i,), (values.tolist(), fault))
        waiting += len(fresh)
        if self.wait is not None:
            if waiting and not timer:
                timer = timer_values.getCurrentProcessingTimeInMs() + int(1000 * self.wait)
                self.handle.registerTimer(timer)
            elif timer and not waiting:
                self.handle.deleteTimer(timer)
                timer = 0
        self.run.update((last, seen, recent, gap, held, end, label, waiting, timer, list(numbers), np.ravel(tail).tolist()))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")]).astype({"fault_label": "Int32"})

    def close(self) -> None:
        pass


def events(stream: DataFrame, base: DataFrame, limit: float, size: int = 60, stride: int = 5, confirm: int = 3, separate: int = 20, cap: int = 200, hold: int = 10_000, phase: str = "full", wait: float | None = None) -> DataFrame:
    """Closed events and late records of a stream of run_id, sample_index, values, fault_label. ``base`` has a row a sensor;
    ``phase`` is that of ``windows.rolling``. ``wait`` (seconds) needs a trigger that goes on, as timers expire in later batches.

    The session needs the RocksDB state store.
    """
    rows: list[Row] = base.orderBy("sensor").select("mean", "std").collect()  # a row a sensor
    processor = Detector([r["mean"] for r in rows], [r["std"] for r in rows], limit, size, stride, confirm, separate, cap, hold, phase, wait)
    own = stream.select("run_id", "sample_index", "values", F.col("fault_label").cast("int").alias("fault_label"))
    return own.groupBy("run_id").transformWithStateInPandas(processor, EVENTS, "append", "None" if wait is None else "ProcessingTime")


def replay(normal: DataFrame, fault: DataFrame, inject_at: int) -> DataFrame:
    """Matrix of a normal run whose samples from ``inject_at`` on come from a fault run, over and over."""
    n = fault.agg(F.count(F.lit(1))).first()[0]
    at = F.when(F.col("sample_index") >= inject_at, F.pmod(F.col("sample_index") - inject_at, F.lit(n)))
    other = fault.select(F.col("sample_index").alias("at"), F.col("values").alias("fault_values"), F.col("fault_label").alias("fault"))
    spliced = normal.withColumn("at", at).join(other, "at", "left")
    return spliced.select("run_id", "sample_index", F.coalesce("fault_values", "values").alias("values"), F.coalesce("fault", "fault_label").alias("fault_label"))
