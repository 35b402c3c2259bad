"""Events from flagged windows.

An event opens at the first window whose last ``confirm`` flags are all set, holds the anomalous windows from there
on, and closes once ``separate`` windows in a row are normal, or once it holds ``cap`` windows. Flags from before a
close still count towards the next opening.

Without the cap this is gaps and islands over the anomalous windows alone. A run is cut into buckets of windows, and a
bucket tells its first and last anomalous window, how many it has and how many islands begin inside; a scan over these
carries ends, counts and numbers from bucket to bucket. With a cap, what a bucket does to an island depends only on
how many anomalous windows the event that is open when it begins still takes: a bucket's part of an island tells, for each of the ``cap``
possible answers, the answer it leaves and the events it opens; composing these in order gives each part its own. No
task orders a run or an island.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.operators import scans


def confirmed(flags: DataFrame, confirm: int, bucket: int = scans.BUCKET) -> DataFrame:
    """``flags`` (run_id, window_id, anomalous) with confirmed: the last ``confirm`` flags are all set."""
    spread = scans.overlapping(flags, "window_id", confirm - 1, bucket)
    frame = Window.partitionBy("run_id", "bucket").orderBy("window_id").rowsBetween(-(confirm - 1), 0)
    return spread.withColumn("confirmed", F.sum(F.col("anomalous").cast("int")).over(frame) == confirm).where("here").select(*flags.columns, "confirmed")


def islands(flags: DataFrame, confirm: int, separate: int, bucket: int = scans.BUCKET) -> DataFrame:
    """Anomalous windows with island (numbered in each run), confirmed, place (among the run's anomalous windows, from 1) and
    bucket. Window ids are dense."""
    hot = scans.overlapping(flags.where("anomalous"), "window_id", confirm - 1, bucket)
    line = Window.partitionBy("run_id", "bucket").orderBy("window_id")
    back = F.col("window_id") - F.lag("window_id", confirm - 1).over(line) == confirm - 1 if confirm > 1 else F.lit(True)
    own = hot.withColumn("confirmed", F.coalesce(back, F.lit(False))).where("here").drop("here")
    gap = F.col("window_id") - F.lag("window_id").over(line) - 1
    marked = own.withColumn("new", F.coalesce((gap >= separate).cast("int"), F.lit(0)))  # a bucket's first window is told below
    pieces = marked.groupBy("run_id", "bucket").agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("new").alias("inside"))
    order = Window.partitionBy("run_id").orderBy("bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("first") - F.lag("last").over(order) - 1
    begun = pieces.withColumn("fresh", F.coalesce((apart >= separate).cast("int"), F.lit(1)))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = begun.select("run_id", "bucket", (total(F.col("inside") + F.col("fresh")) + F.col("fresh")).alias("base"), total("n").alias("held"))
    told = marked.join(bases, ["run_id", "bucket"])
    grown = line.rowsBetween(Window.unboundedPreceding, 0)
    island, place = F.col("base") + F.sum("new").over(grown), F.col("held") + F.row_number().over(line)
    return told.withColumn("island", island).withColumn("place", place).drop("new", "base", "held")


def _numbers(starts: DataFrame, through: bool) -> DataFrame:
    """``starts`` (run_id, bucket, island, part) with number: in each run, or ``through`` all runs in order.

    Events of a bucket are ordered by themselves; counts by bucket, and by run, are summed up before.
    """
    before = lambda *by: (Window.partitionBy(*by) if by else Window).rowsBetween(Window.unboundedPreceding, -1)
    counts = starts.groupBy("run_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("run_id", "bucket", F.coalesce(F.sum("n").over(before("run_id").orderBy("bucket")), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("run_id", "bucket").orderBy("island", "part"))
    told = starts.join(bases, ["run_id", "bucket"]).withColumn("number", F.col("base") + own).drop("base")
    if not through:
        return told
    # a row a run
    runs = counts.groupBy("run_id").agg(F.sum("n").alias("n"))
    ahead = runs.select("run_id", F.coalesce(F.sum("n").over(before().orderBy("run_id")), F.lit(0)).alias("ahead"))
    return told.join(ahead, "run_id").withColumn("number", F.col("number") + F.col("ahead")).drop("ahead")


def event_windows(flags: DataFrame, confirm: int = 3, separate: int = 20, flush: bool = False, bucket: int = scans.BUCKET) -> DataFrame:
    """Windows of events with event_number (by run and start) and rn, the place in the event, without a cap.

    An event still open at the end of its run is left out unless ``flush``.
    """
    marked = islands(flags, confirm, separate, bucket)
    opening = F.when(F.col("confirmed"), F.col("place"))
    by_island = marked.groupBy("run_id", "island").agg(F.min(opening).alias("opening"), F.min_by("bucket", opening).alias("began"), F.max("window_id").alias("last"))
    opened = by_island.where("opening IS NOT NULL")
    if not flush:
        ends = flags.groupBy("run_id").agg(F.max("window_id").alias("final"))
        opened = opened.join(ends, "run_id").where(F.col("final") - F.col("last") >= separate)
    starts = opened.select("run_id", F.col("began").alias("bucket"), "island", F.lit(0).alias("part"), "opening")
    numbered = _numbers(starts, through=True).select("run_id", "island", "opening", F.col("number").cast("int").alias("event_number"))
    told = marked.drop("bucket", "confirmed").join(numbered, ["run_id", "island"]).where(F.col("place") >= F.col("opening"))
    return told.withColumn("rn", (F.col("place") - F.col("opening") + 1).cast("int")).drop("island", "place", "opening")


def machine(flags: Iterator[bool], confirm: int, separate: int, cap: int, flush: bool = False) -> Iterator[list[int]]:
    """Places of the windows of each event, in order of closing."""
    held, gap, recent = None, 0, 0
    for k, hot in enumerate(flags):
        recent = recent + 1 if hot else 0
        if held is None:
            if recent >= confirm:
                held, gap = [k], 0
        elif hot:
            held.append(k)
            gap = 0
            if len(held) >= cap:
                yield held
                held = None
        else:
            gap += 1
            if gap >= separate:
                yield held
                held = None
    if held is not None and flush:
        yield held


def _opened(sure: np.ndarray, open_for: int, cap: int) -> tuple[list[int], int]:
    """Places in a bucket's part of an island where events open, and how many windows the last one still takes behind it.

    ``sure`` tells which of its anomalous windows are confirmed, ``open_for`` how many of them an earlier event takes.
    """
    places, at, n = np.flatnonzero(sure), open_for, len(sure)
    out = []
    while at < n:
        k = np.searchsorted(places, at)
        if k == len(places):
            return out, 0
        out.append(int(places[k]))
        at = out[-1] + cap
    return out, at - n


def capped(flags: DataFrame, confirm: int = 3, separate: int = 20, cap: int = 200, flush: bool = False, bucket: int = scans.BUCKET) -> DataFrame:
    """run_id, event_number (in its run), window_id, rn of the windows of events, with the cap."""
    # an event that opens takes its window and closes only at a later one, so it holds two at least
    cap = max(cap, 2)
    marked = islands(flags, confirm, separate, bucket).select("run_id", "island", "bucket", "window_id", "confirmed")
    part = ["run_id", "island", "bucket"]

    def effect(rows: pd.DataFrame) -> pd.DataFrame:
        sure = rows.sort_values("window_id")["confirmed"].to_numpy()
        told = [_opened(sure, k, cap) for k in range(cap)]
        return pd.DataFrame([(*rows[part].iloc[0], [rest for _, rest in told], [len(own) for own, _ in told])], columns=[*part, "leaves", "opens"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        open_for, n, out = 0, 0, []
        for leaves, opens in zip(rows["leaves"], rows["opens"], strict=True):
            out.append((open_for, n))
            n, open_for = n + int(opens[open_for]), int(leaves[open_for])
        return rows[part].assign(open_for=[a for a, _ in out], before=[b for _, b in out])

    def windows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("window_id")
        open_for, before, ids = int(rows["open_for"].iloc[0]), int(rows["before"].iloc[0]), rows["window_id"].to_numpy()
        starts, _ = _opened(rows["confirmed"].to_numpy(), open_for, cap)
        out = [(before - 1, cap - open_for + k + 1, int(ids[k])) for k in range(min(open_for, len(ids)))]
        for n, start in enumerate(starts):
            out += [(before + n, k - start + 1, int(ids[k])) for k in range(start, min(start + cap, len(ids)))]
        return pd.DataFrame([(*key, *x) for x in out], columns=[*part, "part", "rn", "window_id"])

    effects = marked.groupBy(*part).applyInPandas(effect, "run_id string, island long, bucket long, leaves array<int>, opens array<int>")
    # a row for each bucket of an island
    entries = effects.groupBy("run_id", "island").applyInPandas(composed, "run_id string, island long, bucket long, open_for int, before int")
    found = marked.join(entries, part).groupBy(*part).applyInPandas(windows, "run_id string, island long, bucket long, part int, rn int, window_id long")
    sizes = found.groupBy("run_id", "island", "part").agg(F.max("rn").alias("size"), F.min_by("bucket", "rn").alias("bucket"))
    if not flush:
        # an event below the cap closes by the normal windows behind its island
        ends = flags.groupBy("run_id").agg(F.max("window_id").alias("final"))
        lasts = marked.groupBy("run_id", "island").agg(F.max("window_id").alias("last")).join(ends, "run_id")
        sizes = sizes.join(lasts, ["run_id", "island"]).where((F.col("size") >= cap) | (F.col("final") - F.col("last") >= separate))
    numbered = _numbers(sizes.select("run_id", "bucket", "island", "part"), through=False).select("run_id", "island", "part", F.col("number").cast("int").alias("event_number"))
    return found.drop("bucket").join(numbered, ["run_id", "island", "part"]).select("run_id", "event_number", "window_id", "rn")


def summary(windows: DataFrame) -> DataFrame:
    """event_id, run_id, start_sample, last_sample, n_windows, max_score, mean_score, severity: a row an event; also
    fault_label, that of the last window with one, where windows have it."""
    labelled = "fault_label" in windows.columns
    rows = windows.groupBy("event_number", "run_id").agg(
        F.min("start_sample").alias("start_sample"),
        F.max("end_sample").alias("last_sample"),
        F.count(F.lit(1)).alias("n_windows"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        F.max("threshold").alias("threshold"),
        *([F.max_by("fault_label", F.when(F.col("fault_label").isNotNull(), F.col("window_id"))).alias("fault_label")] if labelled else []),
    )
    return rows.select(C.event_name("event_number").alias("event_id"), "run_id", "start_sample", "last_sample", "n_windows", "max_score", "mean_score", C.severity("max_score", "threshold").alias("severity"), *(["fault_label"] if labelled else []))
