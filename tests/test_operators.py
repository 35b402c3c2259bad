"""Operators against direct re-statements, golden counts and edge cases."""

import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import columns as C
from tidegauge.functions.json_scan import first_object
from tidegauge.operators import events, metrics, repair, reports, scaling, scans, scoring, selection, store, taxonomy, text_eval, windows
from tidegauge.sources import artifacts, files
from tidegauge.streaming import detector, online, timed


def grid(spark, values, run="r"):
    return spark.createDataFrame([(run, i, "a", v) for i, v in enumerate(values)], "run_id string, sample_index long, name string, value double")


def column(df):
    return [r["value"] for r in df.orderBy("sample_index").collect()]


def test_interpolate_matches_pandas(spark):
    values = [None, None, 1.0, None, None, 4.0, None, 2.0, None]
    assert column(repair.interpolate(grid(spark, values))) == [1, 1, 1, 2, 3, 4, 3, 2, 2]
    assert column(repair.ffill(grid(spark, values))) == [1, 1, 1, 1, 1, 4, 4, 2, 2]
    assert column(repair.drop(grid(spark, values))) == [1, 4, 2]
    assert column(repair.repair(grid(spark, [float("nan"), 3.0]), "interpolate")) == [3, 3]
    with pytest.raises(ValueError):
        repair.repair(grid(spark, values), "guess")


def test_repair_by_buckets_equals_pandas(spark):
    """Buckets of all sizes, with stretches of nulls over several of them, at both ends and everywhere."""
    rng = random.Random(6)
    lines = {name: [None if rng.random() < p or 40 <= i < 75 or i < start else rng.random() for i in range(150)] for name, p, start in (("a", 0.2, 0), ("b", 0.9, 30), ("c", 1.1, 0), ("d", 0, 0))}
    rows = spark.createDataFrame([(r, i, n, v) for r in ("r", "s") for n, values in lines.items() for i, v in enumerate(values)], "run_id string, sample_index long, name string, value double").repartition(5)
    frame = pd.DataFrame(lines, dtype=float)
    for bucket in (1, 7, 97, 1000):
        for how, want in ((repair.ffill, frame.ffill().bfill()), (repair.interpolate, frame.interpolate().ffill().bfill())):
            got = how(rows, bucket).where("run_id = 's'").toPandas().pivot(index="sample_index", columns="name", values="value")
            assert np.allclose(got, want, equal_nan=True)
        kept = repair.drop(rows.where("name IN ('a', 'd')"), bucket).where("run_id = 'r'").toPandas().pivot(index="sample_index", columns="name", values="value")
        assert np.allclose(kept, frame[["a", "d"]].dropna().reset_index(drop=True)) and kept.index.tolist() == list(range(len(kept)))


def test_no_task_orders_a_run(spark):
    """Windows over samples are keyed by bucket; those keyed by run alone see a row a bucket."""
    rows = grid(spark, [1.0, None] * 40)
    plan = repair.interpolate(rows, 7)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("], [")[1] for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window")]
    assert keys and sum("bucket" in k for k in keys) == len(keys) - 2  # two carry the bucket rows


def test_repaired_matrix(spark):
    x = [[1.0, None, 5.0], [None, 2.0, 5.0], [3.0, 4.0, 5.0], [float("nan"), 6.0, None]]
    matrix = spark.createDataFrame([("r", i, v, i) for i, v in enumerate(x)], "run_id string, sample_index long, values array<double>, fault_label int")
    told = lambda how, f=None: [(r["values"], r["fault_label"]) for r in repair.repair_matrix(matrix, how, f, 2).orderBy("sample_index").collect()]
    assert told("ffill") == [([1, 2, 5], 0), ([1, 2, 5], 1), ([3, 4, 5], 2), ([3, 6, 5], 3)]
    assert told("interpolate", 2) == [([1, 2], 0), ([2, 2], 1), ([3, 4], 2), ([3, 6], 3)]
    assert told("drop") == [([3, 4, 5], 2)]
    with pytest.raises(ValueError):
        repair.repair_matrix(matrix, "guess")


def test_places_and_neighbours_along_a_run(spark):
    rows = spark.createDataFrame([(k % 2, k * k) for k in range(60)], "g int, at long")
    for bucket in (1, 50, 10**6):
        got = {r["at"]: r["place"] for r in scans.placed(rows, ["g"], "at", bucket).collect()}
        assert got == {k * k: k // 2 for k in range(60)}


def test_percentiles_by_selection(spark):
    """To the bit what sorting gives, whatever the bound, with ties that no cut can part."""
    rng = random.Random(8)
    for values in ([rng.random() for _ in range(3000)], [rng.choice([0.1, 0.2, 0.3]) for _ in range(2000)] + [rng.random() for _ in range(40)], [5.0] * 500 + [-1.0, 7.0], [2.5]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "score double").repartition(4)
        shares = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
        want = list(rows.agg(*[F.percentile("score", F.lit(s)) for s in shares]).first())
        for bound, ranges in ((10, 5), (300, 16), (10**6, 256)):
            assert selection.percentiles(rows, "score", shares, bound=bound, ranges=ranges) == want
    assert selection.percentiles(rows.limit(0), "score", [0.5]) == [None]


def test_all_null_stays_null(spark):
    rows = grid(spark, [None, None])
    assert column(repair.interpolate(rows)) == [None, None] == column(repair.ffill(rows))


def test_window_counts_and_split(spark):
    rows = spark.range(2400).select(F.lit("n").alias("run_id"), F.col("id").alias("sample_index"))
    assert windows.index(rows, 60, 5).count() == 469
    cut = windows.in_blocks(rows, 500)
    per_block = {int(r["run_id"].split(":")[1]): r["count"] for r in windows.index(cut, 60, 5).groupBy("run_id").count().collect()}
    assert sum(per_block.values()) == 425
    split = windows.split_segments(sorted(per_block), 0.15, 0.2, 42)
    sizes = {s: sum(n for k, n in per_block.items() if split[k] == s) for s in ("train", "val", "test")}
    assert sizes == {"train": 267, "val": 69, "test": 89}
    assert windows.index(rows.limit(10), 60, 5).count() == 0


def test_rolling_needs_no_whole_run(spark):
    rows = spark.range(1000).select(F.lit("n").alias("run_id"), F.col("id").alias("sample_index"), (F.col("id") * F.col("id") % 97).cast("double").alias("q"))
    got = [windows.rolling(rows, 60, 7, ["run_id"], {"m": F.col("q")}, bucket=b).orderBy("start_sample").toPandas() for b in (13, 10_000)]
    want = [np.mean([i * i % 97 for i in range(s, s + 60)]) for s in range(0, 941, 7)]
    for frame in got:
        assert np.allclose(frame["m"], want) and frame["start_sample"].tolist() == list(range(0, 941, 7))


def test_scaling_constant_sensor(spark):
    long = spark.createDataFrame([("r", i, 0, 5.0) for i in range(4)] + [("r", i, 1, float(i)) for i in range(4)], "run_id string, sample_index long, sensor int, value double")
    base = scaling.baseline(long)
    for method in ("standard", "minmax", "zscore", "percent"):
        assert all(np.isfinite(r["scaled"]) for r in scaling.scaled(long, base, method).collect())
    with pytest.raises(ValueError):
        scaling.scaled(long, base, "other")


def test_severity_bounds(spark):
    rows = spark.createDataFrame([(1.19,), (1.2,), (1.8,), (3.0,)], "s double").withColumn("t", F.lit(1.0))
    assert [r[0] for r in rows.orderBy("s").select(C.severity("s", "t")).collect()] == ["low", "medium", "high", "critical"]


def restated(flags, confirm, separate, cap, flush=False):
    out, held, gap = [], None, 0
    for k, hot in enumerate(flags):
        if held is not None:
            if hot:
                held, gap = [*held, k], 0
                if len(held) == cap:
                    out.append(held)
                    held = None
            else:
                gap += 1
                if gap == separate:
                    out.append(held)
                    held = None
        elif k + 1 >= confirm and all(flags[k + 1 - confirm : k + 1]):
            held, gap = [k], 0
    return out + ([held] if flush and held else [])


def test_state_machine():
    rng = random.Random(1)
    for _ in range(300):
        flags = [rng.random() < rng.choice([0.3, 0.7, 0.9]) for _ in range(60)]
        args = (rng.randint(1, 4), rng.randint(1, 6), rng.choice([2, 4, 200]))
        assert list(events.machine(flags, *args)) == restated(flags, *args)
        assert list(events.machine(flags, *args, True)) == restated(flags, *args, True)
    assert list(events.machine([c == "1" for c in "1111010111" + "0" * 9], 3, 8, 2)) == [[2, 3], [9]]
    assert list(events.machine([c == "1" for c in "11011"], 3, 5, 200)) == []


def test_islands_equal_machine(spark):
    rng = random.Random(2)
    runs = {f"r{k}": [rng.random() < p for _ in range(120)] for k, p in enumerate((0.3, 0.6, 0.9, 0.0))}
    rows = [(r, i, i, i + 4, float(f), 0.5, f) for r, flags in runs.items() for i, f in enumerate(flags)]
    flags = spark.createDataFrame(rows, "run_id string, window_id long, start_sample long, end_sample long, score double, threshold double, anomalous boolean")
    for flush, bucket in ((False, 100_000), (True, 7), (False, 1), (False, 31)):
        got = events.event_windows(flags, 3, 4, flush, bucket).groupBy("run_id", "event_number").agg(F.array_sort(F.collect_list("window_id")).alias("w")).orderBy("event_number").collect()
        want = [(r, e) for r, f in runs.items() for e in restated(f, 3, 4, 10**9, flush)]
        assert [(x["run_id"], x["w"]) for x in got] == want
    capped = events.capped(flags, 3, 4, cap=5).groupBy("run_id", "event_number").agg(F.array_sort(F.collect_list("window_id")).alias("w")).orderBy("run_id", "event_number").collect()
    assert [(x["run_id"], x["w"]) for x in capped] == [(r, e) for r, f in runs.items() for e in restated(f, 3, 4, 5)]
    for cap, flush, bucket in ((5, False, 7), (2, True, 3), (1, False, 10), (9, True, 1)):
        rows = events.capped(flags, 3, 4, cap, flush, bucket).orderBy("run_id", "event_number", "rn").collect()
        got = {}
        for x in rows:
            own = got.setdefault((x["run_id"], x["event_number"]), [])
            own.append(x["window_id"])
            assert x["rn"] == len(own)
        want = [(r, e) for r, f in runs.items() for e in events.machine(f, 3, 4, cap, flush)]
        assert [(r, e) for (r, _), e in sorted(got.items())] == want and want
    for bucket in (1, 5, 100):
        told = events.confirmed(flags, 3, bucket).orderBy("run_id", "window_id").collect()
        assert [x["confirmed"] for x in told if x["run_id"] == "r1"] == [k >= 2 and all(runs["r1"][k - 2 : k + 1]) for k in range(120)]


def test_metrics(spark):
    rng = np.random.default_rng(3)
    label, score = rng.integers(0, 2, 200), rng.integers(0, 20, 200).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"label": label, "score": score, "predicted": (score > 9).astype(int)}))
    p, n = score[label == 1], score[label == 0]
    assert metrics.auroc(rows).first()[0] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))
    area, before = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        recall, precision = (p >= t).mean(), label[score >= t].mean()
        area, before = area + (recall - before) * precision, recall
    assert metrics.auprc(rows).first()[0] == pytest.approx(area)
    none = rows.where("label = 0")
    assert metrics.auroc(none).first()[0] == 0 == metrics.auprc(none).first()[0]
    assert metrics.confusion(none.where("predicted = 0")).first()["precision"] == 0


def test_threshold_of_nothing(spark):
    empty = spark.createDataFrame([], "score double")
    with pytest.raises(ValueError):
        scoring.threshold_value(empty)
    with pytest.raises(ValueError):
        scoring.threshold(empty, "other")


def test_pca_residual(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 2)) @ rng.standard_normal((2, 6))
    matrix = spark.createDataFrame([("r", i, row.tolist()) for i, row in enumerate(x)], "run_id string, sample_index long, values array<double>")
    assert scoring.PCAScorer(2).fit(matrix).scores(matrix, 10, 5).agg(F.max("score")).first()[0] < 1e-9


def test_first_object():
    assert first_object('text {"a":"}"} tail') == '{"a":"}"}'
    assert first_object('{"a": {"b": "\\"}"}} {}') == '{"a": {"b": "\\"}"}}'
    assert first_object("no") is None and first_object("{bad}") is None and first_object('{"a":') is None and first_object(None) is None


def test_sanitized(spark):
    rows = spark.createDataFrame([(None, 1.5, "severe", None), ("s", 0.4, "HIGH", ["x"])], "summary string, confidence double, severity string, evidence array<string>")
    got = [tuple(r) for r in text_eval.sanitized(rows).collect()]
    assert got == [("", 0.0, "unknown", []), ("s", 0.4, "high", ["x"])]


def test_taxonomy(spark):
    assert taxonomy.sensors(spark).count() == 52 and taxonomy.couplings(spark).count() == 21 and taxonomy.faults(spark).count() == 22
    rows = taxonomy.named(spark.createDataFrame([(8,), (60,)], "sensor int")).orderBy("sensor").collect()
    assert (rows[0]["display_name"], rows[0]["subsystem"]) == ("Reactor_Temperature", "reactor_system")
    assert (rows[1]["display_name"], rows[1]["subsystem"]) == ("S61", "unknown")


def test_files(spark, tmp_path):
    for name, first in (("normal_a", 0), ("normal_b", 100)):
        (tmp_path / f"{name}.csv").write_text(" a , b\n" + "".join(f"{first + i},{i}\n" for i in range(3)))
    (tmp_path / "fault_04_run2.csv").write_text("a,b,onset\n1,2,7\n3,x,7\n")
    normal = files.load(spark, "csv", str(tmp_path / "normal*.csv")).orderBy("sample_index").collect()
    assert [r["sample_index"] for r in normal] == list(range(6)) and [r["values"][0] for r in normal] == [0, 1, 2, 100, 101, 102]
    fault = files.load(spark, "csv_faults", str(tmp_path / "fault*.csv"), onset="onset").orderBy("sample_index").collect()
    assert [(r["fault_label"], r["onset_index"], r["values"]) for r in fault] == [(42, 7, [1.0, 2.0]), (42, 7, [3.0, None])]
    with pytest.raises(ValueError):
        files.load(spark, "mat", "x")


def test_store(spark, tmp_path):
    own = store.EventStore(spark, f"file://{tmp_path}/store")
    assert own.next_number() == 1
    own.upsert(spark.createDataFrame([("ANOM-0001", 5, "a"), ("ANOM-0002", 9, "b")], "event_id string, last_sample long, report string"), 1)
    own.update_report("ANOM-0001", F.lit("new"), 2)
    assert {r["event_id"]: r["report"] for r in own.events().collect()} == {"ANOM-0001": "new", "ANOM-0002": "b"}
    assert own.next_number() == 3 and own.recent(1).first()["event_id"] == "ANOM-0002" and own.status().first()["n_events"] == 2
    own.add_followup("ANOM-0001", "q", "a")
    own.add_followup("ANOM-0001", "q2", "a2")
    many = spark.createDataFrame([("ANOM-9999", 1), ("ANOM-10000", 1)], "event_id string, last_sample long")
    assert store.status(many).first()["last_event"] == "ANOM-10000" == store.recent(many, 1).first()["event_id"]
    assert [r["id"] for r in own.followups().orderBy("id").collect()] == [1, 2] and own.followups("ANOM-0002").count() == 0
    assert [m["role"] for m in store.as_messages(own.followups()).orderBy("turn").collect()] == ["user", "assistant"] * 2
    with pytest.raises(KeyError):
        own.add_followup("ANOM-0009", "q", "a")


def test_store_of_many_writes(spark, tmp_path, monkeypatch):
    """Runs are merged, a point read touches its bucket alone, numbers are reserved by commits, and two writers agree."""
    monkeypatch.setattr(store, "FAN", 3)
    monkeypatch.setattr(store, "KEEP", 4)
    own = store.EventStore(spark, f"file://{tmp_path}/store", buckets=4)
    event = lambda k, text: spark.createDataFrame([(f"ANOM-{k:04d}", 10 * k, text)], "event_id string, last_sample long, report string")
    for k in range(14):
        own.upsert(event(own.next_number(before=k), f"r{k}"), k)
    assert own.events().count() == 14 and own.next_number() == 15
    runs = own.log.last()[1]["events"]["runs"]
    assert len(runs) <= 2 * 3 and len(own.log.versions()) == 4
    kept = {r["name"] for v in own.log.versions() for r in own.log.read(v)["events"]["runs"]}
    assert set(own.log.names("runs")) == kept
    read = own.get("ANOM-0005").inputFiles()
    assert read and all(f"bucket={own._bucket('ANOM-0005')}/" in f for f in read) and len(read) <= len(runs)
    # a batch that is run again has the number that it had, whether it was the last one or not
    assert own.next_number(before=13) == 14 and own.next_number(before=11) == 12 and own.next_number(before=14) == 15
    own.upsert(event(14, "again"), 13)
    assert own.get("ANOM-0014").first()["report"] == "again" and own.next_number() == 15 and own.events().count() == 14
    # a writer that died before its commit leaves a run that no version names
    own._write(event(99, "lost").withColumn("version", F.lit(99)), 99)
    assert own.next_number(before=14) == 15 and own.events().count() == 14
    before = len(own.log.names("runs"))
    own.sweep(3600)
    assert len(own.log.names("runs")) == before
    own.sweep(-60)
    assert len(own.log.names("runs")) < before and own.events().count() == 14
    # new columns; one of another type is an error
    own.upsert(spark.createDataFrame([("ANOM-0020", 1.5)], "event_id string, extra double"))
    assert own.get("ANOM-0020").first()["report"] is None and own.get("ANOM-0001").first()["extra"] is None and own.next_number() == 21
    with pytest.raises(ValueError):
        own.upsert(spark.createDataFrame([("ANOM-0021", "x")], "event_id string, extra string"))
    # of two writers of one version the second goes on from the first one's
    other = store.EventStore(spark, own.path)
    state, once = own._state, []

    def raced():
        told = state()
        if not once:
            once.append(other.add_followup("ANOM-0001", "q", "a"))
        return told

    assert other.buckets == 4
    own.get("ANOM-0001").first()
    monkeypatch.setattr(own, "_state", raced)
    monkeypatch.setattr(own, "get", other.get)
    assert own.add_followup("ANOM-0001", "q2", None) == 2 and once == [1]
    told = other.followups("ANOM-0001")
    assert sorted((r["id"], r["question"]) for r in told.collect()) == [(1, "q"), (2, "q2")]
    assert all(f"bucket={own._bucket('ANOM-0001')}/" in f for f in told.inputFiles())


def test_stream_equals_batch(spark, tmp_path):
    """Records over several files and batches: state carries windows and open events from one to the next."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((160, 3))
    x[40:60] *= 3
    x[90:130] *= 3
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    for k in range(4):
        rows = [{"sample_index": i, "values": x[i].tolist(), "is_fault": False, "fault_label": 3 if i > 100 else None} for i in range(40 * k, 40 * k + 40)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "in" / "again.json").write_text((tmp_path / "in" / "0.json").read_text().split("\n")[3])  # sample 3 twice
    base = spark.createDataFrame([(s, 0.0, 1.0) for s in range(3)], "sensor int, mean double, std double")
    stream = files.read_stream(spark, f"file://{tmp_path}/in").withColumn("run_id", F.lit("r"))
    found = detector.events(stream, base, 2.5, 10, 2, 3, 4, cap=5)
    query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"file://{tmp_path}/out")
    assert [(r["start_sample"], r["n_windows"]) for r in out.where("late").collect()] == [(3, 0)]
    got = [(r["start_sample"], r["n_windows"], r["fault_label"]) for r in out.where("NOT late").orderBy("start_sample").collect()]
    q = (x * x).mean(1)
    scores = [q[s : s + 10].mean() for s in range(0, 151, 2)]
    want = restated([s > 2.5 for s in scores], 3, 4, 5)
    assert [(a, b) for a, b, _ in got] == [(2 * e[0], len(e)) for e in want] and len(want) >= 2


def test_stream_gives_gaps_up_after_a_while(spark, tmp_path):
    """A run with a missing number, one that begins late, and a record that comes when its number is given up."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    x = hot_run()
    (tmp_path / "in").mkdir()
    line = lambda run, i: json.dumps({"run_id": run, "sample_index": i, "values": x[i].tolist(), "fault_label": None})
    (tmp_path / "in" / "0.json").write_text("\n".join([*(line("gap", i) for i in range(160) if i != 20), *(line("late", i) for i in range(30, 160))]))
    stream = spark.readStream.schema("run_id string, sample_index long, values array<double>, fault_label int").json(f"file://{tmp_path}/in")
    found = detector.events(stream, unit(spark), 2.5, 10, 2, 3, 4, wait=1.0)
    out = f"file://{tmp_path}/out"
    query = found.drop("errors", "means").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    told = lambda where: sorted(tuple(r) for r in spark.read.schema("run_id string, start_sample long, last_sample long, n_windows int, late boolean").parquet(out).where(where).collect())

    def until(test):
        stop = time.monotonic() + 90
        while time.monotonic() < stop:
            if (tmp_path / "out").is_dir() and test():
                return True
            time.sleep(0.5)
        return False

    want = []
    for run, numbers in (("gap", [i for i in range(160) if i != 20]), ("late", list(range(30, 160)))):
        q = (x[numbers] ** 2).mean(1)
        ends = range(10, len(numbers) + 1, 2)
        for e in restated([q[n - 10 : n].mean() > 2.5 for n in ends], 3, 4, 200):
            want.append((run, numbers[ends[e[0]] - 10], numbers[ends[e[-1]] - 1], len(e), False))
    try:
        assert until(lambda: told("NOT late") == sorted(want)) and len(want) >= 4
        (tmp_path / "in" / "1.json").write_text(line("gap", 20))
        assert until(lambda: told("late") == [("gap", 20, 20, 0, True)])
    finally:
        query.stop()


def test_watermarked_windows_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frame = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:05", "2024-01-01 00:40", "2024-01-01 05:00"]), "user_id": [1, 1, 1], "event_type": "a", "value": [1.0, 2.0, 3.0]})
    spark.createDataFrame(frame).coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    stream = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in/a").schema).parquet(f"file://{tmp_path}/in/*")
    query = timed.hopping(timed.timed(stream, "10 minutes")).writeStream.format("memory").queryName("hops").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hops").where("n > 0").count() >= 3


def stream_of(spark, folder, x, name="in", per_file=None):
    """Records of one run as a stream, in files of ``per_file`` samples."""
    (folder / name).mkdir()
    step = per_file or len(x)
    for k in range(0, len(x), step):
        rows = [{"sample_index": i, "values": x[i].tolist(), "is_fault": False, "fault_label": 7 if i > 40 else None} for i in range(k, min(k + step, len(x)))]
        (folder / name / f"{k:05d}.json").write_text("\n".join(map(json.dumps, rows)))
    return files.read_stream(spark, f"file://{folder}/{name}").withColumn("run_id", F.lit("r"))


def hot_run():
    x = np.random.default_rng(4).standard_normal((160, 3))
    x[40:60] *= 3
    x[90:130] *= 3
    return x


BASE = "sensor int, mean double, std double, low double, high double, n long"


def unit(spark, n=3):
    return spark.createDataFrame([(s, 0.0, 1.0, -1.0, 1.0, 9) for s in range(n)], BASE)


def test_online_path(spark, tmp_path):
    """Two streams into one store: numbers go on, a repeated batch adds nothing, late records get out."""
    x = hot_run()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    kept = store.EventStore(spark, f"file://{tmp_path}/store")
    late = []
    found = detector.events(stream_of(spark, tmp_path, x, per_file=60), unit(spark), 2.5, 10, 2, 3, 4)
    online.start(found, unit(spark), 2.5, kept, f"file://{tmp_path}/state", 2, late=lambda rows: late.append(rows.count())).awaitTermination()
    got = kept.events().orderBy("start_sample").collect()
    q = (x * x).mean(1)
    scores = [q[s : s + 10].mean() for s in range(0, 151, 2)]
    want = restated([s > 2.5 for s in scores], 3, 4, 200)
    assert [(r["start_sample"], r["n_windows"]) for r in got] == [(2 * e[0], len(e)) for e in want] and want
    assert [r["event_id"] for r in got] == [f"ANOM-{k + 1:04d}" for k in range(len(got))] and sum(late) == 0
    assert all(r["fault_label"] == 7 and r["detection_time"] and r["created_at"] and r["report"]["summary"] for r in got)
    errors = np.array([(x[s : s + 10] ** 2).mean(0) for s in [2 * k for k in want[0]]])
    assert np.allclose(got[0]["sensor_time_series"]["per_sensor_mean_error"], errors.mean(0))
    assert kept.next_number(before=0) == 1 and kept.next_number() == len(got) + 1 == kept.next_number(before=10**6)
    kept.upsert(kept.events().drop("version"), version=99)
    assert kept.events().count() == len(got)


def test_stream_rejects_a_vector_of_another_length(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    found = detector.events(stream_of(spark, tmp_path, np.ones((20, 1))), unit(spark), 2.5, 10, 2).drop("errors", "means")
    with pytest.raises(Exception, match="has 1 values, the baseline has 3"):
        found.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()


def matrix_of(spark, x):
    return spark.createDataFrame([("r", i, row.tolist(), None) for i, row in enumerate(x)], "run_id string, sample_index long, values array<double>, fault_label int")


def test_matrix_scores_equal_terms(spark):
    matrix = matrix_of(spark, hot_run())
    long = matrix.select("run_id", "sample_index", F.posexplode("values").alias("sensor", "value"))
    base = scaling.baseline(long)
    for phase in ("full", "stride"):
        a = scoring.matrix_scores(matrix, base, 10, 4, bucket=17, phase=phase).orderBy("window_id").toPandas()
        b = scoring.window_scores(scoring.squared(long, base), 10, 4, phase=phase).orderBy("window_id").toPandas()
        assert np.allclose(a["score"], b["score"]) and (a["end_sample"] == b["end_sample"]).all()
        assert a["end_sample"].tolist() == [r["end_sample"] for r in windows.index(matrix, 10, 4, phase).orderBy("window_id").collect()]
    told = scoring.record_results(matrix, base, 1.5, 10, 4).orderBy("sample_index").toPandas()
    assert told["window_id"].isna().sum() == 9 and told["score"].notna().sum() == len(a)
    assert (told.loc[told["score"].notna(), "sample_index"] % 4 == 3).all()
    with pytest.raises(Exception, match="components of the baseline"):
        scoring.matrix_scores(matrix_of(spark, np.ones((20, 2))), base, 10, 4).collect()


def test_matrix_errors_equal_window_errors(spark):
    x = hot_run()
    matrix = matrix_of(spark, x).repartition(3)
    long = matrix.select("run_id", "sample_index", F.posexplode("values").alias("sensor", "value"))
    base = scaling.baseline(long)
    for phase, bucket in (("full", 17), ("stride", 1), ("full", 10_000)):
        got = scoring.by_sensor(scoring.matrix_errors(matrix, base, 10, 4, bucket, phase)).orderBy("window_id", "sensor").toPandas()
        want = scoring.window_errors(scoring.squared(long, base), 10, 4, phase=phase).orderBy("window_id", "sensor").toPandas()
        assert np.allclose(got["error"], want["error"]) and np.allclose(got["mean_value"], want["mean_value"]) and len(got) == len(want)
        assert (got[["start_sample", "end_sample", "sensor"]] == want[["start_sample", "end_sample", "sensor"]]).all().all()
    holes = [[None if (i + s) % 3 == 0 or s == 2 else float(v) for s, v in enumerate(row)] for i, row in enumerate(x)]
    partial = spark.createDataFrame([("r", i, v) for i, v in enumerate(holes)], "run_id string, sample_index long, values array<double>")
    rows = scoring.matrix_errors(partial, base, 10, 4).orderBy("window_id").collect()
    own = [v for v in (holes[i][0] for i in range(10)) if v is not None]
    assert rows[0]["means"][0] == pytest.approx(np.mean(own)) and rows[0]["errors"][2] is None and rows[0]["means"][2] is None
    with pytest.raises(Exception, match="the baseline has 3"):
        scoring.matrix_errors(matrix_of(spark, np.ones((20, 2))), base, 10, 4).collect()


def test_artifacts(spark, tmp_path):
    matrix = matrix_of(spark, hot_run())
    base = scaling.baseline(matrix.select("run_id", "sample_index", F.posexplode("values").alias("sensor", "value")))
    for name, scorer in (("plain", None), ("pca", scoring.PCAScorer(2).fit(matrix))):
        own = artifacts.Fitted(base, 1.5, {"size": 10, "stride": 2}, scorer)
        artifacts.save(own, f"file://{tmp_path}/{name}")
        again = artifacts.load(spark, f"file://{tmp_path}/{name}")
        assert again.describe() == own.describe() and again.describe()["n_sensors"] == 3
        a, b = (f.scores(matrix).orderBy("window_id").toPandas() for f in (own, again))
        assert np.allclose(a["score"], b["score"]) and (a["anomalous"] == b["anomalous"]).all()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        artifacts.load(spark, f"file://{tmp_path}/none")
    assert artifacts.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}


def test_text_model_and_followups(spark):
    kind = "event_id string, max_score double, evidence struct<event_id:string,anomaly_score:double,severity:string,pre_anomaly_context:struct<duration_minutes:double,status:string>,top_anomalous_sensors:array<struct<display_name:string,deviation_percent:double,trend:string,contribution:double>>,temporal_sequence:array<struct<place:int,display_name:string,relative_time_minutes:double>>,candidate_subsystem:string>"
    rows = spark.createDataFrame([(f"ANOM-000{k}", 2.0, (f"ANOM-000{k}", 2.0, "high", (0.5, "normal"), [("Level", 4.0, "stable", 0.5)], [], "reactor")) for k in (1, 2)], kind)
    model = lambda p: F.when(F.contains(p, F.lit("ANOM-0001")), 'So: {"summary": "s", "severity": "HIGH", "confidence": 7} end').otherwise("no idea")
    one, two = (r["report"].asDict() for r in reports.model_reports(rows, model).orderBy("event_id").collect())
    assert (one["summary"], one["severity"], one["confidence"], one["evidence"], one["root_cause"]) == ("s", "high", 0.0, [], "")
    assert (two["summary"], two["root_cause"], two["affected_subsystem"], two["severity"]) == ("no idea", "unable_to_parse", "reactor", "high")
    past = spark.createDataFrame([(1, "ANOM-0001", "first?", "yes"), (2, "ANOM-0001", "second?", None)], "id long, event_id string, question string, answer string")
    asked = spark.createDataFrame([("ANOM-0001", "third?"), ("ANOM-0002", "why?"), ("ANOM-0009", "who?")], "event_id string, question string")
    got = [r["prompt"] for r in reports.followup_prompts(asked, reports.model_reports(rows, model), past).orderBy("event_id").collect()]
    assert got[2] is None and '"confidence":0.0' in got[0] and got[0].endswith("third?<|im_end|><|im_start|>assistant\n")
    places = [got[0].index(t) for t in ("Report:", "first?", "assistant\nyes", "second?", "third?")]
    assert places == sorted(places) and got[1].count("<|im_start|>user") == 2


def test_summary_takes_the_last_label(spark):
    rows = spark.createDataFrame([(1, "r", k, k, k + 5, 2.0, 1.0, label) for k, label in enumerate([3, 4, None])], "event_number int, run_id string, window_id long, start_sample long, end_sample long, score double, threshold double, fault_label int")
    assert events.summary(rows).first()["fault_label"] == 4
