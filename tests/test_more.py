"""Files by blocks, CSV streams, the recurrent scorer, reachability, views and the app object."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import hot_run, matrix_of, restated
from tidegauge.app import Monitor
from tidegauge.operators import evidence, reach, recurrent, scaling, scoring, store, taxonomy, windows
from tidegauge.plans.views import Views
from tidegauge.sources import artifacts, files, tables
from tidegauge.streaming import numbering, online


def lines(x, header="a,b,c"):
    return header + "\n" + "".join(",".join(map(str, row)) + "\n" for row in x)


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_of_files_in_many_blocks_keep_their_numbers(spark, tmp_path, small_blocks):
    x = {name: [[k, k * k, 0.5] for k in range(n)] for name, n in (("fault_02", 400), ("fault_11", 3), ("fault_1_b", 170))}
    for name, rows in x.items():
        (tmp_path / f"{name}.csv").write_text(lines(rows))
    rows = files.fault_runs(spark, str(tmp_path / "*.csv"))
    assert rows.rdd.getNumPartitions() > 1
    got = {}
    for r in rows.collect():
        got.setdefault(r["run_id"], {})[r["sample_index"]] = r["values"]
    assert got == {f"{name}.csv": dict(enumerate(own)) for name, own in x.items()}
    normal = files.normal_runs(spark, str(tmp_path / "*.csv")).orderBy("sample_index").collect()
    assert [r["values"] for r in normal] == [row for name in sorted(x, key=lambda n: f"{n}.csv") for row in x[name]]
    assert [r["sample_index"] for r in normal] == list(range(573))
    onset = files.fault_runs(spark, str(tmp_path / "fault_02.csv"), onset="a")
    assert onset.select("onset_index").distinct().collect()[0][0] == 0 and onset.first()["values"] == [0.0, 0.5]


def test_read_repair_truncate_in_one_call(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c\n1,2,3\n,5,x\n7,8,9\n")
    told = lambda **o: [r["values"] for r in files.load(spark, "csv", str(tmp_path / "n.csv"), **o).orderBy("sample_index").collect()]
    assert told() == [[1, 2, 3], [None, 5, None], [7, 8, 9]]
    assert told(repair="interpolate", features=2) == [[1, 2], [4, 5], [7, 8]]
    assert told(repair="drop", features=1) == [[1], [7]] and told(features=1) == [[1], [None], [7]]
    with pytest.raises(ValueError):
        told(repair="guess")


def test_csv_stream_with_a_fault_spliced_in_equals_batch(spark, tmp_path, small_blocks):
    """Files in order of arrival, of several blocks, in several batches; numbers go on after a restart."""
    x = hot_run()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    (tmp_path / "in").mkdir()
    import os

    for k, name in enumerate(("z", "a", "m")):  # arrival is not the order of names
        path = tmp_path / "in" / f"{name}.csv"
        path.write_text(lines(x[60 * k : 60 * k + 60].tolist()))
        os.utime(path, (10**9 + 10 * k, 10**9 + 10 * k))
    stream = lambda: files.csv_stream(spark, f"file://{tmp_path}/in", ["a", "b", "c"], run_id="r")
    base = spark.createDataFrame([(s, 0.0, 1.0) for s in range(3)], "sensor int, mean double, std double")
    fault = spark.createDataFrame([(i, [5.0, 5.0, 0.1 * i], 9) for i in range(4)], "sample_index long, values array<double>, fault_label int")
    options = {"size": 10, "stride": 2, "confirm": 3, "separate": 4}
    spliced = np.array([[5.0, 5.0, 0.1 * ((i - 135) % 4)] if i >= 135 else x[i] for i in range(160)])

    def want(x):
        q = (x * x).mean(1)
        return [(2 * e[0], len(e)) for e in restated([q[s : s + 10].mean() > 2.5 for s in range(0, 151, 2)], 3, 4, 200)]

    for name, own, more in (("plain", x, {}), ("fault", spliced, {"fault": fault, "inject_at": 135})):
        out = numbering.run(stream(), base, 2.5, f"file://{tmp_path}/{name}", **more, **options)
        assert [(r["start_sample"], r["n_windows"]) for r in out.where("NOT late").orderBy("start_sample").collect()] == want(own) != []
    kept = spark.read.parquet(f"{tmp_path}/plain/numbered/out").orderBy("sample_index").collect()
    assert [r["sample_index"] for r in kept] == list(range(160)) and np.allclose([r["values"] for r in kept], x)
    (tmp_path / "in" / "later.csv").write_text(lines(x[:5].tolist()))
    numbering.run(stream(), base, 2.5, f"file://{tmp_path}/plain", **options)
    again = spark.read.parquet(f"{tmp_path}/plain/numbered/out").orderBy("sample_index").collect()
    assert [r["sample_index"] for r in again] == list(range(165)) and np.allclose(again[160]["values"], x[0])


def sigmoid(v):
    return 1 / (1 + np.exp(-v))


def cell(x, h, c, w):
    gates = w["w_in"] @ x + w["b_in"] + w["w_own"] @ h + w["b_own"]
    i, f, g, o = np.split(gates, 4)
    c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
    return sigmoid(o) * np.tanh(c), c


def rebuilt(x, weights):
    """One window, one step and one layer at a time."""
    seq = list(x)
    for layer in weights["encoder"]:
        outs, lasts = [], []
        for way, w in enumerate(layer):
            h = c = np.zeros(w["w_own"].shape[1])
            out = []
            for v in seq[::-1] if way else seq:
                h, c = cell(v, h, c, w)
                out.append(h)
            lasts.append(h)
            outs.append(out[::-1] if way else out)
        seq = [np.concatenate(parts) for parts in zip(*outs, strict=True)]
    latent = weights["project"]["w"] @ np.concatenate(lasts) + weights["project"]["b"]
    start = (weights["start"]["w"] @ latent + weights["start"]["b"]).reshape(len(weights["decoder"]), -1)
    seq = [np.zeros(x.shape[1])] * len(x)
    for w, h in zip(weights["decoder"], start, strict=True):
        c, out = np.zeros_like(h), []
        for v in seq:
            h, c = cell(v, h, c, w)
            out.append(h)
        seq = out
    return np.array([weights["out"]["w"] @ h + weights["out"]["b"] for h in seq])


@pytest.mark.parametrize(("layers", "both", "bucket", "phase"), [(1, False, 7, "full"), (2, True, 50, "stride"), (2, False, 4096, "full")])
def test_recurrent_scorer_equals_a_loop(spark, layers, both, bucket, phase):
    x = hot_run()
    matrix = matrix_of(spark, x).repartition(3)
    rng = np.random.default_rng(layers)
    weights = recurrent.drawn(3, hidden=5, layers=layers, latent=4, both=both, seed=3)
    weights["out"] = {"w": rng.normal(size=(3, 5)), "b": rng.normal(size=3)}
    scorer = recurrent.RecurrentScorer(weights, x.mean(0), x.std(0))
    scorer = recurrent.RecurrentScorer.restored(json.loads(json.dumps(scorer.saved())))
    got = scorer.errors(matrix, 6, 4, phase, bucket).orderBy("window_id").collect()
    z = (x - x.mean(0)) / x.std(0)
    ends = range(windows.first_end(6, 4, phase), len(x) + 1, 4)
    assert [(r["window_id"], r["start_sample"], r["end_sample"]) for r in got] == [(k, e - 6, e - 1) for k, e in enumerate(ends)]
    want = [np.square(z[e - 6 : e] - rebuilt(z[e - 6 : e], weights)).mean(0) for e in ends]
    assert np.allclose([r["errors"] for r in got], want)
    scores = scorer.scores(matrix, 6, 4, phase, bucket).orderBy("window_id").collect()
    assert np.allclose([r["score"] for r in scores], np.mean(want, 1))


def test_fitted_recurrent_scorer_rebuilds_a_wave_and_is_saved(spark, tmp_path):
    t = np.arange(400)
    x = np.stack([np.sin(t / 5), np.cos(t / 5), np.sin(t / 5 + 1)], 1)
    matrix = matrix_of(spark, x)
    base = scaling.baseline(tables.to_long(matrix))
    scorer = recurrent.RecurrentScorer.fit(matrix, base, 10, 5, hidden=24, layers=1, latent=8)
    own = scorer.scores(matrix, 10, 5).agg(F.avg("score")).first()[0]
    noise = scorer.scores(matrix_of(spark, np.random.default_rng(1).standard_normal((400, 3))), 10, 5).agg(F.avg("score")).first()[0]
    assert own < 0.1 and noise > 5 * own
    fitted = artifacts.Fitted(base, 0.5, {"size": 10, "stride": 5}, scorer)
    artifacts.save(fitted, f"file://{tmp_path}/d")
    again = artifacts.load(spark, f"file://{tmp_path}/d")
    assert again.describe()["scorer"] == "recurrent"
    assert [r["score"] for r in again.scores(matrix).orderBy("window_id").collect()] == pytest.approx([r["score"] for r in fitted.scores(matrix).orderBy("window_id").collect()])


def test_reachable_with_cycles(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(1, 1), (2, 3), (3, 2)}
    rows = spark.createDataFrame([*edges, (None, 4), (7, None), (2, 3)], "src int, dst int")
    starts = [0, 1, 2, 7, 99]
    want = []
    for s in starts:
        known, front, hop = {}, {d for a, d in edges if a == s}, 0
        while front:
            hop += 1
            known |= dict.fromkeys(front, hop)
            front = {d for a, d in edges if a in front} - set(known)
        want += [(s, n, h) for n, h in known.items()]
    sources = spark.createDataFrame([(s,) for s in [*starts, 2, None]], "src int")
    assert sorted(tuple(r) for r in taxonomy.reachable(rows, sources).collect()) == sorted(want)
    assert sorted(tuple(r) for r in taxonomy.reachable(rows, sources, most=2).collect()) == sorted(w for w in want if w[2] <= 2)
    assert taxonomy.reachable(rows.limit(0), sources).count() == 0


def test_views_and_functions_in_sql(spark):
    matrix = matrix_of(spark, hot_run())
    follow = spark.createDataFrame([(1, "ANOM-0001", "q")], "id long, event_id string, question string")
    told = Views(10, 2, 90.0, 3, 4, flush=True).register(matrix, followups=follow)
    for name in ("samples", "sensor_long", "baseline", "windows", "scores", "event_windows", "anomaly_events", "followups"):
        assert spark.table(name).count() == told[name].count() > 0
    got = spark.sql("SELECT w.window_id, w.pos, s.sample_index FROM samples s, LATERAL windows_of(s.sample_index, s.last, 10, 3) w")
    want = windows.exploded(matrix.select("run_id", "sample_index"), 10, 3).select("window_id", "pos", "sample_index")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, spark.sql("SELECT * FROM window_index(160, 10, 2)").collect())) == sorted(tuple(r)[1:] for r in windows.index(matrix, 10, 2).collect())
    assert spark.sql("SELECT * FROM window_index(5, 10, 2)").count() == 0
    joined = spark.sql("SELECT e.event_id, f.question FROM anomaly_events e LEFT JOIN followups f USING (event_id) ORDER BY 1").collect()
    assert joined[0]["question"] == "q" and len(joined) == told["anomaly_events"].count()


def test_monitor_from_fit_to_store(spark, tmp_path):
    x = hot_run()
    quiet = matrix_of(spark, np.random.default_rng(7).standard_normal((300, 3)))
    own = Monitor.fit(quiet, size=10, stride=2, separate=4)
    own.save(f"file://{tmp_path}/m")
    again = Monitor.load(spark, f"file://{tmp_path}/m")
    matrix = matrix_of(spark, x)
    found = again.events(matrix).orderBy("start_sample").collect()
    assert found and again.settings["size"] == 10 and len(found) == again.reports(matrix).count() == again.evidence(matrix).count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", online.ROCKSDB)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"sample_index": i, "values": v.tolist(), "is_fault": False, "fault_label": None}) for i, v in enumerate(x)))
    stream = files.read_stream(spark, f"file://{tmp_path}/in").withColumn("run_id", F.lit("r"))
    kept = store.EventStore(spark, f"file://{tmp_path}/store")
    again.watch(stream, kept, f"file://{tmp_path}/state").awaitTermination()
    closed = kept.events().orderBy("start_sample").collect()
    assert [r["start_sample"] for r in closed] == [r["start_sample"] for r in found][: len(closed)] and closed
    assert again.views(matrix)["scores"].where("anomalous").count() == again.scores(matrix).where("anomalous").count()


def test_deviations_by_size_and_window_files(spark, tmp_path):
    rows = spark.createDataFrame([("e", 0, 5.0), ("e", 1, -9.0), ("e", 2, 9.0), ("f", 0, 1.0)], "event_id string, sensor int, deviation_percent double")
    assert sorted(tuple(r)[:2] + (r["place"],) for r in evidence.by_size(rows).collect()) == [("e", 0, 3), ("e", 1, 1), ("e", 2, 2), ("f", 0, 1)]
    matrix = matrix_of(spark, hot_run())
    own = windows.gathered(matrix, 10, 5).withColumn("split", F.when(F.col("window_id") % 3 == 0, "val").otherwise("train"))
    told = {r["split"]: tuple(r)[1:] for r in files.write_windows(own, f"file://{tmp_path}/w").collect()}
    assert told == {"val": (11, 10, 3), "train": (20, 10, 3)}
    first = spark.read.parquet(f"{tmp_path}/w/split=val").where("window_id = 3").first()
    assert np.allclose(first["values"], hot_run()[15:25])


def test_reachable_crosses_shards_and_blocks_of_sources(spark, monkeypatch):
    """A long chain takes a round for each shard that it crosses, not one for each step; loops and shortcuts give fewest steps."""
    rng, written = random.Random(5), []
    edges = [(k, k + 1) for k in range(299)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(7, 7), (299, 3)]
    sources = [0, 7, 3, 120, *range(200, 280), 999]
    rows = spark.createDataFrame(edges, "src long, dst long")
    follow = {}
    for a, b in edges:
        follow.setdefault(a, set()).add(b)
    want = []
    for s in sources:
        seen, front, hop = {}, {s}, 0
        while front:
            hop += 1
            front = {b for a in front for b in follow.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, hop)
        want += [(s, n, h) for n, h in seen.items()]
    plain_cut = reach.cut
    monkeypatch.setattr(reach, "cut", lambda df, label: written.append(label) or plain_cut(df, label))
    told = taxonomy.reachable(rows, spark.createDataFrame([(s,) for s in sources], "src long"), shard=150)
    assert sorted(tuple(r) for r in told.collect()) == sorted(want)
    assert max(h for *_, h in want) > 2 * written.count("round") > 2
