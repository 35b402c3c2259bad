"""Registered queries of the sensor library, each a few operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.app import Monitor
from tidegauge.functions import columns as C
from tidegauge.functions.json_scan import extract_json
from tidegauge.operators import datagen, events, evidence, metrics, recurrent, repair, reports, scaling, scoring, store, taxonomy, text_eval, windows
from tidegauge.plans.oracles import ORACLES
from tidegauge.plans.views import Views
from tidegauge.sources import files, shared, tables
from tidegauge.streaming import detector, numbering, online, timed

SIZE, STRIDE = 60, 5  # windows of scores
E_SIZE, E_STRIDE, E_PERCENTILE, CONFIRM, SEPARATE = 5, 1, 90.0, 3, 5  # windows of events
BLOCK, SEED = 500, 42


def r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _long(spark, d):
    return tables.to_long(tables.sensor_matrix(spark, d))


def _base(spark, d):
    return scaling.baseline(_long(spark, d))


def _terms(spark, d):
    long = _long(spark, d)
    return scoring.squared(long, scaling.baseline(long))


def _grid(spark, d):
    return tables.grid_long(tables.hourly_grid(spark, d))


def _flags(spark, d):
    scores = scoring.matrix_scores(tables.sensor_matrix(spark, d), _base(spark, d), E_SIZE, E_STRIDE)
    limit = scoring.threshold_value(scores, percentile=E_PERCENTILE)
    return scoring.flagged(scores, limit)


def _event_windows(spark, d):
    return events.event_windows(_flags(spark, d), CONFIRM, SEPARATE)


def _event_sensors(spark, d, own=None):
    """event_id, rn, sensor, error, mean_value of the windows of events."""
    own = (_event_windows(spark, d) if own is None else own).select("run_id", "window_id", "rn", C.event_name("event_number").alias("event_id"))
    errors = scoring.matrix_errors(tables.sensor_matrix(spark, d), _base(spark, d), E_SIZE, E_STRIDE)
    return scoring.by_sensor(errors.join(own, ["run_id", "window_id"]))


# sources and repair
def grid_pivot(spark, d):
    return tables.hourly_grid(spark, d).drop("run_id").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH")).withColumns({k: F.round(k, 6) for k in ("click", "view", "purchase", "signup", "error") if k in tables.hourly_grid(spark, d).columns})


def _repaired(how):
    """Buckets of 97 samples, as a run of any length is cut."""
    return lambda spark, d: how(_grid(spark, d), 97).select("sample_index", "name", F.round("value", 6).alias("value"))


def null_cells(spark, d):
    return _grid(spark, d).groupBy("name").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count("value").alias("n_value"))


def file_labels(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", F.concat(F.lit("fault_"), F.lpad((F.col("doc_id") % 22).cast("string"), 2, "0"), F.when(F.col("doc_id") % 3 == 0, "_run2").otherwise("")).alias("stem"))
    return rows.select("doc_id", files.fault_id("stem").alias("fault_id"), files.fault_label("stem").alias("fault_label"))


def fault_splice(spark, d):
    matrix = tables.sensor_matrix(spark, d)
    fault = matrix.select("sample_index", F.transform("values", lambda v: v + 10).alias("values"), F.lit(4).alias("fault_label"))  # a second run, whole
    out = detector.replay(matrix, fault, 200)
    return out.select("sample_index", "fault_label", F.round(F.element_at("values", 1), 6).alias("first"))


def _as_csv(spark, matrix, names, files_of=3) -> str:
    """The matrix as delimited files in order, null components empty."""
    folder = shared.folder(spark, "csv")
    rows = matrix.repartitionByRange(files_of, "sample_index").sortWithinPartitions("sample_index").select(*[F.col("values")[k].alias(n) for k, n in enumerate(names)])
    rows.write.option("header", True).csv(folder)
    return folder


def csv_matrix(spark, d):
    """The matrix written as several files and read as one run, numbered through them."""
    matrix = tables.sensor_matrix(spark, d)
    names = [f" s{k} " for k in range(matrix.agg(F.max(F.size("values"))).first()[0])]
    rows = files.load(spark, "csv", f"{_as_csv(spark, matrix, names)}/*.csv")
    return rows.select("sample_index", F.size("values").alias("n_values"), F.round(F.element_at("values", 1), 6).alias("first"), F.round(F.element_at("values", -1), 6).alias("last"))


def csv_repaired(spark, d):
    """Files with gaps: read, repaired and cut to five sensors by one call."""
    matrix = tables.sensor_matrix(spark, d)
    holed = matrix.withColumn("values", F.transform("values", lambda v, s: F.when((F.col("sample_index") + s) % 11 > 2, v)))
    names = [f"s{k}" for k in range(matrix.agg(F.max(F.size("values"))).first()[0])]
    rows = files.load(spark, "csv", f"{_as_csv(spark, holed, names)}/*.csv", repair="interpolate", features=5)
    return rows.select("sample_index", F.posexplode("values").alias("sensor", "value")).withColumn("value", F.round("value", 6))


def csv_faults(spark, d):
    """A file a label, read as fault runs: label and identifier from the name, onset from a column, rows numbered in each."""
    folder = shared.folder(spark, "faults")
    matrix = tables.sensor_matrix(spark, d)
    for row in matrix.select("fault_label").distinct().where("fault_label IS NOT NULL").collect():  # a label a file
        own = matrix.where(F.col("fault_label") == row[0]).select("sample_index", F.element_at("values", 1).alias("a"), F.lit(20 + row[0]).alias("onset"))
        own.coalesce(1).sortWithinPartitions("sample_index").write.option("header", True).csv(f"{folder}/{row[0]}")
        source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}/{row[0]}", f"{folder}/fault_{row[0]:02d}.csv"))
        store_of = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store_of.rename(next(x.getPath() for x in store_of.listStatus(source) if x.getPath().getName().startswith("part-")), target)
    rows = files.load(spark, "csv_faults", f"{folder}/fault_*.csv", onset="onset")
    return rows.select("run_id", "sample_index", "fault_label", "onset_index", F.element_at("values", 1).cast("long").alias("vec_id"))


def records_round_trip(spark, d):
    """Events as line-delimited JSON and back."""
    path = shared.folder(spark, "records")
    tables.table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return files.read_records(spark, path, "event_id long, event_type string, value double").withColumn("value", F.round("value", 6))


# scaling
def baseline_stats(spark, d):
    return _base(spark, d).select("sensor", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


def _scaled(method):
    def query(spark, d):
        long = _long(spark, d)
        return scaling.scaled(long, scaling.baseline(long), method).select("sample_index", "sensor", F.round("scaled", 6).alias("scaled"))

    return query


def scale_inverse(spark, d):
    long = _long(spark, d)
    base = scaling.baseline(long)
    return scaling.restored(scaling.scaled(long, base), base).select("sample_index", "sensor", F.round("value", 6).alias("value"))


# windows and splits
def sliding_windows(spark, d):
    return windows.index(tables.sensor_matrix(spark, d), SIZE, STRIDE).drop("run_id")


def sliding_windows_stride_phase(spark, d):
    return windows.index(tables.sensor_matrix(spark, d), SIZE, 7, phase="stride").drop("run_id")


def window_samples(spark, d):
    rows = windows.exploded(tables.sensor_matrix(spark, d).select("run_id", "sample_index"), SIZE, STRIDE)
    return rows.select("window_id", "pos", "sample_index")


def block_windows(spark, d):
    cut = windows.in_blocks(tables.sensor_matrix(spark, d).select("run_id", "sample_index"), BLOCK // 2)
    return windows.index(cut, SIZE, STRIDE).withColumnRenamed("run_id", "block")


def segment_split(spark, d):
    cut = windows.in_blocks(tables.sensor_matrix(spark, d).select("run_id", "sample_index"), BLOCK // 5)
    segments = [row[0] for row in cut.select("segment").distinct().orderBy("segment").collect()]  # a number a block
    found = windows.index(cut, SIZE, STRIDE).groupBy(F.element_at(F.split("run_id", ":"), -1).cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    told = windows.with_split(cut.select("segment").distinct().join(found, "segment", "left"), windows.split_segments(segments, 0.15, 0.2, SEED))
    # the shuffle is the generator's, so what is told is its sizes; a segment too short for a window counts too
    return told.groupBy("split").agg(F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_windows"))


# scoring
def window_errors(spark, d):
    found = scoring.by_sensor(scoring.matrix_errors(tables.sensor_matrix(spark, d), _base(spark, d), SIZE, STRIDE))
    return found.select("window_id", "start_sample", "sensor", F.round("error", 6).alias("error"), F.round("mean_value", 6).alias("mean_value"))


def window_scores(spark, d):
    return scoring.matrix_scores(tables.sensor_matrix(spark, d), _base(spark, d), SIZE, STRIDE).select("window_id", "start_sample", "end_sample", F.round("score", 6).alias("score"))


def window_scores_bucketed(spark, d):
    """The same scores with small buckets, as a run of any length is cut."""
    return scoring.window_scores(_terms(spark, d), SIZE, STRIDE, bucket=97).select("window_id", "start_sample", "end_sample", F.round("score", 6).alias("score"))


def _threshold(**options):
    def query(spark, d):
        return scoring.threshold(scoring.window_scores(_terms(spark, d), SIZE, STRIDE), **options).withColumns(r("threshold", "mean_score", "std_score", "max_score"))

    return query


def score_summary(spark, d):
    return scoring.summary(scoring.window_scores(_terms(spark, d), SIZE, STRIDE)).withColumns(r("mean_score", "std_score", "max_score", "p99"))


def anomaly_flags(spark, d):
    return _flags(spark, d).select("window_id", F.round("score", 6).alias("score"), "anomalous")


def recurrent_scores(spark, d):
    """Recurrent weights from a seed, the read-out fitted on the matrix."""
    matrix = tables.sensor_matrix(spark, d)
    scorer = recurrent.RecurrentScorer.fit(matrix, _base(spark, d), 20, STRIDE, hidden=16, layers=1, latent=8)
    return scorer.scores(matrix, 20, STRIDE).select("window_id", "start_sample", "score")


def window_splits(spark, d):
    """Whole windows of blocks, written by split, and what was written."""
    cut = windows.in_blocks(tables.sensor_matrix(spark, d), BLOCK // 5)
    segments = [row[0] for row in cut.select("segment").distinct().orderBy("segment").collect()]  # a number a block
    told = windows.gathered(cut, SIZE, STRIDE).withColumn("segment", F.element_at(F.split("run_id", ":"), -1).cast("long"))
    split = windows.with_split(told, windows.split_segments(segments, 0.15, 0.2, SEED)).drop("segment")
    return files.write_windows(split, shared.folder(spark, "windows"))


def pca_scores(spark, d):
    matrix = tables.sensor_matrix(spark, d)
    return scoring.PCAScorer(5).fit(matrix).scores(matrix, SIZE, STRIDE).select("window_id", "start_sample", "score")


def daily_scores(spark, d):
    """The detector over another table: daily sums of lineitem as four sensors."""
    rows = tables.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(*[F.sum(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    line = Window.partitionBy(F.lit("run0")).orderBy("day")  # a row a day
    matrix = rows.select(F.lit("run0").alias("run_id"), (F.row_number().over(line) - 1).cast("long").alias("sample_index"), tables.vector("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("values"))
    return scoring.fit_and_score(tables.to_long(matrix), 30, 10).select("window_id", "start_sample", F.round("score", 5).alias("score"))


def artifact_scores(spark, d):
    """A detector fitted, saved, loaded again, and what it says of all windows."""
    matrix, path = tables.sensor_matrix(spark, d), shared.folder(spark, "detector")
    Monitor.fit(matrix, size=SIZE, stride=STRIDE).save(path)
    own = Monitor.load(spark, path)
    return own.scores(matrix).select("window_id", F.round("score", 6).alias("score"), F.round("threshold", 6).alias("threshold"), "anomalous")


def record_results(spark, d):
    """What each record tells, at a stride that does not divide the size."""
    matrix, base = tables.sensor_matrix(spark, d), _base(spark, d)
    return scoring.record_results(matrix, base, 1.0, SIZE, 7).select("sample_index", "window_id", F.round("score", 6).alias("score"), "anomalous")


def replay_windows(spark, d):
    return windows.replay_index(tables.sensor_matrix(spark, d), 10, 15).drop("run_id")


# events
def confirmed_runs(spark, d):
    return events.confirmed(_flags(spark, d), CONFIRM, bucket=211).select("window_id", "anomalous", "confirmed")


def event_islands(spark, d):
    return events.event_windows(_flags(spark, d), CONFIRM, SEPARATE, bucket=211).select("event_number", "rn", "window_id", F.round("score", 6).alias("score"))


def event_capped(spark, d):
    return events.capped(_flags(spark, d), CONFIRM, SEPARATE, cap=4, bucket=211).drop("run_id")


def event_summary(spark, d):
    return events.summary(_event_windows(spark, d)).drop("run_id").withColumns(r("max_score", "mean_score"))


def event_labels(spark, d):
    """The label of each event: that of its last window, which has its last sample's."""
    labels = tables.sensor_matrix(spark, d).select("run_id", F.col("sample_index").alias("end_sample"), "fault_label")
    return events.summary(_event_windows(spark, d).join(labels, ["run_id", "end_sample"])).select("event_id", "n_windows", "fault_label")


# evidence
def top_k_sensors(spark, d):
    return evidence.top_sensors(evidence.sensor_errors(_event_sensors(spark, d))).select("event_id", "rank", "sensor", F.round("worst", 6).alias("error"), F.round("contribution", 6).alias("contribution"))


def sensor_contribution(spark, d):
    rows = evidence.contributions(evidence.sensor_errors(_event_sensors(spark, d)), "mean_error")
    return rows.select("event_id", "sensor", F.round("mean_error", 6).alias("mean_error"), F.round("contribution", 6).alias("contribution"))


def event_deviation(spark, d):
    errors = evidence.sensor_errors(_event_sensors(spark, d))
    told = evidence.deviations(errors, _base(spark, d))
    kept = evidence.by_size(evidence.strong(told, 500.0, evidence.top_sensors(errors)))
    return kept.select("event_id", "place", "sensor", F.round("current_value", 6).alias("current_value"), F.round("z_score", 6).alias("z_score"), F.round("deviation_percent", 3).alias("deviation_percent"))


def sensor_trend(spark, d):
    return evidence.trends(_event_sensors(spark, d), smoothing=4).select("event_id", "sensor", F.round("slope", 6).alias("slope"), "trend")


def sensor_onsets(spark, d):
    return evidence.onsets(_event_sensors(spark, d)).select("event_id", "sensor", "onset", F.round("mean_after", 6).alias("mean_after"))


def temporal_sequence(spark, d):
    return evidence.sequence(evidence.onsets(_event_sensors(spark, d)), E_STRIDE)


def pre_post_context(spark, d):
    return evidence.context(_event_sensors(spark, d), first=3).select("event_id", "sensor", *[F.round(c, 6).alias(c) for c in ("pre_mean", "post_mean", "delta")])


def candidate_subsystem(spark, d):
    rows = taxonomy.named(evidence.top_sensors(evidence.sensor_errors(_event_sensors(spark, d))))
    return taxonomy.candidates(rows).select("event_id", "rank", "subsystem", "matched")


def sensor_names(spark, d):
    return taxonomy.named(_base(spark, d).select("sensor")).select("sensor", "name", "display_name", "subsystem")


def downstream_effects(spark, d):
    rows = taxonomy.named(_base(spark, d).select("sensor")).select("sensor", "display_name")
    return taxonomy.downstream(rows, 1)


def downstream_two_hops(spark, d):
    rows = taxonomy.named(_base(spark, d).select("sensor")).select("sensor", "display_name")
    return taxonomy.downstream(rows, 2)


def downstream_reach(spark, d):
    rows = taxonomy.named(_base(spark, d).select("sensor")).select("sensor", "display_name")
    return taxonomy.downstream(rows, None)


def customer_reach(spark, d):
    """From each nation's first customer, the fewest steps to every other one along consecutive orders (a graph with cycles)."""
    line = Window.partitionBy(F.floor(F.col("o_orderkey") / 4096)).orderBy("o_orderkey")  # orders follow each other within a book of 4,096 keys
    edges = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(line).alias("dst"))
    first = tables.table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("src"))
    return taxonomy.reachable(edges, first)


def _documents(spark, d):
    """Every branch of the evidence reads the events' windows and their sensors, so these are written once."""
    own = shared.cut(_event_windows(spark, d), "event-windows")
    rows = shared.cut(_event_sensors(spark, d, own), "event-sensors")
    out = shared.cut(evidence.documents(rows, _base(spark, d), events.summary(own), E_STRIDE), "evidence")
    shared.drop(own, rows)
    return out


def evidence_documents(spark, d):
    rows = _documents(spark, d)
    e = F.col("evidence")
    return rows.select("event_id", "start_sample", "end_sample", "n_windows", "severity", e["candidate_subsystem"].alias("candidate_subsystem"), F.round(e["candidate_subsystem_score"], 6).alias("candidate_score"), F.size(e["top_anomalous_sensors"]).alias("n_sensors"), F.size(e["temporal_sequence"]).alias("n_onsets"), F.round(e["anomaly_score"], 6).alias("anomaly_score"))


def fallback_report(spark, d):
    rows = reports.reports(_documents(spark, d))
    return _told(rows)


def _told(rows):
    """All fields of a report."""
    fields = ("summary", "root_cause", "affected_subsystem", "reasoning", "severity", "confidence", "recommended_action", "uncertainty")
    return rows.select("event_id", *[f"report.{f}" for f in fields], F.array_join("report.evidence", " | ").alias("evidence"))


def evidence_prompt(spark, d):
    return reports.prompts(_documents(spark, d)).select("event_id", "prompt")


def followup_answers(spark, d):
    asked = spark.createDataFrame([("ANOM-0001", "Why?"), ("ANOM-0002", "What now?"), ("ANOM-9999", "Who?")], "event_id string, question string")
    return reports.followup_answers(asked, _documents(spark, d))


# store and chat
def _messages(spark, d):
    return tables.table(spark, d, "conversations").withColumnRenamed("text", "content")


def conversation_history(spark, d):
    rows = store.history(_messages(spark, d))
    return rows.select("conv_id", "n_messages", F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("history"))


def chat_prompt(spark, d):
    return store.history(_messages(spark, d)).select("conv_id", reports.chat_prompt("history", "Answer briefly.").alias("prompt"))


def followup_messages(spark, d):
    rows = tables.table(spark, d, "conversations").where("role = 'user'").select(F.format_string("ANOM-%04d", "conv_id").alias("event_id"), F.col("turn").alias("id"), F.col("text").alias("question"), F.concat(F.lit("about "), F.col("role")).alias("answer"))
    return store.as_messages(rows).select("event_id", F.col("turn").cast("long").alias("turn"), "role", "content")


def events_recent(spark, d):
    rows = store.recent(events.summary(_event_windows(spark, d)), 5)
    return rows.select("event_id", "last_sample", "n_windows")


def event_with_followups(spark, d):
    asked = tables.table(spark, d, "conversations").where("role = 'user'").select(F.format_string("ANOM-%04d", F.col("conv_id") % 12).alias("event_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"), F.lit("-").alias("answer"))
    rows = store.with_followups(events.summary(_event_windows(spark, d)), asked)
    return rows.select("event_id", F.size("followups").alias("n_followups"), F.sha2(F.array_join(F.transform("followups", lambda f: f["question"]), "|").cast("binary"), 256).alias("questions_sha256"))


def report_latest(spark, d):
    rows = tables.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return store.latest(rows, "conv_id", "turn")


def store_status(spark, d):
    return store.status(events.summary(_event_windows(spark, d)))


def store_replaced(spark, d):
    """Events put into the store, some of them again with another report, and read back; numbers go on behind them."""
    kept = store.EventStore(spark, shared.folder(spark, "store"))
    found = shared.cut(events.summary(_event_windows(spark, d)).drop("run_id"), "events")
    kept.upsert(found.withColumn("report", F.lit("first")), 1)
    kept.upsert(found.where("n_windows >= 4").withColumn("report", F.lit("second")), 2)
    shared.drop(found)
    return kept.events().select("event_id", "last_sample", "n_windows", "report", F.lit(kept.next_number()).alias("next_number"))


# metrics
def _labelled(spark, d):
    rows = tables.table(spark, d, "labels").join(tables.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", (1 - F.col("quality")).alias("label"), F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("predicted"))


def confusion_metrics(spark, d):
    return metrics.confusion(_labelled(spark, d)).withColumns(r("precision", "recall", "f1", "fpr", "fnr"))


def auroc(spark, d):
    return metrics.auroc(_labelled(spark, d)).withColumns(r("auroc"))


def auprc(spark, d):
    return metrics.auprc(_labelled(spark, d)).withColumns(r("auprc"))


def _fault_windows(spark, d):
    blocks = windows.in_blocks(tables.sensor_matrix(spark, d), BLOCK // 5)
    long = tables.to_long(blocks)
    scores = scoring.fit_and_score(long, E_SIZE, E_STRIDE)
    own = scoring.flagged(scores, scoring.threshold_value(scores, percentile=99.0))
    onsets = own.select("run_id").distinct().withColumn("onset_index", F.lit(16))
    return own, onsets


def detection_delay(spark, d):
    own, onsets = _fault_windows(spark, d)
    return metrics.detection_delay(own, onsets)


def delay_summary(spark, d):
    own, onsets = _fault_windows(spark, d)
    return metrics.delay_summary(metrics.detection_delay(own, onsets)).withColumns(r("mean_delay"))


def window_labels(spark, d):
    own, onsets = _fault_windows(spark, d)
    return metrics.confusion(metrics.labelled(own, onsets, include_preonset=True)).withColumns(r("precision", "recall", "f1", "fpr", "fnr"))


# text evaluation
def text_normalize(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.sha2(C.normalized("text").cast("binary"), 256).alias("normalized_sha256"))


def token_overlap(spark, d):
    rows = tables.table(spark, d, "documents").select("doc_id", "text")
    items = tables.table(spark, d, "benchmark")
    numbered = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("k"), F.col("text").alias("reference"))  # the benchmark is small
    n = items.count()
    return rows.join(numbered, F.pmod("doc_id", F.lit(n)) == F.col("k")).select("doc_id", C.token_overlap("text", "reference", 3).alias("overlaps"))


def hedge_overclaim(spark, d):
    return text_eval.hedging(tables.table(spark, d, "documents")).select("doc_id", "hedged", "overclaiming")


def foreign_tokens(spark, d):
    return text_eval.foreign(tables.table(spark, d, "conversations")).select("conv_id", "turn", F.size("foreign_tokens").alias("n_foreign"), F.array_join("foreign_tokens", " ").alias("foreign_tokens"))


def json_extract(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", F.concat(F.lit("say "), "props", F.lit(" {tail")).alias("text"))
    return rows.select("event_id", F.get_json_object(extract_json("text"), "$.k").cast("int").alias("k"))


def sanitize_answer(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("summary"), (F.col("value") / 50).alias("confidence"), F.when(F.col("event_id") % 2 == 0, "High").otherwise("severe").alias("severity"))
    return text_eval.sanitized(rows).withColumn("confidence", F.round("confidence", 6))


def answer_metrics(spark, d):
    """Evaluation of synthetic answers: reports of as many events as the matrix has records, against their own faults."""
    made = _instruction_events(spark, d)
    answer = F.struct(F.lit("").alias("summary"), F.concat(F.lit("candidate "), "subsystem").alias("root_cause"), F.col("subsystem").alias("affected_subsystem"), F.array(F.lit("feed")).alias("evidence"), F.when(F.col("n") % 2 == 0, "likely").otherwise("it definitely is").alias("reasoning"), F.when(F.col("n") % 3 == 0, "low").otherwise(F.col("severity")).alias("severity"), F.when(F.col("n") % 5 == 0, "unable to say what to do").otherwise("inspect the feed valves first").alias("recommended_action"))
    rows = made.select(F.when(F.col("n") % 4 != 0, answer).alias("answer"), F.array(F.lit("Reactor_Level")).alias("evidence_sensors"), F.when(F.col("n") % 7 == 0, "no such name").otherwise(F.col("subsystem")).alias("fault_name"), "subsystem", "severity")
    return text_eval.evaluate(rows).select("n_samples", *[F.round(c, 6).alias(c) for c in ("root_cause_accuracy", "fault_classification_accuracy", "severity_accuracy", "evidence_consistency", "hallucination_rate", "hedged_reasoning_rate", "recommendation_rate", "json_validity_rate", "overclaiming_rate")])


# instruction data
def _instruction_events(spark, d):
    """As many events of a fault as the matrix has records with its label."""
    seen = tables.sensor_matrix(spark, d).groupBy(F.col("fault_label").alias("fault_id")).agg(F.count(F.lit(1)).alias("seen"))
    return datagen.synthetic_events(taxonomy.faults(spark).join(seen, "fault_id"), taxonomy.subsystems(spark), F.col("seen"), [3, 9], [5, 12])


def instruction_counts(spark, d):
    return datagen.samples(_instruction_events(spark, d)).groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n_samples"))


def followup_explode(spark, d):
    rows = datagen.samples(_instruction_events(spark, d)).where("kind = 'followup'")
    return rows.groupBy("fault_id", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("question").alias("n_questions"))


def fault_kb_lookup(spark, d):
    """Labels of the matrix joined with the known faults."""
    rows = tables.sensor_matrix(spark, d).groupBy(F.col("fault_label").alias("fault_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(taxonomy.faults(spark), "fault_id")


# streaming
def hop_window_avg(spark, d):
    rows = timed.hopping(timed.timed(tables.table(spark, d, "events")))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def session_windows(spark, d):
    rows = timed.sessions(timed.timed(tables.table(spark, d, "events")), "6 hours")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 6).alias("total"))


def _record_stream(spark, path: str) -> DataFrame:
    """The records of the matrix as a stream; the table is a file or a folder of files. A stream's source takes a single
    file by a pattern only, and the same pattern finds the folder."""
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return raw.select(F.lit("run0").alias("run_id"), F.col("vec_id").alias("sample_index"), F.col("embedding").cast("array<double>").alias("values"), F.col("label").alias("fault_label"))


def sql_event_summary(spark, d):
    """Events by SQL over the registered views."""
    Views(E_SIZE, E_STRIDE, E_PERCENTILE, CONFIRM, SEPARATE).register(tables.sensor_matrix(spark, d))
    return spark.sql("""
        SELECT event_id, min(start_sample) AS start_sample, max(end_sample) AS last_sample, count(*) AS n_windows, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score,
            CASE WHEN max(score) / greatest(max(threshold), 1e-9) >= 3 THEN 'critical' WHEN max(score) / greatest(max(threshold), 1e-9) >= 1.8 THEN 'high'
                WHEN max(score) / greatest(max(threshold), 1e-9) >= 1.2 THEN 'medium' ELSE 'low' END AS severity
        FROM event_windows GROUP BY event_id""")


def sql_window_samples(spark, d):
    """Samples of windows by SQL: a table function explodes each sample to its windows."""
    Views(SIZE, STRIDE).register(tables.sensor_matrix(spark, d))
    return spark.sql(f"SELECT w.window_id, w.pos, s.sample_index FROM samples s, LATERAL windows_of(s.sample_index, s.last, {SIZE}, {STRIDE}) w")


def csv_stream_events(spark, d) -> DataFrame:
    """The matrix as delimited text files, read as a stream in order of arrival, to set beside stream_events."""
    base, limit = _base(spark, d), _limit(spark, d, _base(spark, d))
    folder = online.folder(spark)
    matrix = tables.sensor_matrix(spark, d)
    names = [f"c{k}" for k in range(base.count())]
    rows = matrix.repartitionByRange(4, "sample_index").sortWithinPartitions("sample_index").select(*[F.col("values")[k].alias(n) for k, n in enumerate(names)])
    rows.write.option("header", True).csv(f"{folder}/csv")
    stream = files.csv_stream(spark, f"{folder}/csv", names, files_per_trigger=100, by_name=True)
    found = numbering.run(stream, base, limit, folder, size=E_SIZE, stride=E_STRIDE, confirm=CONFIRM, separate=SEPARATE)
    return found.where("NOT late").select("start_sample", "last_sample", "n_windows", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"))


def _limit(spark, d, base) -> float:
    return scoring.threshold_value(scoring.matrix_scores(tables.sensor_matrix(spark, d), base, E_SIZE, E_STRIDE), percentile=E_PERCENTILE)


def stream_events(spark, d) -> DataFrame:
    """Closed events from the stateful stream over the same records, to set beside event_summary."""
    base = _base(spark, d)
    folder = online.folder(spark)
    found = detector.events(_record_stream(spark, f"{d}/embeddings.parquet"), base, _limit(spark, d, base), E_SIZE, E_STRIDE, CONFIRM, SEPARATE)
    told = found.drop("errors", "means")
    told.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(told.schema).parquet(f"{folder}/out").where("NOT late")
    return rows.select("start_sample", "last_sample", "n_windows", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"))


def stream_reports(spark, d) -> DataFrame:
    """Reports of the events that the stream closed, as the event store has them, to set beside fallback_report."""
    base = _base(spark, d)
    limit = _limit(spark, d, base)
    folder = online.folder(spark)
    found = detector.events(_record_stream(spark, f"{d}/embeddings.parquet"), base, limit, E_SIZE, E_STRIDE, CONFIRM, SEPARATE)
    kept = store.EventStore(spark, f"{folder}/store")
    online.start(found, base, limit, kept, f"{folder}/state", E_STRIDE).awaitTermination()
    if kept.next_number() == 1:  # no event closed
        return _told(reports.reports(online.documents(spark.createDataFrame([], detector.EVENTS), base, limit, E_STRIDE)))
    return _told(kept.events())


def queries() -> dict:
    named = [
        grid_pivot, null_cells, file_labels, fault_splice, baseline_stats, scale_inverse, sliding_windows, sliding_windows_stride_phase, window_samples, block_windows, segment_split,
        window_errors, window_scores, window_scores_bucketed, score_summary, anomaly_flags, pca_scores, daily_scores, confirmed_runs, event_islands, event_capped, event_summary,
        top_k_sensors, sensor_contribution, event_deviation, sensor_trend, sensor_onsets, temporal_sequence, pre_post_context, candidate_subsystem, sensor_names, downstream_effects, downstream_two_hops,
        evidence_documents, fallback_report, evidence_prompt, followup_answers, conversation_history, chat_prompt, followup_messages, events_recent, event_with_followups, report_latest, store_status,
        confusion_metrics, auroc, auprc, detection_delay, delay_summary, window_labels, text_normalize, token_overlap, hedge_overclaim, foreign_tokens, json_extract, sanitize_answer, answer_metrics,
        instruction_counts, followup_explode, fault_kb_lookup, hop_window_avg, session_windows, stream_events, stream_reports, record_results, replay_windows,
        recurrent_scores, window_splits, downstream_reach, customer_reach, sql_event_summary, sql_window_samples, csv_stream_events,
        csv_matrix, csv_repaired, csv_faults, records_round_trip, artifact_scores, event_labels, store_replaced,
    ]
    out = {f.__name__: f for f in named}
    out |= {"null_drop": _repaired(repair.drop), "null_ffill": _repaired(repair.ffill), "null_interpolate": _repaired(repair.interpolate)}
    out |= {"scale_standard": _scaled("standard"), "scale_minmax": _scaled("minmax"), "zscore_eps": _scaled("zscore"), "percent_deviation": _scaled("percent")}
    out |= {"threshold_percentile": _threshold(), "threshold_mean_std": _threshold(method="mean_std", k=3.0), "threshold_validation": _threshold(method="validation_percentile", percentile=95.0)}
    return out


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
