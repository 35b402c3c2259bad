"""DuckDB SQL for the queries of the catalog, stated independently of the operators."""

from __future__ import annotations

from tidegauge.operators import taxonomy, text_eval
from tidegauge.sources.files import default_names


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


LONG = """long AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS sensor, unnest(embedding)::DOUBLE AS v, label FROM embeddings)"""
BASE = f"""{LONG}, base AS (SELECT sensor, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS low, max(v) AS high, count(*) AS n FROM long GROUP BY sensor)"""
TERMS = f"""{BASE}, terms AS (SELECT i, sensor, v, pow((v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 2) AS q FROM long JOIN base USING (sensor))"""


def _errors(size: int, stride: int) -> str:
    return f"""errors AS (SELECT * FROM (
      SELECT ((i - {size - 1}) // {stride})::BIGINT AS window_id, i - {size - 1} AS start_sample, i AS end_sample, sensor,
             avg(q) OVER w AS error, avg(v) OVER w AS mean_value, i
      FROM terms WINDOW w AS (PARTITION BY sensor ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW))
    WHERE i >= {size - 1} AND (i - {size - 1}) % {stride} = 0)"""


def _scores(size: int, stride: int, terms: str = TERMS) -> str:
    return f"""{terms}, {_errors(size, stride)}, scores AS (SELECT window_id, start_sample, end_sample, avg(error) AS score FROM errors GROUP BY ALL)"""


SCORES = _scores(60, 5)
FLAGS = f"""{_scores(5, 1)}, flags AS (SELECT *, (SELECT quantile_cont(score, 0.9) FROM scores) AS threshold,
      score > (SELECT quantile_cont(score, 0.9) FROM scores) AS anomalous FROM scores)"""
# islands by running counts over all windows: a new one where the five windows before hold no anomalous one
EVENTS = f"""{FLAGS}, told AS (
      SELECT *, coalesce(sum(anomalous::INT) OVER (ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS around,
             sum(anomalous::INT) OVER (ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS confirmed FROM flags
    ), hot AS (SELECT *, sum((around = 0)::INT) OVER (ORDER BY window_id) AS island FROM told WHERE anomalous
    ), opened AS (SELECT h.*, o.opening, o.closing FROM hot h JOIN (
        SELECT island, min(window_id) FILTER (WHERE confirmed) AS opening, max(window_id) AS closing FROM hot GROUP BY island) o USING (island)
      WHERE window_id >= opening AND (SELECT max(window_id) FROM flags) - closing >= 5
    ), ev AS (SELECT *, dense_rank() OVER (ORDER BY island) AS event_number,
        row_number() OVER (PARTITION BY island ORDER BY window_id) AS rn, printf('ANOM-%04d', dense_rank() OVER (ORDER BY island)) AS event_id FROM opened)"""
SUMMARY = f"""{EVENTS}, summary AS (SELECT event_id, min(start_sample) AS start_sample, max(end_sample) AS last_sample, count(*) AS n_windows,
      max(score) AS max_score, avg(score) AS mean_score, max(score) / greatest(max(threshold), 1e-9) AS ratio FROM ev GROUP BY event_id)"""
SEVERITY = "CASE WHEN ratio >= 3 THEN 'critical' WHEN ratio >= 1.8 THEN 'high' WHEN ratio >= 1.2 THEN 'medium' ELSE 'low' END"
SENSORS = f"""{EVENTS}, es AS (SELECT event_id, rn, errors.sensor, error, mean_value FROM errors JOIN ev USING (window_id)),
    worst AS (SELECT event_id, sensor, max(error) AS worst, avg(error) AS mean_error, avg(mean_value) AS event_mean FROM es GROUP BY ALL),
    shares AS (SELECT *, worst / sum(worst) OVER (PARTITION BY event_id) AS contribution,
        row_number() OVER (PARTITION BY event_id ORDER BY worst DESC, sensor DESC) AS rank FROM worst)"""
ONSETS = f"""{SENSORS}, limits AS (SELECT event_id, sensor, greatest(1.5 * (stddev_pop(error) + 1e-9), 0.5 * (max(error) + 1e-9)) AS lim, max(error) AS most FROM es GROUP BY ALL),
    onsets AS (SELECT event_id, sensor, min(rn) FILTER (WHERE error > lim) AS onset FROM es JOIN limits USING (event_id, sensor)
        WHERE most >= 0.25 * (SELECT max(error) FROM es e2 WHERE e2.event_id = es.event_id) GROUP BY ALL HAVING onset IS NOT NULL)"""
DEVIATIONS = """deviations AS (SELECT event_id, sensor, event_mean, (event_mean - mean) / (std + 1e-6) AS z,
      CASE WHEN abs(mean) > 1e-6 THEN (event_mean - mean) / mean * 100 ELSE (event_mean - mean) / (std + 1e-6) * 100 END AS deviation, rank, worst, contribution
    FROM shares JOIN base USING (sensor))"""
TRENDS = """series AS (SELECT *, count(*) OVER (PARTITION BY event_id, sensor) AS n FROM es), smooth AS (
      SELECT event_id, sensor, rn, n, CASE WHEN n > {k} THEN sum(mean_value) OVER (PARTITION BY event_id, sensor ORDER BY rn ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) / {k} ELSE mean_value END AS s FROM series
    ), fit AS (SELECT event_id, sensor, CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(s, rn) END AS slope, max(abs(s)) AS size, max(n) AS n FROM smooth GROUP BY ALL
    ), trends AS (SELECT event_id, sensor, slope, CASE WHEN n < 3 THEN 'stable' WHEN slope / CASE WHEN size = 0 THEN 1 ELSE size END * n > 0.02 THEN 'increasing'
        WHEN slope / CASE WHEN size = 0 THEN 1 ELSE size END * n < -0.02 THEN 'decreasing' ELSE 'stable' END AS trend FROM fit)"""
_FIRST: dict[str, str] = {}
for _group, _own in taxonomy.GROUPS.items():
    for _sensor in _own.split():
        _FIRST.setdefault(_sensor, _group)
NAMES = f"""dim(sensor, name, display_name, subsystem) AS (VALUES {_values((k, n, d, _FIRST.get(d, "unknown")) for k, (n, d) in enumerate(zip(default_names(), taxonomy.DISPLAY, strict=True)))}),
    named AS (SELECT b.sensor, coalesce(dim.name, 'S' || (b.sensor + 1)) AS name, coalesce(dim.display_name, 'S' || (b.sensor + 1)) AS display_name, coalesce(dim.subsystem, 'unknown') AS subsystem
      FROM (SELECT DISTINCT sensor FROM long) b LEFT JOIN dim USING (sensor))"""
EDGES = f"edges(src, dst) AS (VALUES {_values(tuple(x.split()) for x in taxonomy.COUPLINGS.splitlines())})"
FAULTS = f"faults(fault_id, subsystem, severity) AS (VALUES {_values((int(a), b, c) for a, b, c in (x.split() for x in taxonomy.FAULTS.splitlines()))})"
REPORT_PARTS = f"""WITH {ONSETS}, {DEVIATIONS}, {TRENDS.format(k=8, a=4, b=3)}, {NAMES}, votes AS (SELECT event_id, subsystem, count(*) AS matched FROM shares JOIN named USING (sensor) WHERE rank <= 5 GROUP BY ALL),
      best AS (SELECT event_id, arg_min(subsystem, (-matched, subsystem)) AS s, max(matched) AS matched FROM votes GROUP BY event_id),
      sums AS (SELECT event_id, max(score) AS max_score, max(score) / greatest(max(threshold), 1e-9) AS ratio FROM ev GROUP BY event_id),
      lines AS (SELECT event_id, rank, display_name, deviation, trend, contribution, printf('%s changed by %+.1f%% (trend %s, contribution %.2f)', display_name, deviation, trend, contribution) AS line
        FROM deviations JOIN trends USING (event_id, sensor) JOIN named USING (sensor) WHERE rank <= 5),
      steps AS (SELECT * FROM (SELECT event_id, display_name, row_number() OVER (PARTITION BY event_id ORDER BY onset, sensor) AS place, round((onset - min(onset) OVER (PARTITION BY event_id)) * (1 / 60.0)::DOUBLE, 2) AS relative_minutes
        FROM onsets JOIN named USING (sensor)) WHERE place <= 6)"""
KINDS = ("click", "error", "purchase", "signup", "view")
GRID = """hours AS (SELECT date_trunc('hour', ts) AS bucket, event_type, avg(value) AS value FROM events GROUP BY ALL),
    buckets AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS sample_index FROM (SELECT DISTINCT bucket FROM hours)),
    grid AS (SELECT sample_index, bucket, k.name, value FROM buckets CROSS JOIN (SELECT DISTINCT event_type AS name FROM events) k LEFT JOIN hours USING (bucket) WHERE FALSE)"""
GRID = GRID.replace("LEFT JOIN hours USING (bucket) WHERE FALSE", "LEFT JOIN hours h ON h.bucket = buckets.bucket AND h.event_type = k.name").replace("SELECT sample_index, bucket, k.name", "SELECT sample_index, buckets.bucket, k.name")
LABELLED = "lab AS (SELECT 1 - quality AS label, n_chars::DOUBLE AS score, (n_chars > 1500)::INT AS predicted FROM labels JOIN documents USING (doc_id))"
CONFUSION = """c AS (SELECT count(*) FILTER (WHERE predicted = 1 AND label = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND label = 0) AS fp,
      count(*) FILTER (WHERE predicted = 0 AND label = 0) AS tn, count(*) FILTER (WHERE predicted = 0 AND label = 1) AS fn FROM lab),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM c)
    SELECT tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1,
      round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / (tp + fn) END, 6) AS fnr FROM p"""
BLOCKED = """long AS (SELECT vec_id // 100 AS block, vec_id % 100 AS i, generate_subscripts(embedding, 1) - 1 AS sensor, unnest(embedding)::DOUBLE AS v FROM embeddings),
    base AS (SELECT sensor, avg(v) AS mean, stddev_pop(v) AS std FROM long GROUP BY sensor),
    samples AS (SELECT block, i, avg(pow((v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 2)) AS q FROM long JOIN base USING (sensor) GROUP BY ALL),
    scores AS (SELECT * FROM (SELECT block, i - 4 AS start_sample, i, avg(q) OVER (PARTITION BY block ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS score FROM samples) WHERE i >= 4),
    flags AS (SELECT *, score > (SELECT quantile_cont(score, 0.99) FROM scores) AS anomalous FROM scores),
    delays AS (SELECT 'run0:' || block AS run_id, 16 AS onset_index, min(start_sample) FILTER (WHERE anomalous AND start_sample >= 16) AS first_detected FROM flags GROUP BY block)"""
NORMAL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(list_distinct(string_split(" + NORMAL + ", ' ')), lambda x: x <> '')"
INSTRUCTIONS = f"""{FAULTS}, made AS (SELECT faults.*, CASE WHEN fault_id IN (3, 9) THEN 'val' WHEN fault_id IN (5, 12) THEN 'test' ELSE 'train' END AS split, k FROM faults JOIN (SELECT label, count(*) AS k FROM embeddings GROUP BY label) ON label = fault_id),
    numbered AS (SELECT *, unnest(range(1, CASE WHEN split = 'train' THEN k ELSE greatest(3, k // 2) END + 1)) AS n FROM made)"""


def _scaled(expression: str) -> str:
    return f"WITH {BASE} SELECT i AS sample_index, sensor::INT AS sensor, round({expression}, 6) AS scaled FROM long JOIN base USING (sensor)"


ORACLES = {
    "grid_pivot": f"WITH {GRID} SELECT sample_index, strftime(bucket, '%Y-%m-%d %H') AS bucket, {', '.join(f'round(max(value) FILTER (WHERE name = {chr(39)}{k}{chr(39)}), 6) AS {k}' for k in KINDS)} FROM grid GROUP BY ALL",
    "null_cells": f"WITH {GRID} SELECT name, count(*) - count(value) AS n_null, count(value) AS n_value FROM grid GROUP BY name",
    "null_drop": f"WITH {GRID}, whole AS (SELECT sample_index, row_number() OVER (ORDER BY sample_index) - 1 AS place FROM grid GROUP BY sample_index HAVING count(*) = count(value)) SELECT place AS sample_index, name, round(value, 6) AS value FROM grid JOIN whole USING (sample_index)",
    "null_ffill": f"""WITH {GRID} SELECT sample_index, name, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(value IGNORE NULLS) OVER (PARTITION BY name ORDER BY sample_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM grid""",
    "null_interpolate": f"""WITH {GRID}, known AS (SELECT name, sample_index AS i, value FROM grid WHERE value IS NOT NULL),
      near AS (SELECT g.*, a.i AS ai, a.value AS av FROM grid g ASOF LEFT JOIN known a ON g.name = a.name AND g.sample_index >= a.i),
      both_sides AS (SELECT n.*, b.i AS bi, b.value AS bv FROM near n ASOF LEFT JOIN known b ON n.name = b.name AND n.sample_index <= b.i)
      SELECT sample_index, name, round(CASE WHEN value IS NOT NULL THEN value WHEN ai IS NULL THEN bv WHEN bi IS NULL THEN av ELSE av + (bv - av) * ((sample_index - ai) / (bi - ai)) END, 6) AS value FROM both_sides""",
    "file_labels": """WITH s AS (SELECT doc_id, printf('fault_%02d', doc_id % 22) || CASE WHEN doc_id % 3 = 0 THEN '_run2' ELSE '' END AS stem FROM documents)
      SELECT doc_id, nullif(regexp_replace(stem, '[^0-9]', '', 'g'), '')::INT AS fault_id, nullif(regexp_extract(stem, 'fault[_-]?([0-9]+)', 1), '')::INT AS fault_label FROM s""",
    "fault_splice": """SELECT e.vec_id AS sample_index, CASE WHEN e.vec_id >= 200 THEN 4 ELSE e.label END AS fault_label, round(CASE WHEN e.vec_id >= 200 THEN f.embedding[1]::DOUBLE + 10 ELSE e.embedding[1]::DOUBLE END, 6) AS first
      FROM embeddings e LEFT JOIN embeddings f ON e.vec_id >= 200 AND f.vec_id = (e.vec_id - 200) % (SELECT count(*) FROM embeddings)""",
    "baseline_stats": f"WITH {BASE} SELECT sensor::INT AS sensor, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(high, 6) AS high FROM base",
    "scale_standard": _scaled("(v - mean) / CASE WHEN std = 0 THEN 1 ELSE std END"),
    "scale_minmax": _scaled("(v - low) / CASE WHEN high = low THEN 1 ELSE high - low END"),
    "zscore_eps": _scaled("(v - mean) / (std + 1e-6)"),
    "percent_deviation": _scaled("CASE WHEN abs(mean) > 1e-6 THEN (v - mean) / mean * 100 ELSE (v - mean) / (std + 1e-6) * 100 END"),
    "scale_inverse": f"WITH {LONG} SELECT i AS sample_index, sensor::INT AS sensor, round(v, 6) AS value FROM long",
    "sliding_windows": "SELECT (s // 5)::BIGINT AS window_id, s AS start_sample, s + 59 AS end_sample FROM (SELECT unnest(range(0, max(vec_id) + 2 - 60, 5)) AS s FROM embeddings)",
    "sliding_windows_stride_phase": "SELECT row_number() OVER (ORDER BY e) - 1 AS window_id, e - 60 AS start_sample, e - 1 AS end_sample FROM (SELECT unnest(range(63, max(vec_id) + 2, 7)) AS e FROM embeddings)",
    "window_samples": "WITH w AS (SELECT unnest(range(0, max(vec_id) + 2 - 60, 5)) AS s FROM embeddings) SELECT (s // 5)::BIGINT AS window_id, vec_id - s AS pos, vec_id AS sample_index FROM w JOIN embeddings ON vec_id >= s AND vec_id < s + 60",
    "block_windows": "WITH b AS (SELECT vec_id // 250 AS b, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT b, unnest(range(0, n - 59, 5)) AS s FROM b) SELECT 'run0:' || b AS block, (s // 5)::BIGINT AS window_id, s AS start_sample, s + 59 AS end_sample FROM s",
    "segment_split": """WITH b AS (SELECT vec_id // 100 AS b, (count(*) - 60) // 5 + 1 AS n FROM embeddings GROUP BY 1), c AS (SELECT count(*) AS k, max(n) AS n, round_even(count(*) * 0.2, 0)::BIGINT AS t, round_even(count(*) * 0.15, 0)::BIGINT AS v FROM b)
      SELECT s.split, s.k AS n_segments, s.k * n AS n_windows FROM c, LATERAL (VALUES ('test', t), ('val', v), ('train', k - t - v)) s(split, k) WHERE s.k > 0""",
    "window_errors": f"WITH {TERMS}, {_errors(60, 5)} SELECT window_id, start_sample, sensor::INT AS sensor, round(error, 6) AS error, round(mean_value, 6) AS mean_value FROM errors",
    "window_scores": f"WITH {SCORES} SELECT window_id, start_sample, end_sample, round(score, 6) AS score FROM scores",
    "window_scores_bucketed": f"WITH {SCORES} SELECT window_id, start_sample, end_sample, round(score, 6) AS score FROM scores",
    "threshold_percentile": f"WITH {SCORES} SELECT round(quantile_cont(score, 0.99), 6) AS threshold, 'percentile' AS method, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(max(score), 6) AS max_score FROM scores",
    "threshold_mean_std": f"WITH {SCORES} SELECT round(avg(score) + 3 * stddev_pop(score), 6) AS threshold, 'mean_std' AS method, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(max(score), 6) AS max_score FROM scores",
    "score_summary": f"WITH {SCORES} SELECT count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(max(score), 6) AS max_score, round(quantile_cont(score, 0.99), 6) AS p99 FROM scores",
    "threshold_validation": f"WITH {SCORES} SELECT round(quantile_cont(score, 0.95), 6) AS threshold, 'validation_percentile' AS method, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(max(score), 6) AS max_score FROM scores",
    "artifact_scores": f"WITH {SCORES}, t AS (SELECT quantile_cont(score, 0.99) AS threshold FROM scores) SELECT window_id, round(score, 6) AS score, round(threshold, 6) AS threshold, score > threshold AS anomalous FROM scores, t",
    "csv_matrix": "SELECT vec_id AS sample_index, len(embedding)::INT AS n_values, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings",
    "csv_repaired": """WITH grid AS (SELECT vec_id AS sample_index, s - 1 AS sensor, CASE WHEN (vec_id + s - 1) % 11 > 2 THEN embedding[s]::DOUBLE END AS value FROM embeddings, range(1, 6) r(s)),
      known AS (SELECT sensor, sample_index AS i, value FROM grid WHERE value IS NOT NULL),
      near AS (SELECT g.*, a.i AS ai, a.value AS av FROM grid g ASOF LEFT JOIN known a ON g.sensor = a.sensor AND g.sample_index >= a.i),
      both_sides AS (SELECT n.*, b.i AS bi, b.value AS bv FROM near n ASOF LEFT JOIN known b ON n.sensor = b.sensor AND n.sample_index <= b.i)
      SELECT sample_index, sensor::INT AS sensor, round(CASE WHEN value IS NOT NULL THEN value WHEN ai IS NULL THEN bv WHEN bi IS NULL THEN av ELSE av + (bv - av) * ((sample_index - ai) / (bi - ai)) END, 6) AS value FROM both_sides""",
    "csv_faults": "SELECT printf('fault_%02d.csv', label) AS run_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_index, label AS fault_label, 20 + label AS onset_index, vec_id FROM embeddings WHERE label IS NOT NULL",
    "records_round_trip": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
    "event_labels": f"WITH {SUMMARY} SELECT event_id, n_windows, label AS fault_label FROM summary JOIN embeddings ON vec_id = last_sample",
    "store_replaced": f"WITH {SUMMARY} SELECT event_id, last_sample, n_windows, CASE WHEN n_windows >= 4 THEN 'second' ELSE 'first' END AS report, (SELECT count(*) + 1 FROM summary) AS next_number FROM summary",
    "anomaly_flags": f"WITH {FLAGS} SELECT window_id, round(score, 6) AS score, anomalous FROM flags",
    "daily_scores": f"""WITH days AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, [q, p, c, t] AS x FROM (
        SELECT l_shipdate::DATE AS d, sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(l_discount) AS c, sum(l_tax) AS t FROM lineitem GROUP BY 1)),
      {_scores(30, 10, TERMS.replace(LONG, "long AS (SELECT i, generate_subscripts(x, 1) - 1 AS sensor, unnest(x)::DOUBLE AS v FROM days)"))}
      SELECT window_id, start_sample, round(score, 5) AS score FROM scores""",
    "confirmed_runs": f"WITH {FLAGS} SELECT window_id, anomalous, sum(anomalous::INT) OVER (ORDER BY window_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS confirmed FROM flags",
    "event_capped": f"""WITH RECURSIVE {FLAGS}, step AS (
        SELECT -1::BIGINT AS window_id, 0 AS recent, 0 AS held, 0 AS gap, 0 AS event_number, 0 AS rn, false AS closed
        UNION ALL SELECT f.window_id, CASE WHEN f.anomalous THEN recent + 1 ELSE 0 END,
          CASE WHEN held = 0 THEN (f.anomalous AND recent >= 2)::INT WHEN f.anomalous THEN CASE WHEN held = 3 THEN 0 ELSE held + 1 END WHEN gap = 4 THEN 0 ELSE held END,
          CASE WHEN f.anomalous OR held = 0 THEN 0 ELSE gap + 1 END,
          CASE WHEN held = 0 AND f.anomalous AND recent >= 2 THEN event_number + 1 ELSE event_number END,
          CASE WHEN NOT f.anomalous THEN 0 WHEN held > 0 THEN held + 1 ELSE (recent >= 2)::INT END,
          held > 0 AND CASE WHEN f.anomalous THEN held = 3 ELSE gap = 4 END
        FROM step JOIN flags f ON f.window_id = step.window_id + 1)
      SELECT event_number, window_id, rn FROM step WHERE rn > 0 AND event_number IN (SELECT event_number FROM step WHERE closed)""",
    "record_results": f"""WITH {TERMS}, q AS (SELECT i, avg(q) AS q FROM terms GROUP BY i), w AS (SELECT i, avg(q) OVER (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS score FROM q)
      SELECT i AS sample_index, CASE WHEN i >= 59 THEN i - 59 END AS window_id, CASE WHEN i >= 59 AND (i + 1) % 7 = 0 THEN round(score, 6) END AS score, i >= 59 AND (i + 1) % 7 = 0 AND score > 1.0 AS anomalous FROM w""",
    "replay_windows": "SELECT (e // 15)::BIGINT AS window_id, e - 10 AS start_sample, e - 1 AS end_sample FROM (SELECT unnest(range(10, max(vec_id) + 2, 10)) AS e FROM embeddings)",
    "event_islands": f"WITH {EVENTS} SELECT event_number::INT AS event_number, rn::INT AS rn, window_id, round(score, 6) AS score FROM ev",
    "event_summary": f"WITH {SUMMARY} SELECT event_id, start_sample, last_sample, n_windows, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score, {SEVERITY} AS severity FROM summary",
    "stream_events": f"WITH {SUMMARY} SELECT start_sample, last_sample, n_windows::INT AS n_windows, round(max_score, 6) AS max_score, round(mean_score, 6) AS mean_score FROM summary",
    "top_k_sensors": f"WITH {SENSORS} SELECT event_id, rank::INT AS rank, sensor::INT AS sensor, round(worst, 6) AS error, round(contribution, 6) AS contribution FROM shares WHERE rank <= 5",
    "sensor_contribution": f"WITH {SENSORS} SELECT event_id, sensor::INT AS sensor, round(mean_error, 6) AS mean_error, round(mean_error / sum(mean_error) OVER (PARTITION BY event_id), 6) AS contribution FROM worst",
    "event_deviation": f"WITH {SENSORS}, {DEVIATIONS} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY abs(deviation) DESC, sensor)::INT AS place, sensor::INT AS sensor, round(event_mean, 6) AS current_value, round(z, 6) AS z_score, round(deviation, 3) AS deviation_percent FROM deviations WHERE abs(deviation) >= 500 OR rank <= 5",
    "sensor_trend": f"WITH {SENSORS}, {TRENDS.format(k=4, a=2, b=1)} SELECT event_id, sensor::INT AS sensor, round(slope, 6) AS slope, trend FROM trends",
    "sensor_onsets": f"WITH {ONSETS} SELECT o.event_id, o.sensor::INT AS sensor, o.onset::INT AS onset, round(avg(e.error), 6) AS mean_after FROM onsets o JOIN es e ON e.event_id = o.event_id AND e.sensor = o.sensor AND e.rn >= o.onset GROUP BY ALL",
    "temporal_sequence": f"""WITH {ONSETS}, placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY onset, sensor) AS place, round((onset - min(onset) OVER (PARTITION BY event_id)) * (1 / 60.0)::DOUBLE, 2) AS relative_minutes FROM onsets)
      SELECT event_id, place::INT AS place, sensor::INT AS sensor, onset::INT AS onset, relative_minutes FROM placed WHERE place <= 6""",
    "pre_post_context": f"WITH {SENSORS} SELECT event_id, sensor::INT AS sensor, round(avg(mean_value) FILTER (WHERE rn <= 3), 6) AS pre_mean, round(avg(mean_value), 6) AS post_mean, round(avg(mean_value) - avg(mean_value) FILTER (WHERE rn <= 3), 6) AS delta FROM es GROUP BY ALL",
    "candidate_subsystem": f"""WITH {SENSORS}, {NAMES}, votes AS (SELECT event_id, subsystem, count(*) AS matched FROM shares JOIN named USING (sensor) WHERE rank <= 5 GROUP BY ALL)
      SELECT event_id, rank::INT AS rank, subsystem, matched FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY matched DESC, subsystem) AS rank FROM votes) WHERE rank <= 3""",
    "sensor_names": f"WITH {LONG}, {NAMES} SELECT sensor::INT AS sensor, name, display_name, subsystem FROM named",
    "downstream_effects": f"WITH {LONG}, {NAMES}, {EDGES} SELECT sensor::INT AS sensor, display_name, dst AS effect, 1 AS hop FROM named JOIN edges ON src = display_name",
    "downstream_reach": f"""WITH RECURSIVE {LONG}, {NAMES}, {EDGES}, reach AS (SELECT src, dst, 1 AS hop FROM edges UNION SELECT reach.src, edges.dst, hop + 1 FROM reach JOIN edges ON edges.src = reach.dst WHERE hop < 20)
      SELECT sensor::INT AS sensor, display_name, dst AS effect, min(hop)::INT AS hop FROM named JOIN reach ON src = display_name GROUP BY ALL""",
    "customer_reach": """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
      s AS (SELECT min(c_custkey) AS src FROM customer GROUP BY c_nationkey),
      reach AS (SELECT src, dst AS node, 1 AS hop FROM s JOIN e USING (src) UNION SELECT reach.src, e.dst, hop + 1 FROM reach JOIN e ON e.src = reach.node WHERE hop < 12)
      SELECT src, node, min(hop)::INT AS hop FROM reach GROUP BY ALL""",
    "window_splits": """WITH b AS (SELECT vec_id // 100 AS b, (count(*) - 60) // 5 + 1 AS n FROM embeddings GROUP BY 1), c AS (SELECT count(*) AS k, max(n) AS n, round_even(count(*) * 0.2, 0)::BIGINT AS t, round_even(count(*) * 0.15, 0)::BIGINT AS v FROM b)
      SELECT s.split, s.k * n AS n_windows, 60 AS size, (SELECT max(len(embedding)) FROM embeddings)::INT AS n_features FROM c, LATERAL (VALUES ('test', t), ('val', v), ('train', k - t - v)) s(split, k) WHERE s.k > 0""",
    "downstream_two_hops": f"""WITH {LONG}, {NAMES}, {EDGES}, one AS (SELECT sensor, display_name, dst AS effect, 1 AS hop FROM named JOIN edges ON src = display_name),
      two AS (SELECT * FROM one UNION ALL SELECT sensor, display_name, dst, 2 FROM one JOIN edges ON src = effect)
      SELECT sensor::INT AS sensor, display_name, effect, min(hop)::INT AS hop FROM two GROUP BY ALL""",
    "evidence_documents": f"""WITH {ONSETS.replace("es AS", "es AS", 1)}, {NAMES}, votes AS (SELECT event_id, subsystem, count(*) AS matched FROM shares JOIN named USING (sensor) WHERE rank <= 5 GROUP BY ALL),
      best AS (SELECT event_id, arg_min(subsystem, (-matched, subsystem)) AS subsystem, max(matched) AS matched FROM votes GROUP BY event_id),
      sums AS (SELECT event_id, min(start_sample) AS start_sample, count(*) AS n_windows, max(score) AS max_score, max(score) / greatest(max(threshold), 1e-9) AS ratio FROM ev GROUP BY event_id),
      n AS (SELECT event_id, least(count(*), 6) AS k FROM onsets GROUP BY event_id)
      SELECT event_id, start_sample, start_sample + n_windows AS end_sample, n_windows, {SEVERITY} AS severity, subsystem AS candidate_subsystem, round(matched / 5, 6) AS candidate_score, 5 AS n_sensors, coalesce(k, 0)::INT AS n_onsets, round(max_score, 6) AS anomaly_score
      FROM sums JOIN best USING (event_id) LEFT JOIN n USING (event_id)""",
    "fallback_report": f"""{REPORT_PARTS} SELECT event_id, printf('Anomaly of score %.2f; candidate subsystem ''%s''.', max_score, s) AS summary, 'candidate: ' || s AS root_cause, s AS affected_subsystem, lines AS evidence,
        'Order in time (no proof of a cause): ' || coalesce(steps, '') || ' Deviations are relative to the baseline of normal operation. Onset order is evidence in time, no proof of a cause. Subsystem ' || chr(39) || s || chr(39) || ' is a candidate from the deviating sensors; verify it.' AS reasoning,
        {SEVERITY} AS severity, round(matched / 5, 2) AS confidence, 'Inspect the parts of ' || s || ' and check the suspect sensors on site.' AS recommended_action,
        'Deviations and the candidate go together in time; a check on site has to confirm the cause.' AS uncertainty
      FROM sums JOIN best USING (event_id) JOIN (SELECT event_id, string_agg(line, ' | ' ORDER BY rank) AS lines FROM lines WHERE rank <= 3 GROUP BY event_id) USING (event_id)
      LEFT JOIN (SELECT event_id, string_agg(printf('%s at %.1f min', display_name, relative_minutes), '; ' ORDER BY place) AS steps FROM steps WHERE place <= 3 GROUP BY event_id) USING (event_id)""",
    "evidence_prompt": f"""{REPORT_PARTS} SELECT event_id, concat_ws(chr(10), 'Event: ' || event_id, printf('Score: %.3f', max_score), 'Sensors:', sensors, 'Onsets:', coalesce(onsets, '(no clear order)'),
        'Candidate subsystem: ' || s, 'Before the event: normal for about 0.33 min',
        'What is the likely root cause? Answer with the keys summary, root_cause, affected_subsystem, evidence, reasoning, severity, confidence, recommended_action, uncertainty.') AS prompt
      FROM sums JOIN best USING (event_id)
      JOIN (SELECT event_id, string_agg(printf('- %s: %+.1f%% (trend: %s, contribution: %.2f)', display_name, deviation, trend, contribution), chr(10) ORDER BY rank) AS sensors FROM lines GROUP BY event_id) USING (event_id)
      LEFT JOIN (SELECT event_id, string_agg(printf('%d. %s, %.1f min after the first onset', place, display_name, relative_minutes), chr(10) ORDER BY place) AS onsets FROM steps GROUP BY event_id) USING (event_id)""",
    "followup_answers": f"""WITH {SENSORS}, {NAMES}, votes AS (SELECT event_id, subsystem, count(*) AS matched FROM shares JOIN named USING (sensor) WHERE rank <= 5 GROUP BY ALL),
      best AS (SELECT event_id, arg_min(subsystem, (-matched, subsystem)) AS s FROM votes GROUP BY event_id), asked(event_id, question) AS (VALUES ('ANOM-0001', 'Why?'), ('ANOM-0002', 'What now?'), ('ANOM-9999', 'Who?'))
      SELECT event_id, question, CASE WHEN s IS NOT NULL THEN printf('Event %s has 5 deviating sensors; the candidate subsystem is ''%s''.', event_id, s) END AS answer FROM asked LEFT JOIN best USING (event_id)""",
    "conversation_history": "SELECT conv_id, count(*) AS n_messages, string_agg(concat_ws(':', role, text), '|' ORDER BY turn) AS history FROM conversations GROUP BY conv_id",
    "chat_prompt": "SELECT conv_id, '<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || string_agg('<|im_start|>' || role || chr(10) || CASE WHEN coalesce(text, '') <> '' THEN text || '<|im_end|>' ELSE '' END, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id",
    "followup_messages": "SELECT printf('ANOM-%04d', conv_id) AS event_id, turn * 2 + k AS turn, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE k WHEN 0 THEN text ELSE 'about user' END AS content FROM conversations, (VALUES (0), (1)) v(k) WHERE role = 'user'",
    "events_recent": f"WITH {SUMMARY} SELECT event_id, last_sample, n_windows FROM summary ORDER BY last_sample DESC, event_id DESC LIMIT 5",
    "event_with_followups": f"""WITH {SUMMARY}, f AS (SELECT printf('ANOM-%04d', conv_id % 12) AS event_id, conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'user')
      SELECT event_id, count(id)::INT AS n_followups, sha256(coalesce(string_agg(text, '|' ORDER BY id), '')) AS questions_sha256 FROM summary LEFT JOIN f USING (event_id) GROUP BY event_id""",
    "report_latest": "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "store_status": f"WITH {SUMMARY} SELECT count(*) AS n_events, max(event_id) AS last_event FROM summary",
    "confusion_metrics": f"WITH {LABELLED}, {CONFUSION}",
    "window_labels": f"WITH {BLOCKED}, lab AS (SELECT (start_sample >= 16)::INT AS label, anomalous::INT AS predicted FROM flags), {CONFUSION}",
    "auroc": f"WITH {LABELLED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM lab) SELECT round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auroc FROM r",
    "auprc": f"WITH {LABELLED}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM lab GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / k) / sum(p), 6) AS auprc FROM c",
    "detection_delay": f"WITH {BLOCKED} SELECT *, first_detected - onset_index AS delay FROM delays",
    "delay_summary": f"WITH {BLOCKED} SELECT round(avg(first_detected - onset_index), 6) AS mean_delay, count(*) - count(first_detected) AS missed FROM delays",
    "text_normalize": f"SELECT doc_id, sha256({NORMAL.format('text')}) AS normalized_sha256 FROM documents",
    "token_overlap": f"SELECT d.doc_id, len({WORDS.format('b.text')}) > 0 AND len(list_intersect({WORDS.format('d.text')}, {WORDS.format('b.text')})) >= greatest(1, least(3, len({WORDS.format('b.text')}))) AS overlaps FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark) b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.k",
    "hedge_overclaim": f"""WITH h AS (SELECT doc_id, text, {' OR '.join(f"contains(lower(text), '{x}')" for x in text_eval.HEDGES)} AS hedged FROM documents)
      SELECT doc_id, hedged, NOT hedged AND (regexp_matches(text, '(?i)\\b(caused|proves?|definitely|certainly|guaranteed)\\b') OR regexp_matches(text, '(?i)\\b(root cause is\\b.*!|must be\\b)')) AS overclaiming FROM h""",
    "foreign_tokens": f"""WITH t AS (SELECT conv_id, turn, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z_]+'), lambda x: {NORMAL.format('x')})),
        lambda x: NOT list_contains([{', '.join(f"'{w}'" for w in dict.fromkeys(text_eval.ALLOWED))}], x))) AS f FROM conversations) SELECT conv_id, turn, len(f)::INT AS n_foreign, array_to_string(f, ' ') AS foreign_tokens FROM t""",
    "json_extract": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "sanitize_answer": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS summary, round(CASE WHEN value / 50 BETWEEN 0 AND 1 THEN value / 50 ELSE 0 END, 6) AS confidence, CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'unknown' END AS severity FROM events""",
    "answer_metrics": f"""WITH {INSTRUCTIONS} SELECT count(*) AS n_samples, round(avg((n % 4 <> 0 AND n % 7 <> 0)::INT), 6) AS root_cause_accuracy, round(avg((n % 4 <> 0)::INT), 6) AS fault_classification_accuracy,
        0.0::DOUBLE AS evidence_consistency, round(avg((n % 4 <> 0)::INT), 6) AS hallucination_rate, -- an answer's own key root_cause is foreign
        round(avg((n % 4 <> 0 AND (n % 3 <> 0 OR severity = 'low'))::INT), 6) AS severity_accuracy, round(avg((n % 4 <> 0 AND n % 2 = 0)::INT), 6) AS hedged_reasoning_rate,
        round(avg((n % 4 <> 0 AND n % 5 <> 0)::INT), 6) AS recommendation_rate, round(avg((n % 4 <> 0)::INT), 6) AS json_validity_rate, round(avg((n % 4 <> 0 AND n % 2 = 1)::INT), 6) AS overclaiming_rate FROM numbered""",
    "instruction_counts": f"WITH {INSTRUCTIONS} SELECT split, kind, count(*) AS n_samples FROM numbered, (VALUES ('report'), ('followup'), ('followup'), ('followup'), ('followup')) k(kind) GROUP BY ALL",
    "followup_explode": f"WITH {INSTRUCTIONS} SELECT fault_id, any_value(split) AS split, 4 * count(*) AS n, 4 AS n_questions FROM numbered GROUP BY fault_id",
    "fault_kb_lookup": f"WITH {FAULTS} SELECT label AS fault_id, count(*) AS n, any_value(subsystem) AS subsystem, any_value(severity) AS severity FROM embeddings JOIN faults ON fault_id = label GROUP BY label",
    "hop_window_avg": """WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts) + to_minutes(30 * (minute(ts) // 30)), date_trunc('hour', ts) + to_minutes(30 * (minute(ts) // 30) - 30)]) AS start FROM events)
      SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY ALL""",
    "session_windows": """WITH s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, TRUE) AS fresh FROM events),
      g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, k""",
}


ORACLES["stream_reports"] = ORACLES["fallback_report"]
ORACLES["sql_event_summary"] = ORACLES["event_summary"]
ORACLES["sql_window_samples"] = ORACLES["window_samples"]
ORACLES["csv_stream_events"] = ORACLES["stream_events"]
