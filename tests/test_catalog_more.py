"""Queries over tables that are folders of files, and of other lengths than the given ones."""

import numpy as np
import pytest

from tests.test_catalog import plain
from tidegauge.plans import catalog

BATCH = {"stream_events": "event_summary", "stream_reports": "fallback_report"}


def embeddings(spark, folder, x, files=3):
    rows = [(k, v.astype("float32").tolist(), k % 10) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(files).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(BATCH))
def test_streams_read_a_table_of_several_files(spark, tmp_path, name):
    x = np.random.default_rng(3).normal(size=(300, 8))
    x[100:110] += 9
    x[200:212] -= 7
    d = embeddings(spark, tmp_path, x)
    got = catalog.queries()[name](spark, d).toPandas()
    want = catalog.queries()[BATCH[name]](spark, d).toPandas()
    assert len(want) >= 2 and plain(got) == plain(want[got.columns])


@pytest.mark.parametrize("name", sorted(BATCH))
def test_streams_without_events_are_empty(spark, tmp_path, name):
    d = embeddings(spark, tmp_path, np.ones((40, 8)))
    got, want = (catalog.queries()[k](spark, d) for k in (name, BATCH[name]))
    assert got.count() == want.count() == 0 and set(got.columns) <= set(want.columns)


def test_segments_too_short_for_a_window_count(spark, tmp_path):
    d = embeddings(spark, tmp_path, np.zeros((456, 2)))  # four blocks of 100 and one of 56
    got = catalog.queries()["segment_split"](spark, d).toPandas()
    assert got["n_segments"].sum() == 5 and got["n_windows"].sum() == 4 * 9
