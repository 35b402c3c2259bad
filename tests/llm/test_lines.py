"""Line dedup against counting in plain Python."""

import hashlib
from collections import Counter

import pytest

from tidegauge.llm import lines


def brute(texts, least):
    seen = Counter()
    for t in texts.values():
        seen.update({lines.key_of(x) for x in (t or "").encode().split(b"\n")} - {b""})
    hot = {k for k, n in seen.items() if n >= least}
    out = {}
    for k, t in texts.items():
        own = (t or "").encode().split(b"\n")
        kept = [x for x in own if lines.key_of(x) not in hot]
        out[k] = (len(own), len(own) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


def test_digests(documents, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.digests(documents, 10).collect()}
    assert got == brute(texts, 10) and sum(x[1] for x in got.values()) > 20


@pytest.mark.parametrize("keep_first", [False, True])
def test_large_filter_path_is_the_same(documents, keep_first):
    small, large = (lines.dedup(documents, 3, keep_first, file_bytes=b).select("doc_id", "n_lines", "n_dropped", "kept_text") for b in (lines.FILE_BYTES, 50))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    for out in (small, large):  # texts stay where they are
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1  # the fixture's own


def test_lost_lines_are_held_against_the_lines_themselves(spark, tmp_path, monkeypatch):
    """Where hashes of lines are equal, the lines decide."""
    import numpy as np

    rows = [(f"line {k}".encode(), None if k % 7 == 0 else k, k % 5) for k in range(300)]
    hot = spark.createDataFrame(rows, "key binary, first_doc long, first_line long").repartition(3)
    folder = f"file://{tmp_path}/lost"
    files = lines.write_lost(hot, folder, 2_000)
    keys = [r[0] for r in rows] + [b"other", b"line 300"]
    assert files > 3 and lines.lost(keys, folder, files) == {r[0]: (r[1], r[2]) for r in rows}
    flat = np.fromfile(f"{tmp_path}/lost/lost-000000.bin", np.uint8)
    n = int(flat[:8].view(np.int64)[0])
    flat[8 : 8 + 8 * n].view(np.int64)[:] = 5  # all hashes of a file alike
    flat.tofile(f"{tmp_path}/lost/lost-000000.bin")
    monkeypatch.setattr(lines, "_hash", lambda keys: np.full(len(keys), 5, np.uint64))
    found = lines.lost([*keys, b"no"], folder, files)
    assert len(found) == n and all(found[r[0]] == (r[1], r[2]) for r in rows if r[0] in found)


def test_only_suspects_are_shuffled(spark):
    """Of 4,000 lines, 3 occur twice: the filter leaves hardly any others."""
    rows = [(k, "\n".join(f"line {k} {n}" for n in range(100)) + ("\nagain a\nagain b\nagain c" if k in (3, 30) else "")) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keys = [bytes(r["key"]) for r in lines.found(frame).collect()]
    assert sorted(k for k in keys if k.startswith(b"again")) == [b"again a"] * 2 + [b"again b"] * 2 + [b"again c"] * 2 and len(keys) < 400
    for most in (lines.FILE_BYTES, 1):
        assert lines.dedup(frame, 2, file_bytes=most).agg({"n_dropped": "sum"}).first()[0] == 6


def test_columns_with_the_names_of_intermediates(spark):
    rows = spark.createDataFrame([(1, "x\ny", 1, [2], "a", "b"), (2, "x\nz", 1, [2], "a", "b"), (None, None, 0, None, "", "")], "doc_id long, text string, __id int, __keys array<int>, row string, lost string")
    for most in (lines.FILE_BYTES, 1):
        out = lines.dedup(rows, 2, file_bytes=most)
        assert sorted(r["kept_text"] for r in out.collect()) == ["", "y", "z"] and out.columns[:6] == rows.columns


def test_first_occurrence_stays(spark):
    rows = spark.createDataFrame([(2, "x\na"), (1, "b\nX "), (3, " x\nx")], "doc_id long, text string")
    for most in (lines.FILE_BYTES, 1):
        got = {r["doc_id"]: r["kept_text"] for r in lines.dedup(rows, 2, keep_first=True, file_bytes=most).collect()}
        assert got == {1: "b\nX ", 2: "a", 3: ""}


def test_columns_pass_through_and_empty(documents, empty):
    out = lines.dedup(documents, 10)
    assert {"lang", "source", "component_id"} <= set(out.columns) and len(out.columns) == len(set(out.columns))
    assert lines.dedup(empty, 10).count() == 0


def test_rows_sharing_an_id_count_once(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "x")], "doc_id long, text string")
    assert lines.repeated(lines.found(rows), 3).count() == 0 and lines.repeated(lines.found(rows), 2).first()["n_docs"] == 2
