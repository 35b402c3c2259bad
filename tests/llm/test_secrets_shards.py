"""Secret scan and sharded tables."""

import hashlib
import random
import re
import time

import pytest

from tidegauge.llm import secret_scan, sharding

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEY = "A" * 3 + "bC9/" * 9 + "z"


def base(text):
    t = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


TEXTS = {
    0: None,
    1: "",
    2: "é\U0001f600 password = \"abcdefgh12\" and Api_Key:'short' token=token: abcdefghij SECRET=xyz12345",
    3: "AKIA" + "Q" * 16 + " then " + KEY + " at https://db.example.com/x",
    4: KEY + " alone, and mail me@example.com",
    5: "AKIA" + "Q" * 16 + " " + "x " * 300 + KEY,
    6: "f" * 40 + " owner me@example.com host 10.1.2.3",
    7: "password=AKIA" + "7" * 20 + "0123456789abcdef" * 3,
    8: "10.1.2.3 and https://x.example.org",
    9: ("token = " + "0123456789abcdef" * 2 + "\n") * 400,
}


def test_scan(spark):
    rows = spark.createDataFrame([(k, t, "kind", 3) for k, t in TEXTS.items()] + [(3, TEXTS[3], "kind", 3)], "doc_id long, text string, spans string, row int")
    got = secret_scan.digests(rows).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in got}
    for k, t in TEXTS.items():
        own, r = base(t), by[k]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(n) for x in own) for n in ("assign", "access", "hex")]
        assert set(own) <= set(r["spans"].split(",") if r["spans"] else [])
    kinds = lambda k: [x.split(":")[0] for x in by[k]["spans"].split(",") if x]
    assert kinds(3) == ["access", "token", "endpoint"]  # all three parts meet
    assert kinds(4) == ["token", "account"]  # an account and a secret
    assert kinds(5) == ["access"]  # the token is out of scope
    assert kinds(6) == ["hex", "account", "endpoint"]
    assert kinds(8) == [] and by[9]["n_assign"] == 400


PATTERNS = [re.compile(x[2]) for x in secret_scan.KINDS]


def linked(text):
    """All spans with weak candidates linked, from the definition: every pair of parts is looked at."""
    t = text or ""
    parts = []
    for k, (kind, role, _, group, least) in enumerate(secret_scan.KINDS):
        parts += [(m.start(), k, m.end(), kind, role) for m in PATTERNS[k].finditer(t) if len(m[group]) >= least]
    base = [p for p in parts if p[1] < secret_scan.BASE]
    fit = [p for p in parts if p in base or not any(p[0] < b[2] and b[0] < p[2] for b in base)]
    out = []
    for p in fit:
        near = {q[4] for q in fit if q is not p and max(p[0] - q[2], q[0] - p[2]) <= secret_scan.SCOPE}
        needs = {"token": {"identifier"}, "account": {"secret"}, "endpoint": {"identifier", "secret"}}.get(p[3], set())
        if needs <= near:
            out.append(p)
    return [f"{p[3]}:{p[0]}:{p[2]}" for p in sorted(out)]


def test_linked_spans_against_plain_python(spark):
    rng = random.Random(9)
    pieces = ["me@example.com", KEY, "AKIA" + "Q" * 16, "https://a.example.org/x", "10.1.2.3", "deadbeef" * 5, "token=abcdefgh12", "pw: x", "AKIAQ", "é" * 3]
    texts = {k: " ".join(rng.choice(pieces) if rng.random() < 0.4 else "w" * rng.randint(1, 90) for _ in range(rng.randint(0, 40))) for k in range(150)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.digests(rows).collect()}
    assert got == {k: ",".join(linked(t)) for k, t in texts.items()}


def test_one_text_of_many_parts_takes_seconds(spark):
    n = 50_000
    text = " ".join(f"u{k}@example.com" for k in range(n)) + " password=abcdefgh12"
    started = time.monotonic()
    row = secret_scan.digests(spark.createDataFrame([(1, text), (2, "AKIA" + "7" * 16)], "doc_id long, text string")).where("doc_id = 1").first()
    assert time.monotonic() - started < 60
    reported = [x for x in row["spans"].split(",") if x.startswith("account")]
    assert row["n_assign"] == 1 and row["n_linked"] == len(reported) == sum(text.index(" password") - e <= 200 for e in (int(x.split(":")[2]) for x in reported)) > 5


def test_scan_uses_no_python(spark):
    plan = secret_scan.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and secret_scan.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def content(df):
    return sorted(map(str, df.collect()))


def test_compaction_keeps_rows_and_merges(spark, documents):
    table = sharding.ShardedTable(spark, target_bytes=20_000, arrival_bytes=3_000)
    table.append(documents)
    first = table.manifest().count()
    assert content(table.read(documents.schema)) == content(documents)
    while table.compact(documents.schema):
        pass
    assert table.manifest().count() < first and content(table.read(documents.schema)) == content(documents)
    assert content(table.read(documents.schema, 1)) == content(documents)  # an older version is whole too
    table.append(documents.limit(7))
    table.compact(documents.schema)
    table.vacuum()
    assert table.read(documents.schema).count() == documents.count() + 7 == table.manifest().agg({"n_docs": "sum"}).first()[0]
    assert table.versions() == sorted(table.versions()) and table.manifest().agg({"n_bytes": "max"}).first()[0] < 10**7


def test_of_two_interleaved_writers_one_fails(spark, documents):
    one = sharding.ShardedTable(spark, arrival_bytes=3_000)
    one.append(documents.limit(3))
    two = sharding.ShardedTable(spark, one.path)
    version, before = two._next(), two.manifest()
    assert one.append(documents.limit(3)) == version  # while the other one writes
    with pytest.raises(RuntimeError):
        two._commit(before, version)
    assert one.versions() == [1, 2] and two.read(documents.schema).count() == 6


def test_vacuum_spares_what_is_not_committed_and_kept_versions(spark, documents):
    import glob

    table = sharding.ShardedTable(spark, arrival_bytes=3_000)
    local = table.path.removeprefix("file://")
    for _ in range(3):
        table.append(documents.limit(5))
    documents.limit(2).write.parquet(f"{table.path}/data/000000004-of-another-writer")
    table.compact(documents.schema)
    table.vacuum(retain=2)
    assert table.versions() == [3, 4] and table.read(documents.schema, 3).count() == 15 == table.read(documents.schema).count()
    table.vacuum()
    assert table.versions() == [4] and table.read(documents.schema).count() == 15
    assert len(glob.glob(f"{local}/data/*")) == 2 and len(glob.glob(f"{local}/manifests/*")) == 1


def test_clashing_columns_repeats_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1, 2, "s"), (1, "a", "x", 1, 2, "s"), (None, None, None, None, None, None)] * 20, "doc_id long, text string, __shard string, run_ int, run int, shard string").repartition(7)
    table = sharding.compacted(rows, target_bytes=30, arrival_bytes=2)
    assert content(table.read(rows.schema)) == content(rows) and table.plan().count() == 0
    out = sharding.digests(rows, target_bytes=30, arrival_bytes=2).select("mergeable", "oversized", "table_docs").distinct().collect()
    assert [tuple(r) for r in out] == [(0, 0, 60)]


SPELLINGS = {"plain": "", "file:": "file:", "file://": "file://"}


@pytest.mark.parametrize("spelling", sorted(SPELLINGS))
def test_merged_shards_merge_again_however_the_folder_is_spelt(spark, documents, tmp_path, spelling):
    """Appends and compactions in turn: shards that were merged are merged again, and no row is lost."""
    table = sharding.ShardedTable(spark, f"{SPELLINGS[spelling]}{tmp_path}/table", target_bytes=400_000, arrival_bytes=2_000)
    all_of, merges = None, 0
    for k in range(3):
        part = documents.where(f"doc_id % 3 = {k}")
        all_of = part if all_of is None else all_of.unionByName(part)
        table.append(part)
        while table.compact(documents.schema) is not None:
            merges += 1
        assert content(table.read(documents.schema)) == content(all_of)
        assert table.manifest().agg({"n_docs": "sum"}).first()[0] == all_of.count()
    # a merge of this version has taken in shards that an earlier one made
    assert merges >= 3 and table.manifest().where("shard LIKE '%/run%' AND n_docs > 20").count()
    other = sharding.ShardedTable(spark, f"{SPELLINGS['file://' if spelling == 'plain' else 'plain']}{tmp_path}/table")
    assert content(other.read(documents.schema)) == content(documents)
    table.vacuum()
    assert content(other.read(documents.schema)) == content(documents)


def test_second_writer_commits_on_top_of_the_first(spark, documents):
    one = sharding.ShardedTable(spark, arrival_bytes=3_000)
    two = sharding.ShardedTable(spark, one.path, arrival_bytes=3_000)
    one.append(documents.limit(3))
    taken, committed = two._next, []

    def late():
        number = taken()
        if not committed:
            committed.append(one.append(documents.limit(4)))  # while the other one is about to commit this number
        return number

    two._next = late
    assert two.append(documents.limit(2)) == 3 and committed == [2]
    assert one.read(documents.schema).count() == 9


def test_dead_writer_leaves_no_version_and_is_swept(spark, documents):
    table = sharding.ShardedTable(spark, arrival_bytes=3_000)
    table.append(documents.limit(3))
    folder = "data/000000002-" + "0" * 32
    documents.limit(2).write.parquet(f"{table.path}/{folder}")  # it died before its commit
    told = table._fs.create(table._at("aside/000000002-" + "0" * 32))
    told.close()
    assert table.versions() == [1] and table.append(documents.limit(2)) == 2
    table.vacuum(retain=2, grace=3600)
    assert table._fs.exists(table._at(folder))
    table.vacuum(retain=2, grace=-60)
    assert not table._fs.exists(table._at(folder)) and table.read(documents.schema).count() == 5


def test_a_merge_that_lost_rows_is_not_committed(spark, documents, monkeypatch):
    table = sharding.ShardedTable(spark, target_bytes=20_000, arrival_bytes=3_000)
    table.append(documents)
    rows = sharding.ShardedTable._rows
    monkeypatch.setattr(sharding.ShardedTable, "_rows", lambda self, *a: rows(self, *a).where("row.doc_id <> 4"))
    with pytest.raises(RuntimeError, match="has not the rows"):
        table.compact(documents.schema)
    monkeypatch.undo()
    assert table.versions() == [1] and content(table.read(documents.schema)) == content(documents)


def test_empty_table(empty):
    assert sharding.digests(empty).count() == 0
