"""Hard negatives, exact top-k and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import exact_topk, hard_negatives, merkle, vector_blocks

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int, ask string, number array<long>"


def vectors(spark, n=700, size=12, seed=1):
    """Rows with ties, repeats, nulls, non-finite components, another length, and columns that clash."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, size))
    x[50:90] = x[49]  # a group of copies
    x[100:130] = 0
    x[130:140] = -x[49]
    rows = [[k, v.tolist(), int(rng.integers(0, 4))] for k, v in enumerate(x)]
    rows[7][1] = None
    rows[100][2] = None
    rows[9][1][3] = None
    rows[11][1][2] = float("nan")
    rows[13][1][0] = float("-inf")
    rows += [[n + k, rng.normal(0, 0.3, 3).tolist(), k % 2] for k in range(40)]  # vectors of another length
    rows += [[None, x[0].tolist(), 1], [n + 50, [], 1], [n + 60, [], 1]]
    rows += [[rows[60][0], rows[60][1], rows[60][2]], [200, rows[201][1], rows[201][2]]]  # a row twice, an id twice
    return rows, spark.createDataFrame([(*r, "s", 1, "a", [1]) for r in rows], SCHEMA).repartition(5)


def fit(rows, labelled):
    out = []
    for i, x, label in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and (label is not None or not labelled):
            out.append((i, [int(np.floor(256 * v)) for v in x], label))
    return out


def dot(a, b):
    return sum(p * q for p, q in zip(a, b, strict=True))


def test_topk_against_all_rows(spark):
    rows, df = vectors(spark)
    own = fit(rows, False)
    for block, every, k in ((64, 10, 5), (2048, 50, 3)):
        got = sorted(tuple(r) for r in exact_topk.top(df, every, k, block=block).select("query_id", "rank", "vec_id", "score").collect())
        want = []
        for a, (i, x, _) in enumerate(own):
            if i % every == 0:
                best = sorted((-dot(x, y), j) for b, (j, y, _) in enumerate(own) if b != a and len(y) == len(x))[:k]
                want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
        assert got == sorted(want)


def test_bit_slices_add_up():
    rng = np.random.default_rng(3)
    for low, high, size in ((-5, 5, 1), (-300, 300, 9), (-(2**20), 2**20, 4), (0, 1, 3), (0, 2, 0)):
        x, q = rng.integers(low, high, (130, size)), rng.integers(low, high, (7, size))
        (bits, words), maps = exact_topk.sliced(x)[0].tolist(), exact_topk.sliced(x)[1].view(np.uint64)
        every = np.concatenate([maps.reshape(size * bits, words), ~maps.reshape(size * bits, words), np.zeros((1, words), np.uint64)])
        ((numbers, constants),) = exact_topk.prepared(q, bits)
        slices = exact_topk.added(every, numbers, len(q))
        planes = np.unpackbits(slices.view(np.uint8), axis=2, bitorder="little")[:, :, :130].astype(object)
        total = sum(plane * (1 << w) for w, plane in enumerate(planes)) + constants[:, None]
        assert (total == q.astype(object) @ x.astype(object).T).all()
    for value in (*range(-40, 41), 2**40 - 1, -(2**40)):
        told = exact_topk.digits(value)
        assert sum(d << p for p, d in told) == value and all(b[0] - a[0] > 1 for a, b in zip(told, told[1:], strict=False))


def test_hard_negatives_against_all_rows(spark):
    rows, df = vectors(spark, seed=2)
    own = fit(rows, True)
    for block, every in ((64, 10), (2048, 35)):
        out = hard_negatives.mine(df, every, block=block)
        got = sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
        want = []
        for a, (i, x, label) in enumerate(own):
            if i % every:
                continue
            told = [(-dot(x, y), j, other) for b, (j, y, other) in enumerate(own) if b != a and len(y) == len(x)]
            for p, j, _ in sorted((s, j, o) for s, j, o in told if o == label)[:5]:
                best = sorted((s, n) for s, n, o in told if o != label and 30 * -p <= 100 * -s <= 90 * -p)[:10]
                want += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(best, 1)]
        assert got == sorted(want) and want


def test_products_are_exact_or_an_error():
    a, b = np.array([[2**25, 3]]), np.array([[2**26, 5], [-(2**25), 7]])
    assert hard_negatives.products(a, b).tolist() == [[2**51 + 15, -(2**50) + 21]]
    big = np.array([[2**27 + 1, 1]])
    assert hard_negatives.products(big, big).tolist() == [[(2**27 + 1) ** 2 + 1]]
    with pytest.raises(ValueError):
        hard_negatives.products(big * 4, big * 4)


def test_components_that_are_too_large_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300], 1), (1, [0.5], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="passes 32 bits"):
        exact_topk.top(df, 1).collect()


def test_blocks_hold_every_row_once(spark):
    rows, df = vectors(spark)
    blocks = vector_blocks.Blocks(vector_blocks.quantised(df, "vec_id", "embedding"), 10, lambda x: [x], 32)
    told = blocks.catalogue.collect()
    seen = [i for r in told for i in vector_blocks.Block(blocks.folder, r["name"]).ids.tolist()]
    assert sorted(seen) == sorted(i for i, _, _ in fit(rows, False)) and max(r["n"] for r in told) <= 32
    blocks.drop()


def test_empty_vectors_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None)] * 3, SCHEMA)
    for df in (none, nulls):
        assert exact_topk.top(df, 1).count() == 0 == hard_negatives.mine(df, 1).count()
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert exact_topk.top(one, 1).count() == 0 == hard_negatives.mine(one, 1).count()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    told = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in told])


def grown(nodes):
    """All levels of a tree, and for each leaf its steps (before, behind)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k : k + 3]) for k in range(0, len(last), 3)])
    steps = []
    for k in range(len(nodes)):
        own = []
        for level in levels[:-1]:
            a = k // 3 * 3
            own.append(("".join(level[a:k]), "".join(level[k + 1 : a + 3])))
            k //= 3
        steps.append(own)
    return levels[-1][0], steps


def shown(row):
    if row["text"] is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
        return row["text"].replace("\n", "")
    return row["text"]


def proved(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = (own, *grown([leaf(r, r["text"]) for r in own]))
    root, crown = grown([trees[s][1] for s in order])
    out = []
    for s, more in zip(order, crown, strict=True):
        own, subroot, steps = trees[s]
        for r, path in zip(own, steps, strict=True):
            path, h = [*path, *more], leaf(r, shown(r))
            for before, behind in path:
                h = sha(before, h, behind)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha(*[a + b for a, b in path]), h, h == root))
    return sorted(map(repr, out))


def documents_of(spark, sizes, seed=5):
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "é\U0001f600\r\n", "plain", "x" * rng.randint(0, 3000)])
            rows.append((rng.randint(-50, 10**12), text, rng.choice([None, "en"]), source, rng.choice([None, 3]), "k", 1, [2], "p"))
    rows += [rows[0], rows[0], (None, "t", None, rows[0][3], 1, "k", 1, [2], "p"), (None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int, path array<int>, digest string").repartition(7)


@pytest.mark.parametrize("sizes", [{"hot": 400, "b": 82, "c": 81, None: 9, "": 1, "é": 2, "z": 3, "Z": 4}, {f"s{k}": 1 + k % 4 for k in range(95)}, {"one": 1}])
def test_manifest_against_plain_python(spark, sizes):
    df = documents_of(spark, sizes)
    out = merkle.manifest(df, merkle.tampered())
    got = sorted(repr(tuple(r)) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == proved(df.collect())


def test_untouched_rows_verify_and_nothing_gives_nothing(spark):
    df = documents_of(spark, {"a": 100, "b": 1})
    assert merkle.manifest(df).where("NOT verified").count() == 0
    assert merkle.manifest(df.limit(0)).count() == 0
    alone = merkle.manifest(df.where("doc_id IS NOT NULL").limit(1)).first()
    assert alone["leaf"] == alone["subroot"] == alone["root"] == alone["folded_root"] and alone["proof_sha256"] == sha("")


def test_manifest_uses_no_python(spark):
    df = documents_of(spark, {"a": 10})
    for part in (merkle.numbered(df.select(F.col("source"), "doc_id"), "source", ["doc_id"])[1], df.select(merkle.leaf(merkle.tampered()))):
        plan = part._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
