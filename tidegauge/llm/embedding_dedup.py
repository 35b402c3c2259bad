"""Near-duplicate embeddings by sorted projection passes.

1. A pass orders the distinct vectors of a label by a key of ``BITS`` concatenated random sign hashes and compares each
   with the ``WINDOW`` before it. Pairs verified by cosine in double precision are the links; they unite across passes. Two
   vectors at the threshold's angle stand within a window where their first log2(n / WINDOW) signs agree, and the number of passes
   is such that a pair fails to in all of them with a chance of ``MISS``, for the largest label: it grows with the logarithm of n.
2. Where the vector at a window's edge is a link, more may lie behind it. The classes that hold such dense stretches go
   through an exact step, and so do labels whose vectors lie so narrowly together that signs tell little: those in which about
   ``SAMPLES`` vectors, compared with all of their label, have a link that no pass met. It counts their links and unites what the passes left apart. It takes some vectors as
   pivots, ``PIVOTS`` about at most for a label, and deals each vector to the pivot at
   the least angle; large groups are salted into units of about ``BLOCK`` vectors. Two units are compared unless the
   angle between their pivots is more than their radii and the angle of the threshold together: the triangle inequality
   then rules out a link. Its work grows with the square of a dense class's distinct vectors where pivots rule nothing out.

Equal vectors of a label are compared once and counted as often as they occur.

Edge cases: vectors that are null, zero, or hold null or non-finite components, and vectors with a null label, link
with nothing; vectors of different lengths do not link; repeated rows are copies; rows that share an id are one node
and their links add up; a null id has a null class and is kept. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import batch_of, cut, drop, map_file, remove, shared_dir, write_file
from tidegauge.llm.components import components

THRESHOLD = 0.98
BITS, WINDOW, MISS = 63, 32, 1e-4
SAMPLES = 256
BLOCK = 2048
PIVOTS = 64
SLACK = 1e-6  # for rounding in angles


def _unit(rows: list[bytes], n: int | None = None) -> np.ndarray:
    """Vectors of length 1; ``n``: their number, where they are not one to an item of ``rows``."""
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows) if n is None else n, -1)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of large or tiny components leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label (string), vec: doubles as bytes, null where the vector can link with nothing."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for label, row in zip(batch["label"], batch["vector"], strict=True):
                x = None if row.values is None or not label.is_valid or row.values.null_count else row.values.to_numpy()
                out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else (x + 0.0).astype("<f8").tobytes())
            yield batch_of(schema, batch["id"], batch["label"], out)

    return source.mapInArrow(run, "id long, label string, vec binary")


def passes_for(n: int, threshold: float) -> int:
    """Passes over a label of n vectors after which a pair at the threshold has met but for a chance of ``MISS``."""
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    met = agree ** max(0.0, np.log2(max(n, 1) / WINDOW))
    return 1 if met >= 1 else int(np.ceil(np.log(MISS) / np.log(1 - met)))


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    same = (small.astype("<f8") == x).all(1)
    return [a.tobytes() if k else b.tobytes() for a, b, k in zip(small, x, same.tolist(), strict=True)]


def _unpacked(rows: list[bytes], size: int) -> list[bytes]:
    return [r if len(r) == 8 * size else np.frombuffer(r, "<f4").astype("<f8").tobytes() for r in rows]


def _passes(reps: DataFrame, threshold: float, passes: int) -> DataFrame:
    """(a, b): distinct verified pairs of the windows of all passes, a < b; (a, a) tells that the vector at the edge of a's
    window is a link, and of such a window only the nearest and the farthest pair is given."""
    keyed = pa.schema([("pass", pa.int32()), ("label", pa.string()), ("size", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("vec", pa.binary())])

    def keys(batches):
        for batch in batches:
            sizes, rows = batch["size"].to_numpy(), batch["vec"].to_pylist()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x, vec = _unit([rows[k] for k in at]), pa.array(_packed(np.frombuffer(b"".join(rows[k] for k in at), "<f8").reshape(len(at), size)), pa.binary())
                own = batch.take(pa.array(at))
                for p in range(passes):
                    planes = np.random.default_rng((p, size)).standard_normal((size, BITS))
                    key = (x @ planes > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield batch_of(keyed, np.full(len(at), p), own["label"], own["size"], key, own["id"], vec)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    line = ["pass", "label", "size", "key", "id"]

    def compared(ids, x, fresh):
        """Pairs of one pass, label and size; the first ``fresh`` rows were compared with each other before."""
        hits = np.zeros((len(ids), WINDOW + 1), bool)
        for d in range(1, min(WINDOW, len(ids) - 1) + 1):
            hits[d:, d] = (x[d:] * x[:-d]).sum(1) >= threshold
        hits[:fresh] = False
        edge = hits[:, WINDOW].copy()
        near, far = hits.argmax(1), WINDOW - hits[:, ::-1].argmax(1)
        keep = hits & ~edge[:, None]
        full = np.flatnonzero(edge)
        keep[full, near[full]] = keep[full, far[full]] = True
        at, d = np.nonzero(keep)
        return np.concatenate([np.stack([ids[at], ids[at - d]], 1), np.stack([ids[full], ids[full]], 1)])

    def windows(batches):
        held, fresh = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            ids, p, size, rows = table["id"].to_numpy(), table["pass"].to_numpy(), table["size"].to_numpy(), table["vec"].to_pylist()
            label = np.array(table["label"].to_pylist(), object)
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (size[1:] != size[:-1]) | (label[1:] != label[:-1])]))
            found = [compared(ids[a:b], _unit(_unpacked(rows[a:b], int(size[a]))), max(0, fresh - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
            pairs = np.concatenate(found)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, 1), axis=0)
                yield batch_of(schema, pairs[:, 0], pairs[:, 1])
            last = table.slice(max(0, len(ids) - WINDOW)).to_batches()
            held = last[0] if last else None
            fresh = held.num_rows if held is not None else 0

    spread = reps.select("id", "label", "size", "vec").mapInArrow(keys, "pass int, label string, size int, key long, id long, vec binary")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartitionByRange(n, *line).sortWithinPartitions(*line).mapInArrow(windows, "a long, b long").distinct()


def _file_of(folder: str, label: str, size: int) -> str:
    return f"{folder}/{hashlib.md5(f'{size}:{label}'.encode()).hexdigest()}"


def _sampled(reps: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): distinct links of about ``SAMPLES`` vectors of each label with all of its vectors, a < b; written. The samples of a
    label are a file that tasks map, so no vector is shuffled but theirs."""
    folder = shared_dir(reps.sparkSession, "samples")
    large = sizes.where(F.col("n") > WINDOW + 1)  # a smaller label is one window
    chosen = reps.join(large, ["label", "size"]).where(F.pmod(F.xxhash64("id", F.lit(11)), F.ceil(F.col("n") / SAMPLES)) == 0)
    written = pa.schema([("label", pa.string())])

    def write(batches):
        held: dict = {}
        for batch in batches:
            for label, size, i, vec in zip(*(batch[c].to_pylist() for c in ("label", "size", "id", "vec")), strict=True):
                if held and (label, size) not in held:
                    yield put(*held.popitem())
                held.setdefault((label, size), []).append((i, vec))
        if held:
            yield put(*held.popitem())

    def put(of, rows):
        write_file(_file_of(folder, *of), [np.array([i for i, _ in rows], "<i8"), b"".join(v for _, v in rows)])
        return batch_of(written, [of[0]])

    line = ["label", "size", "id"]
    chosen.select("label", "size", "id", "vec").repartition("label", "size").sortWithinPartitions(*line).mapInArrow(write, "label string").count()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            ids, rows = batch["id"].to_numpy(), batch["vec"].to_pylist()
            own: dict = {}
            for k, of in enumerate(zip(batch["label"].to_pylist(), batch["size"].to_pylist(), strict=True)):
                own.setdefault(of, []).append(k)
            for (label, size), at in own.items():
                try:
                    raw = map_file(_file_of(folder, label, size), np.uint8)
                except FileNotFoundError:  # a label of few vectors
                    continue
                n = len(raw) // (8 + 8 * size)
                samples, x = raw[: 8 * n].view("<i8"), _unit([raw[8 * n :].tobytes()], n)
                k, j = np.nonzero(_unit([rows[k] for k in at]) @ x.T >= threshold)
                pairs = np.sort(np.stack([ids[np.array(at)[k]], samples[j]], 1), 1)
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                yield batch_of(schema, pairs[:, 0], pairs[:, 1])

    out = cut(reps.select("id", "label", "size", "vec").mapInArrow(compare, "a long, b long").distinct(), "sampled")
    remove(reps.sparkSession, folder)
    return out


def _grouped(reps: DataFrame, threshold: float) -> DataFrame:
    """``reps`` with unit, its own, and others: the units of its label and size that may hold a link of it."""
    spark, key = reps.sparkSession, ["label", "size"]
    sizes = reps.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    step = F.greatest(F.lit(BLOCK), F.ceil(F.col("n") / PIVOTS))
    chosen = reps.join(sizes, key).where(F.pmod(F.xxhash64("id", F.lit(7)), step) == 0).orderBy(*key, "id").select(*key, "vec")
    found: dict = {}
    for row in chosen.collect():  # a vector of BLOCK
        found.setdefault((row["label"], row["size"]), []).append(bytes(row["vec"]))
    pivots = {k: _unit(v) for k, v in found.items()}
    shared = spark.sparkContext.broadcast(pivots)
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("size", pa.int32()), ("times", pa.int64()), ("class", pa.int64()), ("vec", pa.binary()), ("group", pa.int32()), ("angle", pa.float64())])

    def nearest(batches):
        for batch in batches:
            rows = batch["vec"].to_pylist()
            group, angle = np.zeros(len(rows), np.int32), np.full(len(rows), np.pi)
            own: dict = {}
            for k, of in enumerate(zip(batch["label"].to_pylist(), batch["size"].to_pylist(), strict=True)):
                if of in shared.value:
                    own.setdefault(of, []).append(k)
            for of, at in own.items():
                cosine = _unit([rows[k] for k in at]) @ shared.value[of].T
                group[at] = cosine.argmax(1)
                angle[at] = np.arccos(np.clip(cosine.max(1), -1, 1))
            yield batch_of(schema, *[batch[c] for c in ("id", "label", "size", "times", "class", "vec")], group, angle)

    placed = reps.select("id", "label", "size", "times", "class", "vec").mapInArrow(nearest, "id long, label string, size int, times long, class long, vec binary, group int, angle double")
    placed = cut(placed, "groups")
    groups = placed.join(sizes, key).groupBy(*key, "group").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy(*key, "group")
    of_label: dict = {}
    for row in groups.collect():  # a row a pivot, or a label of more than BLOCK vectors
        of_label.setdefault((row["label"], row["size"]), []).append(row)
    told, reach = [], float(np.arccos(np.clip(threshold, -1, 1))) + SLACK
    for of, rows in of_label.items():
        blocks = np.array([-(-r["n"] // BLOCK) for r in rows])
        base, radius = np.cumsum(blocks) - blocks, np.array([r["radius"] for r in rows])
        x = pivots[of][[r["group"] for r in rows]] if of in pivots else None
        apart = np.zeros((1, 1)) if x is None else np.arccos(np.clip(x @ x.T, -1, 1))
        near = apart <= radius[:, None] + radius + reach  # else the triangle inequality rules all pairs out
        np.fill_diagonal(near, True)
        for k, r in enumerate(rows):
            others = [u for h in np.flatnonzero(near[k]) for u in range(int(base[h]), int(base[h] + blocks[h]))]
            told.append((*of, r["group"], int(base[k]), int(blocks[k]), others))
    units = spark.createDataFrame(told, "label string, size int, group int, base int, blocks int, others array<int>")
    unit = F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return placed.join(F.broadcast(units), [*key, "group"], "left").select("id", *key, "times", "class", "vec", F.coalesce(unit, F.lit(0)).alias("unit"), F.coalesce("others", F.array(F.lit(0))).alias("others"))


def _firsts(hit: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first row of its class."""
    first = np.arange(len(hit))
    new = hit.any(1)
    for k in range(len(hit)):
        if new[k]:
            new[k], edge = False, np.array([k])
            while len(edge):
                edge = np.flatnonzero(hit[edge].any(0) & new)
                first[edge], new[edge] = k, False
    return first


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, first): for each two units, rows that a vector links with, and a vector of another class of the passes
    that these links lead to, if there is one."""
    spread = rows.withColumn("other", F.explode("others")).select("label", "size", F.least("unit", "other").alias("i"), F.greatest("unit", "other").alias("j"), "unit", "id", "times", "class", "vec")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("first", pa.int64())])
    key = ["label", "size", "i", "j"]

    def linked(rows):
        unit, ids, times, known = (rows[c].to_numpy() for c in ("unit", "id", "times", "class"))
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        x = _unit(rows["vec"].to_pylist())
        if i == j:
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
        else:  # links within a unit are its own pair's
            one, two = np.flatnonzero(unit == i), np.flatnonzero(unit == j)
            hit = np.zeros((len(ids), len(ids)), bool)
            hit[np.ix_(one, two)] = x[one] @ x[two].T >= threshold
            hit |= hit.T
        own = np.flatnonzero(hit.any(1))
        first = _firsts(hit)[own]
        return ids[own], [int(times[h].sum()) for h in hit[own]], pa.array(ids[first], mask=known[first] == known[own])

    def run(batches):
        held = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            label, *rest = table["label"].to_pylist(), *(table[c].to_numpy() for c in key[1:])
            change = np.any([k[1:] != k[:-1] for k in (np.array(label, object), *rest)], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield batch_of(schema, *linked(table.slice(a, b - a)))
            held = table.slice(edges[-1]).to_batches()
        if held:
            yield batch_of(schema, *linked(pa.Table.from_batches(held).combine_chunks()))

    return spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "id long, links long, first long")


def dedup(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", passes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector. ``passes`` is chosen by ``passes_for`` where it is not given."""
    vectors = cut(_vectors(df, id_col, vector_col, label_col), "vectors")
    fit = vectors.where("vec IS NOT NULL AND id IS NOT NULL")
    copies = cut(fit.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "distinct-vectors")
    reps = copies.select(F.col("rep").alias("id"), "label", F.expr("cast(length(vec) div 8 as int)").alias("size"), "vec", "times")
    sizes = cut(reps.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row a label
    most = sizes.agg(F.max("n")).first()[0] or 0
    met = cut(_passes(reps, threshold, passes or passes_for(most, threshold)), "pairs")
    pairs = met.where("a <> b")
    near = components(pairs)
    # classes with a stretch that windows do not reach across
    dense = met.where("a = b").join(near, F.col("a") == near["id"]).select("component").distinct()
    classed = reps.join(near, "id", "left").join(dense.withColumn("dense", F.lit(True)), "component", "left")
    classed = cut(classed.select("id", "label", "size", "vec", "times", F.coalesce("component", "id").alias("class"), F.coalesce("dense", F.lit(False)).alias("dense")), "classed")
    # labels in which a sampled vector has a link that no pass met and the exact step would not see
    sampled = _sampled(reps, sizes, threshold)
    missed = sampled.join(pairs, ["a", "b"], "left_anti")
    seen = lambda c: classed.select(F.col("id").alias(c), "label", "size", F.col("dense").alias(f"dense_{c}"))
    missed = missed.join(seen("a"), "a").join(seen("b").drop("label", "size"), "b").where("NOT (dense_a AND dense_b)").select("label", "size").distinct()
    narrow = classed.join(missed.withColumn("narrow", F.lit(True)), ["label", "size"], "left")
    crowd = cut(narrow.where("dense OR narrow").select("id", "label", "size", "vec", "times", "class"), "crowd")
    linked = cut(_linked(_grouped(crowd, threshold), threshold), "links") if not crowd.isEmpty() else None
    labels = near
    if linked is not None:
        rest = linked.where("first IS NOT NULL").select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()
        labels = near if rest.isEmpty() else components(pairs.unionByName(rest))
    # links of the passes, but those between two vectors that the exact step has counted
    told = reps.select("id", "times").join(crowd.select("id", F.lit(True).alias("crowded")), "id", "left")
    side = lambda c: told.select(F.col("id").alias(c), F.col("times").alias(f"times_{c}"), F.coalesce("crowded", F.lit(False)).alias(f"crowded_{c}"))
    open_pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("NOT (crowded_a AND crowded_b)")
    both = F.array(F.struct(F.col("a").alias("id"), F.col("times_b").alias("links")), F.struct(F.col("b").alias("id"), F.col("times_a").alias("links")))
    counts = open_pairs.select(F.explode(both).alias("x")).select("x.*")
    if linked is not None:
        counts = counts.unionByName(linked.select("id", "links"))
    counted = counts.groupBy("id").agg(F.sum("links").alias("links"))
    found = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").join(counted.withColumnRenamed("id", "rep"), "rep", "left")
    own = found.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = vectors.join(own, ["label", "vec"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    out = cut(out, "deduplicated")
    made = {id(x): x for x in (near, labels) if hasattr(x, "cut_folder")}
    drop(vectors, copies, sizes, met, classed, sampled, crowd, *([] if linked is None else [linked]), *made.values())
    return out
