"""N-gram Jaccard self-join: documents whose sets of word shingles overlap by ``NUMERATOR / DENOMINATOR`` or more.

1. A pass over the texts gives each set's size, two 64-bit digests, and a count sketch of all shingles. Equal sets
   (copies) become one representative.
2. Shingles are ordered rare first by the sketch (ties by hash); any order that all sets share is exact. A set's
   prefix holds one shingle more than it may miss, so sets that link share a prefix shingle.
3. Prefix shingles meet by hash. Length and positional filters drop pairs that cannot link.
4. Links matter for the classes they join, so first every set is verified against the first and the nearest earlier
   set of its groups, two pairs at most for each. What is then one class needs no further pair; shingles whose sets
   still fall into several classes give all their pairs across classes, which pass a suffix filter (counts of
   shingles in fixed ranges bound the difference from below) and are verified once each.

No pair is emitted within a class, and none is left out across classes, so the classes are exact. Groups of any size
are streamed or split into blocks; a set that meets many others is salted, and so is a shingle whose cell of the sketch
stands out: its rows are dealt by salt, and the first sets of its salts give the first one of all.

Edge cases: null texts and texts without words have no shingles and link with nothing; fewer words than a shingle are
one shingle; repeated rows link as copies; rows that share an id are one node; a null id keeps a null component.
Columns besides doc_id and text are not read by ``classes``; ``keep_one`` passes all of them through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import WordHashes, batch_of, cut, drop, mix, slices, small_batches, strings
from tidegauge.llm.components import components

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4
CELLS = 64  # ranges of the suffix filter
CHUNK = 1 << 16
LOAD = 128  # shingles to a cell of the count sketch
MOST_CELLS = 1 << 24
MOST_BROADCAST_ROWS = 1_000_000
BLOCK = 1024
SALT_ROWS = 1 << 13  # rows of a frequent shingle that one salt takes
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_sets(texts: list[str], hashes: WordHashes, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [words_of(x) for x in texts]
    sizes = np.array([len(x) for x in split])
    flat = hashes.of([w for x in split for w in x])
    grams = np.zeros(len(flat), np.uint64)
    for k in range(words):
        whole = max(0, len(flat) - k)  # a slice may hold fewer words than a shingle
        grams[:whole] = grams[:whole] * PRIME + flat[k : k + whole]
    grams = mix(grams)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            own = np.uint64(n)
            for w in flat[at : at + n]:
                own = np.uint64((int(own) * int(PRIME) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([own ^ PRIME], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def least_overlap(n):
    """Least number of own shingles that a set of n shares with any set it links with."""
    return (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR


def links(both, a, b):
    """Whether sets of a and b shingles, of which ``both`` are common, link."""
    return DENOMINATOR * both >= NUMERATOR * (a + b - both)


def _cells(grams: np.ndarray) -> bytes:
    return np.minimum(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes()


def _profile(df: DataFrame, n_cells: int) -> DataFrame:
    """Rows of documents (doc_id, n, s1, s2, cells) and, with a chunk, of sketch counts (chunk, counts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("cells", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        hashes, sketch = WordHashes(), np.zeros(n_cells, np.int64)
        for batch in slices(batches, "text"):
            sets = shingle_sets(strings(batch["text"]), hashes)
            sketch += np.bincount((np.concatenate(sets) % np.uint64(n_cells)).astype(np.int64), minlength=n_cells)
            first = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets]
            second = [int(mix(x + PRIME).sum(dtype=np.uint64).view(np.int64)) for x in sets]
            none = pa.nulls(len(sets), pa.int32())
            yield batch_of(schema, batch["doc_id"], [len(x) for x in sets], first, second, [_cells(x) for x in sets], none, pa.nulls(len(sets), pa.binary()))
        for k in range(n_cells // CHUNK):
            own = sketch[k * CHUNK : (k + 1) * CHUNK]
            if own.any():
                yield batch_of(schema, [None], [None], [None], [None], [None], [k], [zlib.compress(own.astype("<u4").tobytes(), 1)])

    return df.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, cells binary, chunk int, counts binary")


def _frequencies(profile: DataFrame, n_cells: int) -> np.ndarray:
    """Eighths of the binary logarithm of each cell's count, one byte a cell and MOST_CELLS bytes at most."""
    schema = pa.schema([("chunk", pa.int32()), ("level", pa.binary())])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        for k, own in sums.items():
            yield batch_of(schema, [k], [np.minimum(8 * np.log2(1 + own), 255).astype(np.uint8).tobytes()])

    chunks = profile.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(merge, "chunk int, level binary")
    out = np.zeros(n_cells, np.uint8)
    for row in chunks.collect():  # a row a chunk, MOST_CELLS bytes in all; one job, where an iterator takes one a partition
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["level"], np.uint8)
    return out


def _salts(levels: np.ndarray) -> np.ndarray:
    """Number of salts by level: one up to twice the median cell, beyond it one for SALT_ROWS of the excess."""
    count = np.exp2(np.arange(256) / 8)
    usual = 2 * count[int(np.median(levels[levels > 0]))] if levels.any() else 0
    return np.maximum(1, np.ceil((count - usual) / SALT_ROWS)).astype(np.uint64)


def _prefixes(df: DataFrame, levels: np.ndarray) -> DataFrame:
    """(gram, doc_id, n, at, salt): the prefix of every set, rare shingles first; salt is -1 but for frequent shingles."""
    shared, n_cells, salts = df.sparkSession.sparkContext.broadcast(levels), len(levels), _salts(levels)
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("salt", pa.int32())])

    def run(batches):
        hashes, level = WordHashes(), shared.value
        for batch in slices(batches, "text", 2 << 20):
            sets = shingle_sets(strings(batch["text"]), hashes)
            grams, sizes = [], []
            for own in sets:
                order = np.argsort(level[(own % np.uint64(n_cells)).astype(np.int64)], kind="stable")
                grams.append(own[order[: len(own) - least_overlap(len(own)) + 1]] if len(own) else own)
                sizes.append(len(grams[-1]))
            sizes = np.array(sizes)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            docs, grams = np.repeat(np.asarray(batch["doc_id"]), sizes), np.concatenate(grams)
            among = salts[level[(grams % np.uint64(n_cells)).astype(np.int64)]]
            salt = np.where(among > 1, (mix(docs.view(np.uint64)) % among).astype(np.int64), -1)
            yield batch_of(schema, grams.view(np.int64), docs, np.repeat([len(x) for x in sets], sizes), at, salt)

    return df.mapInArrow(run, "gram long, doc_id long, n int, at int, salt int")


def _can_link(n, at, m, at2) -> np.ndarray:
    """Length and positional filters for a common shingle at places ``at`` and ``at2`` of sets of n and m.

    The shingle is taken for the first that they share: no earlier one is common, and at most the rest of the shorter
    tail is. A pair that links passes at its first common shingle, and need not at others.
    """
    most = np.minimum(n - at, m - at2)
    return (np.minimum(n, m) >= least_overlap(np.maximum(n, m))) & links(np.minimum(most, np.minimum(n, m)), n, m)


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix rows whose shingle another document has too, with the documents that may link with theirs: first, the
    least document of the shingle, and before, the preceding one. Rows of salted shingles all stay, without first."""
    names = ("gram", "doc_id", "n", "at", "salt")
    schema = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("salt", pa.int32()), ("first", pa.int64()), ("before", pa.int64())])

    def written_rows(rows, pivot, near):
        return batch_of(schema, *rows, pa.array(pivot, pa.int64(), mask=pivot < 0), pa.array(near, pa.int64(), mask=near < 0))

    def run(batches):
        held = None  # last row, and the first one of its shingle; written when a second row comes
        for batch in batches:
            rows = [batch[c].to_numpy() for c in names]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held[0], rows, strict=True)]
                skip = held[1]
            else:
                skip = 0
            gram, doc, n, at, salt = rows
            size = len(gram)
            change = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            start = np.flatnonzero(np.concatenate([[True], change]))
            head = np.repeat(start, np.diff(np.append(start, size)))
            last = np.maximum(np.arange(size) - 1, head)
            alone = (head == np.arange(size)) & np.append(change, True) & (salt < 0)
            pivot = np.where(_can_link(n, at, n[head], at[head]) & (doc != doc[head]) & (salt < 0), doc[head], -1)
            near = np.where(_can_link(n, at, n[last], at[last]) & (doc != doc[last]), doc[last], -1)
            # the last shingle may go on in the next batch: carry its first and its last row
            a = int(head[-1])
            keep = np.flatnonzero(~alone)
            keep = keep[(keep >= skip) & ~((keep == size - 1) & (a == size - 1))]
            if held is not None and not held[2] and (not change[0] or salt[0] >= 0):
                keep = np.concatenate([[0], keep]) if 0 not in keep else keep
            if len(keep):
                yield written_rows([r[keep] for r in rows], pivot[keep], near[keep])
            carried = [a] if a == size - 1 else [a, size - 1]
            written = a != size - 1  # a lone last row is written once its second comes
            held = ([r[carried] for r in rows], len(carried), written)
        if held is not None and not held[2] and held[0][4][0] >= 0:
            yield written_rows(held[0], np.array([-1]), np.array([-1]))

    dealt = prefixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "doc_id")
    return dealt.mapInArrow(run, "gram long, doc_id long, n int, at int, salt int, first long, before long")


def _first_of_salted(met: DataFrame) -> DataFrame:
    """(doc_id, first, before) of rows of salted shingles, with the first document of the shingle's first salts."""
    salted = met.where("salt >= 0")
    heads = salted.groupBy("gram", "salt").agg(F.min(F.struct("doc_id", "n", "at")).alias("head"))
    tops = heads.groupBy("gram").agg(F.min("head").alias("top"))
    told = salted.join(heads.join(tops, "gram").select("gram", "salt", "top"), ["gram", "salt"])
    most = F.least(F.expr("n - at"), F.expr("top.n - top.at"))  # the tests of _can_link
    linked = F.expr(f"doc_id <> top.doc_id AND {DENOMINATOR} * least(n, top.n) >= {NUMERATOR} * greatest(n, top.n)") & links(most, F.col("n"), F.col("top.n"))
    return told.where(linked).select("doc_id", F.col("top.doc_id").alias("first"), F.lit(None).cast("long").alias("before"))


def _with_text(pairs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """pairs joined with texts on pairs[key] = doc_id; few pairs go to the texts, else both are shuffled."""
    few = pairs.count() <= MOST_BROADCAST_ROWS
    side = pairs.withColumnRenamed(key, "doc_id")
    return texts.join(F.broadcast(side) if few else side, "doc_id")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs whose sets link, written. ``pairs``: distinct (a, b); ``texts``: doc_id, text."""
    pairs = cut(pairs, "pairs")
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias("salts"))
    salted = cut(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")), "salted")
    heads = salted.select("a", "salt").distinct()
    left = _with_text(heads.select(F.col("a").alias("key"), "a", "salt"), texts, "key").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = _with_text(salted.select(F.col("b").alias("key"), "a", "salt"), texts, "key").select("a", "salt", F.col("doc_id").alias("b"), "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hashes, at, own = WordHashes(), None, []
        for batch in slices(batches, "text"):
            sets = shingle_sets(strings(batch["text"]), hashes)
            found = []
            for a, b, other in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), sets, strict=True):
                if a != at:
                    at, own = a, []
                if b is None:
                    own.append(other)
                elif any(links(len(np.intersect1d(x, other, assume_unique=True)), len(x), len(other)) for x in own):
                    found.append((a, b))
            if found:
                yield batch_of(schema, *(list(x) for x in zip(*found, strict=True)))

    dealt = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    out = cut(dealt.mapInArrow(run, "a long, b long"), "links")
    drop(pairs, salted)
    return out


def _across(shared: DataFrame, labels: DataFrame, cells: DataFrame, done: DataFrame) -> DataFrame:
    """(a, b): all pairs of different classes that share a prefix shingle and pass the filters, but those done; written."""
    told = shared.join(labels, shared["doc_id"] == labels["id"], "left").select("gram", "doc_id", "n", "at", F.coalesce("component", "doc_id").alias("label"))
    told = cut(told, "told")
    mixed = told.groupBy("gram").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most").select("gram", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = told.join(mixed, "gram").join(cells.select("doc_id", "cells"), "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("gram", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "n", "at", "label", "cells")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        names = ("gram", "i", "j", "block", "doc_id", "n", "at", "label")
        held = None

        def pairs(group):
            _, i, j, block, doc, n, at, label, cell = group
            out = []
            for k in range(len(doc) - 1):  # a block of BLOCK rows or two, row by row against the later ones
                hit = (label[k + 1 :] != label[k]) & _can_link(n[k], at[k], n[k + 1 :], at[k + 1 :]) & (doc[k + 1 :] != doc[k])
                if i[0] != j[0]:
                    hit &= block[k + 1 :] != block[k]
                near = np.flatnonzero(hit) + k + 1
                if len(near):  # the suffix filter: at most so many shingles are common
                    both = (n[k] + n[near] - np.abs(cell[near] - cell[k]).sum(1)) // 2
                    near = near[links(both, n[k], n[near])]
                to = doc[near]
                if len(to):
                    out.append(np.stack([np.minimum(to, doc[k]), np.maximum(to, doc[k])], 1))
            return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)

        for batch in batches:
            rows = [batch[c].to_numpy() for c in names]
            rows.append(np.frombuffer(b"".join(batch["cells"].to_pylist()), "<u2").astype(np.int32).reshape(-1, CELLS))
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])) + 1
            edges = [0, *change.tolist()]
            found = [pairs([r[a:b] for r in rows]) for a, b in zip(edges, edges[1:], strict=False)]
            held = [r[edges[-1] :] for r in rows]
            if found and len(found := np.unique(np.concatenate(found), axis=0)):
                yield batch_of(schema, found[:, 0], found[:, 1])
        if held is not None and len(found := pairs(held)):
            yield batch_of(schema, found[:, 0], found[:, 1])

    met = spread.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(run, "a long, b long").distinct()
    new = met.join(done, ["a", "b"], "left_anti")
    out = cut(new, "rest")
    drop(told)
    return out


def classes(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    small_batches(df.sparkSession)
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    characters = texts.select(F.sum(F.length("text"))).first()[0] or 0
    n_cells = CHUNK
    while n_cells < MOST_CELLS and n_cells * LOAD < characters // 6:
        n_cells *= 2
    profile = cut(_profile(texts, n_cells), "profile")
    documents = profile.where("chunk IS NULL").select("doc_id", "n", "s1", "s2", "cells")
    sets = documents.where("n > 0 AND doc_id IS NOT NULL")
    copies = sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = cut(sets.join(copies, ["n", "s1", "s2"]).select("doc_id", "rep"), "members")
    prefixes = _prefixes(texts.where("doc_id IS NOT NULL"), _frequencies(profile, n_cells))
    met = cut(_shared(prefixes), "shared")
    # copies stand for their representative: a shingle's rows of one set fall together
    nearest = met.select("doc_id", "first", "before").unionByName(_first_of_salted(met)).groupBy("doc_id").agg(F.min("first").alias("first"), F.max("before").alias("before"))
    reps = members.where("doc_id <> rep").distinct()

    def standing(frame, column):
        own = reps.select(F.col("doc_id").alias("__id"), F.col("rep").alias("__rep"))
        return frame.join(own, frame[column] == own["__id"], "left").withColumn(column, F.coalesce("__rep", column)).drop("__id", "__rep")

    pairs = nearest.select("doc_id", F.explode(F.array("first", "before")).alias("other")).where("other IS NOT NULL")
    pairs = standing(standing(pairs, "doc_id"), "other").where("doc_id <> other").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    pairs = cut(pairs, "first-pairs")
    near = verified(pairs, texts)
    same_id = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count_distinct("rep").alias("k")).where("k > 1").select("a", "b")
    first = labels = components(near.unionByName(same_id))
    rows = standing(met.select("gram", "doc_id", "n", "at"), "doc_id").distinct()
    cells = sets.groupBy("doc_id").agg(F.first("n").alias("n"), F.first("cells").alias("cells"))
    rest = _across(rows, labels, cells, pairs)
    scratch = [profile, members, met, pairs, near, rest]
    if not rest.isEmpty():
        more = verified(rest, texts)
        scratch.append(more)
        labels = components(near.unionByName(same_id).unionByName(more))
    own = standing(documents.select("doc_id", "n", F.col("doc_id").alias("rep")), "rep")
    out = own.join(labels, own["rep"] == labels["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    out = cut(out, "classes")
    drop(*scratch, *{id(x): x for x in (first, labels) if hasattr(x, "cut_folder")}.values())
    return out


def keep_one(df: DataFrame) -> DataFrame:
    """Rows of ``df`` but those whose document has a class with a smaller id. Rows with a null id stay."""
    told = classes(df)
    gone = cut(told.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    drop(told)
    few = gone.count() <= MOST_BROADCAST_ROWS
    return df.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*df.columns)
