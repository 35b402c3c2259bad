"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Order 3 by default, or 2. Counts are raw at the highest order, below it the number of different words before an n-gram;
two start marks precede a text. Training:

1. Words are dealt by ranges of their 63-bit hash; a word's number is its place in the order of all hashes, whose shards
   get their first numbers from a prefix sum.
2. Triples (a, b, c) are dealt by their middle word b, so that the context (a, b), the pairs (b, c) and what follows b
   meet in one shard, and one shuffle serves two orders. A word with more than a fraction of all tokens is dealt by
   (a, b) instead; its pairs, already added up, are shuffled once more by (b, c). Shards are counted in ``ROUNDS``
   rounds, whose shuffle files go before the next one, so that the disk needed beside the model stays small.
3. Per word: different words before it, and how often its followers were counted once, twice and more.

A shard is a sorted file for each kind in the shared folder: buckets by the leading bits of a hash, the next 32 bits, and
numbers of rows in a table of the distinct counts. Two n-grams of a shard are taken for one where these bits agree, a
chance of 2 ** -28 a lookup at any size. Scoring tasks map the files a slice of texts needs; nothing of the model passes
through the driver but its totals and the frequent words' numbers. All arrays grow with the corpus.

Edge cases: a null text is empty and has the end token only; a row with a null id trains as the empty id text; rows
that repeat count each; words outside the training text share the uniform part of the unigram distribution; without
training rows every score is 0, the log of 1 over (V + 1). Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import PRIME, batch_of, cut, drop, hash_words, map_file, mix, shared_dir, slices, small_batches, split_words, write_file

ORDER = 3
ROUNDS = 2
SHARD_TOKENS = 4 << 20
FLUSH = 8 << 20
ROW_BYTES = 16 << 20  # of a batch of packed rows
END, START = 3, 5  # hashes of the two marks
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def distinct(columns: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of non-negative columns in order, and the sums of each array of values (of ones, without any)."""
    n = len(columns[0])
    if not n:
        return (*columns, *(values or (np.zeros(0, np.int64),)))
    bits = [int(c.max()).bit_length() for c in columns]
    key = reduce(lambda key, x: (key << x[1]) | x[0], zip(columns, bits, strict=True), np.zeros(n, np.int64)) if sum(bits) <= 63 else None
    if key is not None and not values:
        key = np.sort(key)
        at = _starts(key)
        key, out = key[at], []
        for b in bits[::-1]:
            out.insert(0, key & ((1 << b) - 1))
            key = key >> b
        return (*out, np.diff(np.append(at, n)))
    values = values or (np.ones(n, np.int64),)
    order = np.lexsort(columns[::-1]) if key is None else np.argsort(key)
    columns = tuple(c[order] for c in columns)
    at = _starts(*columns)
    return (*[c[at] for c in columns], *[np.add.reduceat(v[order], at) for v in values])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a row of sorted columns differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _joint(*numbers: np.ndarray) -> np.ndarray:
    return reduce(lambda h, x: mix(h * PRIME + x.view(np.uint64)), numbers[1:], mix(numbers[0].view(np.uint64)))


def hash_file(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """A sorted hash array: keys (unsigned, distinct) with one row of values each."""
    order = np.argsort(keys)
    keys, n = keys[order], len(keys)
    code, rows = np.zeros(n, np.int64), np.zeros(1, np.int64)
    for v in values:  # number the distinct rows of values
        code = np.unique(code * (int(v.max(initial=0)) + 1) + v, return_inverse=True)[1] if n else code
    rows = np.unique(code, return_index=True)[1]
    table = np.stack([v[rows] for v in values], 1).astype("<i8")
    width = 1 if len(rows) <= 1 << 8 else 2 if len(rows) <= 1 << 16 else 4
    bits = max(0, n.bit_length() - 4)
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
    offsets = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
    rest = (keys << np.uint64(bits)) >> np.uint64(32)
    header = np.array([bits, n, width, *table.shape], "<i8")
    return [header, table, offsets.astype("<u4"), rest.astype("<u4"), code[order].astype(f"<u{width}")]


class HashArray:
    """A mapped file of ``hash_file``."""

    def __init__(self, uri: str):
        raw = map_file(uri, np.uint8)
        self.bits, self.n, width, rows, columns = raw[:40].view("<i8").tolist()
        edges = np.cumsum([40, 8 * rows * columns, 4 * ((1 << self.bits) + 1), 4 * self.n, width * self.n]).tolist()
        table, self.offsets, self.rest, self.index = (raw[a:b].view(t) for (a, b), t in zip(pairwise(edges), ("<i8", "<u4", "<u4", f"<u{width}"), strict=True))
        self.table = table.reshape(rows, columns)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Rows of values; zeros for keys that the file has not."""
        if not self.n:
            return np.zeros((len(keys), self.table.shape[1]), np.int64)
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        rest = ((keys << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
        low, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        high = end
        for _ in range(int((end - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (self.rest[np.minimum(middle, self.n - 1)] < rest) & (low < high)
            high = np.where(less, high, middle)
            low = np.where(less, middle + 1, low)
        at = np.minimum(low, self.n - 1)
        out = self.table[self.index[at]]
        out[(low >= end) | (self.rest[at] != rest)] = 0
        return out


class Model:
    """Files and totals of a model; small, and sent to every task."""

    def __init__(self, folder: str, order: int, word_bits: int, lower: bool = True):
        self.folder, self.order, self.word_bits, self.lower, self.shards = folder, order, word_bits, lower, 1
        self.hot_shards = 1
        self.bases = np.zeros((1 << word_bits) + 1, np.int64)
        self.hot = np.empty(0, np.int64)
        self.n = self.v = self.pairs = 0
        self.discounts = {k: (0.5, 1.0, 1.5) for k in (1, 2, 3)}
        self.rest = 1.0

    def uri(self, kind: str, shard: int) -> str:
        return f"{self.folder}/{kind}-{shard:06d}.bin"

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        """Shards are ranges of the hash, in its order."""
        return hashes >> (63 - self.word_bits)

    def shard(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out, hot = _joint(b), np.flatnonzero(self.is_hot(b))
        out[hot] = _joint(b[hot], (a if self.order == 3 else c)[hot])
        return (out % np.uint64(self.shards)).astype(np.int64)

    def is_hot(self, b: np.ndarray) -> np.ndarray:
        return np.isin(b, self.hot)

    def look_up(self, hashes: np.ndarray, *kinds: str) -> tuple[np.ndarray, ...]:
        """Numbers of distinct sorted word hashes (-1: not in training), and their rows of "count" (1) and "stats" (5)."""
        number = np.full(len(hashes), -1, np.int64)
        found = [np.zeros((len(hashes), {"count": 1, "stats": 5}[kind]), np.int64) for kind in kinds]
        edges = np.searchsorted(self.word_shard(hashes), np.arange((1 << self.word_bits) + 1))
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            size = int(self.bases[shard + 1] - self.bases[shard])
            if not size:
                continue
            a, b = edges[shard], edges[shard + 1]
            own = map_file(self.uri("words", shard), "<i8")
            at = np.minimum(np.searchsorted(own, hashes[a:b]), size - 1)
            hit = np.flatnonzero(own[at] == hashes[a:b])
            at = at[hit]
            number[a + hit] = self.bases[shard] + at
            for out, kind in zip(found, kinds, strict=True):
                raw = map_file(self.uri(kind, shard), np.uint8)
                out[a + hit] = raw.view(f"<u{len(raw) // size // out.shape[1]}").reshape(size, -1)[at]
        return (number, *found)

    def rows(self, kind: str, keys: np.ndarray, shards: np.ndarray, columns: int) -> np.ndarray:
        """Rows of values for n-gram keys of the given shards."""
        out = np.zeros((len(keys), columns), np.int64)
        order = np.argsort(shards.astype(np.uint16) if self.shards < 1 << 16 else shards, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            if len(own):
                try:
                    out[own] = HashArray(self.uri(kind, int(shards[own[0]])))[keys[own]]
                except FileNotFoundError:  # no n-gram fell there
                    continue
        return out


def _words(batch, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, then of start and end; every token's number among them, each text's followed by
    the end; the texts' token counts)."""
    words, which, counts = split_words(pa.compute.ascii_lower(batch["text"]) if lower else batch["text"])
    keys = np.append((hash_words(words) >> np.uint64(1)).view(np.int64), [START, END])
    return keys, np.insert(which.astype(np.int64), np.cumsum(counts), len(words) + 1), counts + 1


def _before(tokens: np.ndarray, sizes: np.ndarray, start) -> np.ndarray:
    """The token before each one, ``start`` before a text's first."""
    out = np.append(start, tokens[:-1]) if len(tokens) else tokens
    out[np.cumsum(sizes) - sizes] = start
    return out


def _training(batch) -> pa.RecordBatch:
    return batch.filter(pa.array(map(in_training, batch["doc_id"].to_pylist()), pa.bool_()))


def _discounts(times) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams were seen once to four times; the usual defaults where text is too little."""
    n1, n2, n3, n4 = (float(x) for x in times)
    if min(n1, n2, n3, n4) <= 0:
        return (0.5, 1.0, 1.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k + 1 else default for k, (d, default) in enumerate(zip(raw, (0.5, 1.0, 1.5), strict=True)))


def _off(count: np.ndarray, discounts) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(count, 3)]


def _kinds(counts: np.ndarray) -> list[np.ndarray]:
    """Whether counts are 1, 2, and more."""
    return [(counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]


def _narrow(table: np.ndarray) -> np.ndarray:
    return table.astype("<u4" if table.max(initial=0) < 1 << 32 else "<u8")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative numbers, each in the fewest bytes that hold it."""
    kinds = [next(k for k in (0, 1, 2, 3) if int(c.max(initial=0)) < 1 << (8 << k)) for c in columns]
    parts = [np.array([len(columns[0]), *kinds], "<i8"), *[c.astype(f"<u{1 << k}") for c, k in zip(columns, kinds, strict=True)]]
    return b"".join(p.tobytes() for p in parts)


def unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n, *kinds = np.frombuffer(data, "<i8", columns + 1).tolist()
    out, at = [], 8 * (columns + 1)
    for k in kinds:
        out.append(np.frombuffer(data, f"<u{1 << k}", n, at).astype(np.int64))
        at += n << k
    return out


PACKED = pa.schema([("kind", pa.int8()), ("shard", pa.int32()), ("data", pa.binary())])
PACKED_SQL = "kind byte, shard int, data binary"
WORD, PAIR, SEEN, GRAM = range(4)  # kinds: counts of words; pairs of hot words; how many n-grams were counted 1 to 4 times; n-grams


def _dealt(kind: int, shard: np.ndarray, *columns: np.ndarray):
    """Batches of (kind, shard, data), the columns packed by shard, in the order they have."""
    order = np.argsort(shard, kind="stable")
    rows, size = [], 0
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own):
            rows.append((kind, int(shard[own[0]]), pack(*[c[own] for c in columns])))
            size += len(rows[-1][2])
        if size > ROW_BYTES:
            yield batch_of(PACKED, *map(list, zip(*rows, strict=True)))
            rows, size = [], 0
    if rows:
        yield batch_of(PACKED, *map(list, zip(*rows, strict=True)))


def _gathered(batches, columns: int) -> tuple[int, list[np.ndarray]] | None:
    """The shard of all rows of a task, and their columns; None without rows."""
    found, shard = [], None
    for batch in batches:
        for k, data in zip(batch["shard"].to_pylist(), batch["data"], strict=True):
            shard = k
            found.append(unpack(data.as_buffer(), columns))
    return None if shard is None else (shard, [np.concatenate(x) for x in zip(*found, strict=True)])


def _flushed(batches, chosen, counted, emit):
    """Add ``counted`` (columns and counts of a batch's ``chosen`` rows) up over batches and ``emit`` them whenever they are many."""
    parts, size = [], 0
    for batch in slices(batches, "text"):
        batch = chosen(batch)
        if batch.num_rows:
            parts.append(counted(batch))
            size += len(parts[-1][0])
        if parts and size > FLUSH:
            *columns, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from emit(*distinct(tuple(columns), times))
            parts, size = [], 0
    if parts:
        *columns, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield from emit(*distinct(tuple(columns), times))


def _seen(order: int, counts: np.ndarray):
    """(order, n-grams counted 1, 2, 3 and 4 times, all n-grams, sum of the counts)."""
    told = [order, *np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist(), len(counts), int(counts.sum())]
    yield from _dealt(SEEN, np.zeros(1, np.int64), *[np.array([x], np.int64) for x in told])


def _pairs(model: Model, kind: str, shard: int, b: np.ndarray, c: np.ndarray, counts: np.ndarray):
    """Write pairs (sorted by b) of a shard; tell what they say about their words: id, before, total, n1, n2, n3."""
    write_file(model.uri(kind, shard), hash_file(_joint(b, c), counts))
    yield from _seen(2, counts)
    first, total, *kinds = distinct((b,), counts, *_kinds(counts))
    second, before = distinct((c,))
    joined = [np.concatenate([np.zeros(len(first), np.int64), before]), *[np.append(x, np.zeros(len(second), np.int64)) for x in (total, *kinds)]]
    words, *sums = distinct((np.append(first, second),), *joined)
    yield from _dealt(WORD, np.searchsorted(model.bases, words, "right") - 1, words, *sums)


def train(df: DataFrame, folder: str | None = None, order: int = ORDER, chosen: Callable[[pa.RecordBatch], pa.RecordBatch] = _training, lower: bool = True) -> Model:
    """Count the training rows of ``df`` (doc_id, text) and write the model to the shared folder. ``chosen`` cuts a batch to
    its training rows; with ``lower`` letters A-Z count as small ones."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = df.sparkSession
    small_batches(spark)
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # shuffle files of a round go with its query
    try:
        return _train(df, folder or shared_dir(spark, "kneser-ney"), order, chosen, lower)
    finally:
        spark.conf.set(CLEANUP, cleanup)


def _train(df: DataFrame, folder: str, order: int, chosen, lower: bool) -> Model:
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(folder, order, max(0, (n - 1).bit_length()), lower)
    word_shards = 1 << model.word_bits
    source = df.select("doc_id", F.col("text").cast("string").alias("text"))

    # 1. words
    totals = pa.schema([("shard", pa.int32()), ("size", pa.int64()), ("total", pa.int64())])

    def count_words(batches):
        def counted(batch):
            keys, tokens, sizes = _words(batch, lower)
            times = np.bincount(tokens, minlength=len(keys))
            times[-2] = len(sizes)
            return keys, times

        yield from _flushed(batches, chosen, counted, lambda keys, times: _dealt(WORD, model.word_shard(keys), keys, times))

    def write_words(batches):
        if own := _gathered(batches, 2):
            shard, (key, times) = own[0], distinct((own[1][0],), own[1][1])
            write_file(model.uri("words", shard), [key.astype("<i8")])
            write_file(model.uri("count", shard), [_narrow(times)])
            yield batch_of(totals, [shard], [len(key)], [int(times.sum())])

    words = source.mapInArrow(count_words, PACKED_SQL).repartitionById(word_shards, "shard")
    for row in words.mapInArrow(write_words, "shard int, size long, total long").collect():  # a row a shard
        model.bases[row["shard"] + 1] = row["size"]
        model.n += row["total"]
    model.bases = np.cumsum(model.bases)
    if not model.n:
        return model
    number, count = model.look_up(np.array([END, START], np.int64), "count")
    start = int(number[1])
    model.n -= int(count[1, 0])
    model.v = int(model.bases[-1]) - 1
    parts = max(n, -(-model.n // (ROUNDS * SHARD_TOKENS)))
    model.shards, model.hot_shards = parts * ROUNDS, parts  # frequent words' pairs are few beside all triples
    most = max(1, model.n // (4 * model.shards))
    sizes = np.diff(model.bases)

    def hot_words(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                if sizes[k]:
                    raw = map_file(model.uri("count", k), np.uint8)
                    at = np.flatnonzero(raw.view(f"<u{len(raw) // int(sizes[k])}") > most)
                    yield batch_of(pa.schema([("id", pa.int64())]), at + model.bases[k])

    # at most 4 * shards words can have so many tokens (and the start)
    model.hot = np.array(sorted(r["id"] for r in spark.range(word_shards).mapInArrow(hot_words, "id long").collect()), np.int64)

    # 2. triples (pairs, at order 2, whose first column is 0), a round's shards at a time
    def count_grams(k):
        def count(batches):
            def counted(batch):
                keys, tokens, sizes = _words(batch, lower)
                order_of = np.argsort(keys)
                number = np.empty(len(keys), np.int64)
                number[order_of] = model.look_up(keys[order_of])[0]
                c = number[tokens]
                b = _before(c, sizes, start)
                a = _before(b, sizes, start) if model.order == 3 else np.zeros(len(c), np.int64)
                own = model.shard(a, b, c) % ROUNDS == k
                return distinct((b[own], a[own], c[own]))

            def emit(b, a, c, times):
                yield from _dealt(GRAM, model.shard(a, b, c) // ROUNDS, b, a, c, times)

            yield from _flushed(batches, chosen, counted, emit)

        return count

    def write_grams(k):
        def write(batches):
            own = _gathered(batches, 4)
            if not own:
                return
            shard, (*columns, times) = own[0] * ROUNDS + k, own[1]
            b, a, c, times = distinct(tuple(columns), times)
            if model.order == 2:
                yield from _pairs(model, "pair", shard, b, c, times)
                return
            write_file(model.uri("triple", shard), hash_file(_joint(_joint(b, c).view(np.int64), a), times))
            yield from _seen(3, times)
            first, second, total, *kinds = distinct((b, a), times, *_kinds(times))
            write_file(model.uri("context", shard), hash_file(_joint(second, first), total, *kinds))
            b, c, before = distinct((b, c))
            hot = model.is_hot(b)
            yield from _dealt(PAIR, (_joint(b[hot], c[hot]) % np.uint64(model.hot_shards)).astype(np.int64), b[hot], c[hot], before[hot])
            if not hot.all():
                yield from _pairs(model, "pair", shard, b[~hot], c[~hot], before[~hot])

        return write

    rounds = []
    for k in range(ROUNDS):
        counted = source.mapInArrow(count_grams(k), PACKED_SQL).repartitionById(parts, "shard")
        rounds.append(cut(counted.mapInArrow(write_grams(k), PACKED_SQL), "told"))

    # pairs of frequent words, from all their shards
    def write_hot(batches):
        if own := _gathered(batches, 3):
            shard, (b, c, before) = own
            yield from _pairs(model, "hot", shard, *distinct((b, c), before))

    told = reduce(DataFrame.unionByName, rounds)
    hot = told.where(F.col("kind") == PAIR).repartitionById(parts, "shard")
    rounds.append(cut(hot.mapInArrow(write_hot, PACKED_SQL), "told"))
    told = told.unionByName(rounds[-1])

    # 3. what the pairs tell about each word
    def write_stats(batches):
        if own := _gathered(batches, 6):
            k, (words, *counts) = own
            place, *sums = distinct((words - model.bases[k],), *counts)
            table = np.zeros((sizes[k], 5), np.int64)
            table[place] = np.stack(sums, 1)
            write_file(model.uri("stats", k), [_narrow(table)])
            yield from _seen(1, table[table[:, 0] > 0, 0])

    rows = told.where(F.col("kind") == WORD).repartitionById(word_shards, "shard")
    stats = cut(rows.mapInArrow(write_stats, PACKED_SQL), "told")
    seen = np.zeros((4, 6), np.int64)
    for row in told.unionByName(stats).where(F.col("kind") == SEEN).collect():  # a row of 7 numbers a shard
        own = [int(x[0]) for x in unpack(row["data"], 7)]
        seen[own[0]] += own[1:]
    drop(*rounds, stats)
    for k in range(1, order + 1):
        model.discounts[k] = _discounts(seen[k, :4])
    one, two, _, _, n, model.pairs = (int(x) for x in seen[1])
    d1, d2, d3 = model.discounts[1]
    model.rest = (d1 * one + d2 * two + d3 * (n - one - two)) / model.pairs
    return model


def _probabilities(model: Model, numbers: np.ndarray, stats: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's probability after those before it; ``numbers`` and ``stats`` are those of the distinct words."""
    before, total, *kinds = stats.T
    d = model.discounts
    p = (np.maximum(before - _off(before, d[1]), 0) / max(1, model.pairs) + model.rest / (model.v + 1))[tokens]
    if not model.n:
        return p
    left = np.stack(kinds, 1) @ np.array(d[2])
    at = _before(tokens, sizes, len(numbers) - 2)
    a, b, c = numbers[_before(at, sizes, len(numbers) - 2)], numbers[at], numbers[tokens]
    shard, pair, hot = model.shard(a, b, c), _joint(b, c), model.is_hot(b)
    known = (b >= 0) & (c >= 0)
    times = np.zeros(len(c), np.int64)
    plain, other = np.flatnonzero(known & ~(hot & (model.order == 3))), np.flatnonzero(known & hot & (model.order == 3))
    times[plain] = model.rows("pair", pair[plain], shard[plain], 1)[:, 0]
    times[other] = model.rows("hot", pair[other], (pair[other] % np.uint64(model.hot_shards)).astype(np.int64), 1)[:, 0]
    whole = total[at]
    p = np.where(whole > 0, (np.maximum(times - _off(times, d[2]), 0) + left[at] * p) / np.maximum(whole, 1), p)
    if model.order == 2:
        return p
    met = np.flatnonzero((a >= 0) & (b >= 0))
    whole, *kinds = model.rows("context", _joint(a[met], b[met]), shard[met], 4).T
    left = np.stack(kinds, 1) @ np.array(d[3])
    own = np.flatnonzero((whole > 0) & (times[met] > 0))  # else the triple was not in training
    times = np.zeros(len(met), np.int64)
    times[own] = model.rows("triple", _joint(pair[met[own]].view(np.int64), a[met[own]]), shard[met[own]], 1)[:, 0]
    p[met] = np.where(whole > 0, (np.maximum(times - _off(times, d[3]), 0) + left * p[met]) / np.maximum(whole, 1), p[met])
    return p


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(batches):
        own = shared.value
        for batch in slices(batches, "text"):
            keys, tokens, sizes = _words(batch, own.lower)
            order = np.argsort(keys)
            back = np.argsort(order)
            number, count, stats = (x[back] for x in own.look_up(keys[order], "count", "stats")) if own.n else (np.full(len(keys), -1), np.zeros((len(keys), 1), np.int64), np.zeros((len(keys), 5), np.int64))
            starts = np.cumsum(sizes) - sizes
            base = np.log10((count[:, 0] + 0.1) / (own.n + 0.1 * (own.v + 1)))[tokens]
            known = (count[tokens, 0] > 0).astype(np.int64)
            scores = np.add.reduceat(np.log10(_probabilities(own, number, stats, tokens, sizes)), starts)
            yield batch_of(
                schema,
                batch["doc_id"].cast(pa.int64()),
                [not in_training(d) for d in batch["doc_id"].to_pylist()],
                sizes,
                np.add.reduceat(known, starts),
                np.full(len(sizes), own.n),
                np.add.reduceat(base, starts),
                scores,
                10 ** np.minimum(-scores / sizes, 300),
            )

    source = df.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
