"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a bounded run of document words, numbered within it. The shard's suffixes are sorted by prefix doubling; the Burrows-Wheeler transform goes into a wavelet matrix,
whose ranks drive a backward search of many test phrases at once. Rows of the found intervals walk back to sampled
suffix positions, which gives the places; phrase spans merge to hit words and removal spans.

A phrase is a window of ``WINDOW`` consecutive item words; an item of fewer words, but not none, is one phrase.
Tasks write the benchmark to files of about ``FILE_BYTES`` of text in the shared folder: hashes of its words in turn, and
where each phrase begins. A task maps them one after the other against the shard that it has indexed; phrases with a word that the shard has not are
left out before the search. So the corpus is read once and nothing but names of files goes through the driver, whatever the benchmark's size.
Words are told apart by 64-bit hashes: a word of the benchmark and one of a shard are taken for one at a chance of 2 ** -64.

Edge cases: null texts have no words; rows with equal ids are searched each on its own; a document longer than a shard
is cut into overlapping segments; items without words match nothing; words of items with a null id are hit, but such an
item has no id to list; an empty benchmark leaves every document clean. Extra columns pass through in ``clean``; ``spans`` holds code points of the original text.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import batch_of, hash_words, map_file, shared_dir, slices, small_batches, split_words, strings, write_file

WINDOW = 10
SHARD_BITS = 19
SAMPLE = 16
FILE_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
AT_ONCE = 1 << 17  # phrases searched side by side
#: Bytes of words as they are, after A-Z became a-z; all other ASCII separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Order of keys below 2 ** bits; ties in any order. Sorting keys with their places in the low bits is faster
    than sorting places by keys, where both fit into 63 bits."""
    low = max(1, (len(key) - 1).bit_length())
    if bits + low > 63:
        return np.argsort(key)
    return np.sort((key << low) | np.arange(len(key))) & ((1 << low) - 1)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; ``ranks``: non-negative, and the last one occurs once.

    Prefix doubling: the first pass packs several symbols to a key; later passes sort only what is still tied.
    """
    n = len(ranks)
    width = max(1, int(ranks.max()).bit_length())
    bits = max(1, (n - 1).bit_length())
    depth = max(1, (63 - bits) // width)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= width
        if k < n:
            key[: n - k] += ranks[k:]
    order = _order(key, depth * width)
    sorted_key = key[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    start = np.flatnonzero(new)
    head = np.repeat(start, np.diff(np.append(start, n)))  # a group's rank: its first row
    rank = np.empty(n, np.int64)
    rank[order] = head
    rows = np.flatnonzero(np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n))))
    while len(rows):
        at = order[rows]
        after = at + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[at] << (bits + 1)) | follow
        own = _order(key, 2 * bits + 1)
        at, key = at[own], key[own]
        order[rows] = at
        new = np.empty(len(rows), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(rows)))
        rank[at] = np.repeat(rows[start], sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit vector a level, each with counts a 64-bit word."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.counts, self.zeros = len(symbols), levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            one = bit.astype(bool)
            low, high = symbols[~one], symbols[one]
            self.zeros.append(len(low))
            symbols = np.concatenate([low, high])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Times that each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each place, and its rank there."""
        low, place, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for k in range(self.levels):
            one = (self.bits[k][place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            one = one.astype(bool)
            a, b = self._ones(k, low), self._ones(k, place)
            low = np.where(one, self.zeros[k] + a, low - a)
            place = np.where(one, self.zeros[k] + b, place - b)
            symbol = symbol * 2 + one
        return symbol, place - low


class FMIndex:
    """Index of one shard. ``symbols``: 0 ends a segment, the others are its words."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        ends = symbols == 0
        n_ends = int(ends.sum())
        ranks = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends)  # every end differs from the others
        order = suffix_array(ranks)
        bwt = symbols[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(bwt.astype(np.int32), max(1, (n_symbols - 1).bit_length()))
        # sampled: every SAMPLE-th position and every one after an end, so that no walk goes through an end
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase. Phrases are padded on the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.wavelet.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < lengths) & (low < high))
            if not len(on):
                continue
            c = phrases[on, k].astype(np.int64)
            low[on], high[on] = self.first[c] + self.wavelet.rank(c, low[on]), self.first[c] + self.wavelet.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        steps, todo, at = 0, np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            hit = self.sampled[at]
            out[todo[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c, rank = self.wavelet.access(at)
                at = self.first[c] + rank
                steps += 1
        return out


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, each word's number among them, words of each text)."""
    plain = pa.array([x.encode().translate(WORD_BYTES).decode() for x in texts], pa.large_string() if sum(map(len, texts)) >= 1 << 29 else pa.string())
    words, which, sizes = split_words(plain)
    return hash_words(words), which, sizes


def write_phrases(benchmark: DataFrame, folder: str, window: int = WINDOW, file_bytes: int = FILE_BYTES) -> list[str]:
    """Write the phrases of a benchmark (item_id, text) to files; their names."""
    schema = pa.schema([("name", pa.string())])

    def write(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", file_bytes):
            hashes, which, sizes = coded(strings(batch["text"]))
            own = np.flatnonzero(sizes)
            if not len(own):
                continue
            starts = (np.cumsum(sizes) - sizes)[own]
            count = np.maximum(sizes[own] - window + 1, 1)
            at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
            lengths = np.repeat(np.minimum(sizes[own], window), count)
            ids = batch["item_id"].to_pylist()
            names = json.dumps([None if ids[k] is None else str(ids[k]) for k in own.tolist()]).encode()
            head = np.array([len(which), len(at)], np.int64)
            columns = [head, hashes[which], at.astype(np.int64), lengths.astype(np.int64), np.repeat(np.arange(len(own)), count).astype(np.int64)]
            write_file(f"{folder}/{part}-{n}", [*columns, names])
            yield batch_of(schema, [f"{part}-{n}"])
            n += 1

    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(write, "name string")
    return sorted(r["name"] for r in rows.toLocalIterator())  # a name for each file of FILE_BYTES


class PhraseFile:
    """A mapped file of phrases: word hashes in turn, and of each phrase where it begins, its length and its item."""

    def __init__(self, uri: str):
        flat = map_file(uri, np.uint8)
        words, phrases = flat[:16].view(np.int64).tolist()
        ends = np.cumsum([16, 8 * words, 8 * phrases, 8 * phrases, 8 * phrases])
        parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.words = parts[0].view(np.uint64)
        self.starts, self.lengths, self.item_of = (p.view(np.int64) for p in parts[1:])
        self._names = flat[ends[-1] :]

    def items(self) -> list[str | None]:
        """Ids of the items; None for one without."""
        return json.loads(self._names.tobytes())


class Shard:
    """Symbols of a run of documents (0 ends each), and their index."""

    def __init__(self, hashes: np.ndarray, symbols: np.ndarray):
        """``hashes``: sorted, of the words that symbols 1, 2, ... stand for."""
        self.hashes, self.n = hashes, len(symbols)
        self.index = FMIndex(symbols, len(hashes) + 1)

    def occurrences(self, phrases: PhraseFile, window: int):
        """(place, length, item) of every occurrence, block by block."""
        at = np.minimum(np.searchsorted(self.hashes, phrases.words), len(self.hashes) - 1)
        symbol = np.where(self.hashes[at] == phrases.words, at + 1, 0).astype(np.int32)
        missing = np.concatenate([[0], np.cumsum(symbol == 0)])
        alive = np.flatnonzero(missing[phrases.starts + phrases.lengths] == missing[phrases.starts])
        for k in range(0, len(alive), AT_ONCE):
            own = alive[k : k + AT_ONCE]
            starts, lengths = phrases.starts[own], phrases.lengths[own]
            table = symbol[np.minimum(starts[:, None] + np.arange(window), len(symbol) - 1)]
            low, high = self.index.search(table, lengths)
            count = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(own)), count)
            row = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            yield self.index.locate(row), lengths[which], phrases.item_of[own[which]]


def _runs(sizes: list[int], shard: int, window: int):
    """Pieces (document, first word, words) of each shard in turn: whole documents, or overlapping segments of long ones."""
    run, size = [], 0
    for k, n in enumerate(sizes):
        if n >= shard:
            for a in range(0, n, shard):
                yield [(k, a, min(n - a, shard + window - 1))]  # overlaps the next by what a phrase may reach over
        elif n:
            if run and size + n + 1 > shard:
                yield run
                run, size = [], 0
            run.append((k, 0, n))
            size += n + 1
    if run:
        yield run


def in_documents(texts: list[str], files: list[str], window: int = WINDOW, shard: int = 1 << SHARD_BITS) -> tuple[list[np.ndarray], list[set[str]]]:
    """For each text: mask of hit words, and ids of the items with an occurring phrase."""
    hashes, which, sizes = coded(texts)
    starts = np.cumsum(sizes) - sizes
    hit, items = np.zeros(len(which) + 1, np.int64), [set() for _ in texts]
    order = np.argsort(hashes)
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    known: dict[str, list[str | None]] = {}
    for run in _runs(sizes.tolist(), shard, window) if files else ():
        words = np.concatenate([rank[which[starts[k] + a : starts[k] + a + n]] for k, a, n in run])
        used, compact = np.unique(words, return_inverse=True)
        lengths = np.array([n for _, _, n in run])
        begins = np.cumsum(lengths + 1) - lengths - 1  # a piece's first place among the symbols
        symbols = np.zeros(int((lengths + 1).sum()), np.int32)
        symbols[np.arange(len(words)) + np.repeat(np.arange(len(run)), lengths)] = compact + 1
        source = np.array([starts[k] + a for k, a, _ in run])
        document = np.array([k for k, _, _ in run])
        built = Shard(hashes[order[used]], symbols)
        for name in files:
            file = PhraseFile(name)
            for place, length, item in built.occurrences(file, window):
                if not len(place):
                    continue
                piece = np.searchsorted(begins, place, "right") - 1
                first = source[piece] + place - begins[piece]
                hit += np.bincount(first, minlength=len(hit)) - np.bincount(first + length, minlength=len(hit))
                if name not in known:
                    known[name] = file.items()
                pairs = np.unique(np.stack([document[piece], item], 1), axis=0)
                for k, x in pairs.tolist():
                    if known[name][x] is not None:
                        items[k].add(known[name][x])
    mask = np.cumsum(hit[:-1]) > 0
    return [mask[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)], items


def _spans(text: str, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of runs of hit words, from the first word's start to the last one's end."""
    raw = text.encode()
    own = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    turn = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
    return [(int(char[starts[a]]), int(char[ends[b] - 1]) + 1) for a, b in zip(first, last, strict=True)]


def _searched(batches, files: list[str], window: int):
    """(batch, texts, masks, item sets) of every slice."""
    for batch in slices(batches, "text", SLICE_BYTES):
        texts = strings(batch["text"])
        yield batch, texts, *in_documents(texts, files, window)


def _files(df: DataFrame, benchmark: DataFrame, window: int) -> list[str]:
    """Where the benchmark's phrases lie; they stay in the shared folder, as results read them."""
    small_batches(df.sparkSession)
    folder = shared_dir(df.sparkSession, "phrases")
    return [f"{folder}/{name}" for name in write_phrases(benchmark, folder, window)]


def scan(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), spans (array of start, end in code points)."""
    files = _files(df, benchmark, window)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for batch, texts, masks, items in _searched(batches, files, window):
            spans = [_spans(t, m) if m.any() else [] for t, m in zip(texts, masks, strict=True)]
            yield batch_of(schema, batch["doc_id"], [len(m) for m in masks], [int(m.sum()) for m in masks], [sorted(x) for x in items], spans)

    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<bigint>>")


def clean(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``df`` with removal spans cut out of ``text``; all columns and rows stay."""
    files, at = _files(df, benchmark, window), df.columns.index("text")

    def run(batches):
        for batch, texts, masks, _ in _searched(batches, files, window):
            out = batch["text"].to_pylist()
            for k, (text, mask) in enumerate(zip(texts, masks, strict=True)):
                if mask.any():
                    done, parts = 0, []
                    for a, b in _spans(text, mask):
                        parts.append(text[done:a])
                        done = b
                    out[k] = "".join([*parts, text[done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, T.StructType(df.schema.fields))


def digests(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(df, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> tuple[int, int, str]:
    """n_words, n_hit, items_sha256 by comparing every place with every phrase; for tests on small tables."""
    own, hit, found = words_of(text or ""), set(), set()
    for item, other in items:
        words = words_of(other or "")
        for k in range(max(1, len(words) - window + 1) if words else 0):
            phrase = words[k : k + window]
            for a in range(len(own) - len(phrase) + 1):
                if own[a : a + len(phrase)] == phrase:
                    hit.update(range(a, a + len(phrase)))
                    found.update([] if item is None else [str(item)])
    return len(own), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
