"""Token ids as flat binary files with 64-bit document offsets.

Documents are ranged by id, into parts of bounded bytes; each range becomes one file of unsigned integers (16 bits where the vocabulary
allows, else 32) and one file of 64-bit offsets, both written whole or not at all, so a retried task replaces
nothing half written. A part's place in the whole is a prefix sum over the parts' totals. Readers map the files.

Blank-separated words are given to the tokenizers library once a slice at most; what it answers is remembered.
The tokenizer's own marks (its added tokens) in a text become their ids, as the library does by default.

Edge cases: a null or empty text has only the end id; rows with equal ids keep one order (by a hash of the text, then the text); null ids come
first; an empty table gives no files and no rows. Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegauge.llm.common import batch_of, cut, map_file, shared_dir, slices, small_batches, write_file

#: A word's letters and the ASCII marks that end it are encoded apart: the tokenizer always splits there.
STEM = r"([a-z])([!#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+(?: |$))"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; Spark runs the tasks side by side
REMEMBERED = 150_000
JOINED = 256
PART_BYTES = 256 << 20


class Words:
    """Distinct words and their ids: ``flat`` has the ids of all of them in turn, ``sizes`` how many each has."""

    def __init__(self, words: pa.Array, flat: np.ndarray, sizes: np.ndarray):
        self.words, self.flat, self.sizes = words, flat, sizes

    def __len__(self) -> int:
        return len(self.words)

    def __add__(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), np.concatenate([self.flat, other.flat]), np.concatenate([self.sizes, other.sizes]))

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers, in turn, and the places where each one's end."""
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[which], self.sizes[which]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def take(self, which: np.ndarray) -> Words:
        return Words(self.words.take(pa.array(which)), self.ids(which)[0], self.sizes[which])


class WordEncoder:
    """Ids of a lower-casing, white-space-dropping tokenizer with word ends.

    A slice of texts is split and its words are numbered by Arrow; a distinct word is looked up once, and the ids of
    all words are gathered by number. What the library answered is remembered in two generations: a word that is met
    again moves to the younger one, and the older one is dropped as a whole when the younger is full.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        with open(path) as source:
            suffix = json.load(source)["model"].get("end_of_word_suffix") or ""
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.marks = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.young = self.old = Words(pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64))

    def _one_by_one(self, texts: list[str]) -> tuple[list[int], list[int]]:
        coded = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [i for ids in coded for i in ids], list(map(len, coded))

    def _ask(self, words: pa.Array) -> Words:
        """The library's ids for words; those of letters only go many to a call, and split at word ends."""
        apart = pc.utf8_is_alpha(words) if self.joins else pa.array(np.zeros(len(words), bool))
        other, letters = words.filter(pc.invert(apart)), words.filter(apart)
        flat, sizes = self._one_by_one(other.to_pylist())
        flat, sizes = [np.array(flat, np.int32)], [np.array(sizes, np.int64)]
        edges = np.unique(np.append(np.arange(0, len(letters), JOINED), len(letters)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), letters), " ").to_pylist()
        for k, coded in enumerate(self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(coded.ids, np.int32)
            long = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(long) != edges[k + 1] - edges[k]:  # a letter that normalization splits: ask for each word
                ids, long = map(np.array, self._one_by_one(letters[edges[k] : edges[k + 1]].to_pylist()))
            flat.append(ids.astype(np.int32))
            sizes.append(long)
        return Words(pa.concat_arrays([other, letters]), np.concatenate(flat), np.concatenate(sizes))

    def _coded(self, words: pa.Array) -> Words:
        """Distinct words with their ids, in any order."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, self._ask(pa.array([], pa.string()))
        in_young = pc.index_in(words, self.young.words)
        first = np.asarray(in_young.drop_null())
        words = words.filter(in_young.is_null())
        in_old = pc.index_in(words, self.old.words)
        again = self.old.take(np.asarray(in_old.drop_null())) + self._ask(words.filter(in_old.is_null()))
        own = self.young.take(first) + again
        self.young += again
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each); texts with the tokenizer's own marks go to the library whole."""
        texts = texts.fill_null("")
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= np.asarray(pc.match_substring(texts, mark))
        plain = pc.if_else(pa.array(marked), "", texts) if marked.any() else texts
        plain = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(plain, STEM, r"\1 \2"), " ")
        words = pc.dictionary_encode(split.flatten())
        coded = self._coded(words.dictionary)
        place = np.asarray(pc.index_in(words.dictionary, coded.words))
        ids, ends = coded.ids(place[np.asarray(words.indices)])
        edges = np.asarray(split.offsets) - split.offsets[0].as_py()
        upto = np.concatenate([[0], ends])[edges]
        if not marked.any():
            return ids, np.diff(upto)
        own = np.split(ids, upto[1:-1])
        for k in np.flatnonzero(marked).tolist():
            own[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(own), np.array([len(x) for x in own], np.int64)


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _parts(source: DataFrame) -> int:
    """Parts of about PART_BYTES of text, and as many as the session shuffles into at least."""
    size = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def write(df: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Write every text's ids and the end id; return one row a part: part, n_docs, n_tokens, doc_base, token_base, folder, bits.

    ``tokens-N.bin`` has the ids, ``offsets-N.bin`` the 64-bit starts of the part's documents within that file and
    their total, ``docs-N.bin`` the document ids.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark, "tokens")
    bits = 16 if max(Tokenizer.from_file(tokenizer_path).get_vocab().values()) < 1 << 16 and end_id < 1 << 16 else 32
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or _parts(source)
    schema = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        own, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, sizes, docs = [], [], []
        for batch in slices(batches, "text"):
            coded, counts = own.encode(batch["text"])
            ids.append(np.insert(coded.astype(f"<u{bits // 8}"), np.cumsum(counts), end_id))
            sizes.append(counts + 1)
            docs.append(np.asarray(batch["id"].fill_null(-(1 << 63))))
        if docs:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            write_file(f"{folder}/tokens-{part:06d}.bin", ids)
            write_file(f"{folder}/offsets-{part:06d}.bin", [starts.astype("<i8")])
            write_file(f"{folder}/docs-{part:06d}.bin", [np.concatenate(docs).astype("<i8")])
            yield batch_of(schema, [part], [len(starts) - 1], [int(starts[-1])])

    # rows of one id may be many: a hash of the text parts them, and orders them
    order = ("id", F.xxhash64("text"), "text")
    ranged = source.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    totals = cut(ranged.mapInArrow(run, "part int, n_docs long, n_tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return totals.select(
        "*",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"),
        F.lit(folder).alias("folder"),
        F.lit(bits).alias("bits"),
    )


def read(parts: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit)."""
    spark = parts.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = lambda kind: f"{row['folder']}/{kind}-{row['part']:06d}.bin"  # noqa: B023, E731
                ids, starts, docs = map_file(name("tokens"), f"<u{row['bits'] // 8}"), map_file(name("offsets"), "<i8"), map_file(name("docs"), "<i8")
                at = starts.tolist()
                for a in range(0, len(docs), 10_000):
                    b = min(len(docs), a + 10_000)
                    sums = [zlib.crc32(ids[at[k] : at[k + 1]].astype("<u4").tobytes()) for k in range(a, b)]
                    own = pa.array(docs[a:b], mask=np.asarray(docs[a:b]) == -(1 << 63))
                    yield batch_of(schema, own, np.asarray(starts[a:b]) + row["token_base"], np.diff(starts[a : b + 1]), sums)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
