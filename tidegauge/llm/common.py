"""What the operators share: the cluster's shared folder, files in it, and word hashing on Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession


BATCH_ROWS = 2_000
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library, which has nothing to trim
    _LIBC = None
PRIME = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _local_dir(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='shared-')}"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which driver and executors share.

    Only a local session (tests) may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_dir(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its executor hold at once: ``BATCH_ROWS`` rows an Arrow batch, where the session
    has not chosen a number itself. Results are lazy, so the setting stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_folder = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these frames; nothing may read them afterwards."""
    for frame in frames:
        remove(frame.sparkSession, frame.cut_folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _where(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_file(uri: str, parts: list) -> None:
    """Write buffers as one file that appears whole or not at all; a retried task writes the same bytes again."""
    fs, path = _where(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            if len(part):
                out.write(part if isinstance(part, bytes) else memoryview(part).cast("B"))
    fs.move(temporary, path)
    give_back()


def map_file(uri: str, dtype) -> np.ndarray:
    """A file of the shared folder as a read-only array: memory-mapped where the store is a mounted file
    system, else read through the store's client."""
    fs, path = _where(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), dtype=dtype)


class WordHashes(dict):
    """Word (bytes) -> signed 64-bit hash, remembered up to ``most`` words so that memory stays bounded."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(self) < self.most:
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, each word's number among them, words of each text): texts split at ASCII white space; null is empty."""
    lists = pa.compute.ascii_split_whitespace(texts.fill_null(""))
    coded = pa.compute.dictionary_encode(lists.flatten())
    which, bounds = np.asarray(coded.indices), np.diff(np.asarray(lists.offsets))
    blank = pa.compute.index(coded.dictionary, "").as_py()
    if blank < 0:
        return coded.dictionary, which, bounds.astype(np.int64)
    own = which != blank  # before leading and after trailing white space
    words = pa.concat_arrays([coded.dictionary[:blank], coded.dictionary[blank + 1 :]])
    return words, (which - (which > blank))[own], np.bincount(np.repeat(np.arange(len(bounds)), bounds)[own], minlength=len(bounds))


LANES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # masks of 0 to 8 bytes
LONG_WORD = 4096


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes (unsigned) of words, mixed 8 bytes at a time, all words side by side."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)]), 8)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    out, at = mix(sizes), 0
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    while len(live):
        lane = lanes[starts[live] + at].copy().view("<u8").ravel() & LANES[np.minimum(sizes[live] - at, 8)]
        out[live] = mix((out[live] ^ lane) * PRIME)
        at += 8
        live = live[sizes[live] > at]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(words[k].as_py().encode())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches, column: str, most_bytes: int = 8 << 20):
    """Arrow batches cut so that one holds about ``most_bytes`` of ``column``, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0)).astype(np.int64)
        part = np.cumsum(sizes) // most_bytes
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Give memory that Arrow and the C library keep for later back to the system: a worker lives on after its task, and
    beside the other workers and the heap of its executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


