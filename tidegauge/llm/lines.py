"""Line dedup: two Bloom filters, one of line hashes seen once and one of those seen again.

Every task fills both filters from the distinct lines of its documents. Filters of tasks merge block by block:
once = or, again = or of the parts' agains and of every pair of onces, so a line that two tasks hold is in "again".
Only lines whose hash "again" holds are shuffled, where their documents are counted exactly by the line itself and
the first occurrence is found. The second filter grows with the number of lines; it lies in the shared folder, in files
of a bounded number of blocks, which tasks map whatever its size. Lines to drop lie there too, dealt by hash into files of about
``FILE_BYTES``: sorted hashes, then the lines themselves, which a found hash is held against. Tasks map them, so
whatever their number, a document's text is read where it lies and never shuffled.

Edge cases: a null or empty text is one empty line; the empty key never counts; equal documents with other ids count
each; rows that share an id count as one document of it; rows with a null id count as one document. Extra columns pass
through; ``n_lines``, ``n_dropped`` and ``kept_text`` replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import batch_of, cut, drop, map_file, remove, shared_dir, slices, small_batches, strings, write_file

SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BITS = 1 << 15
BLOCK_BYTES = BLOCK_BITS // 8
BITS_A_LINE, PROBES = 12, 4
FILE_BLOCKS = 4096
FILE_BYTES = 16 << 20


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _hash(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _probes(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's block and its bits within the block: all probes of a line stay in one block."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    step = (hashes & np.uint64(0xFFFFF)) | np.uint64(1)
    bits = [(((hashes >> np.uint64(20)) + np.uint64(k) * step) % np.uint64(BLOCK_BITS)).astype(np.int64) for k in range(PROBES)]
    return block.astype(np.int64), np.stack(bits, 1) if len(hashes) else np.empty((0, PROBES), np.int64)


def _pack(positions: np.ndarray) -> bytes:
    """Bits of a block: their 16-bit positions while that is shorter than the bit map."""
    if 2 * len(positions) < BLOCK_BITS // 8:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_BITS, bool)
    bits[positions] = True
    return np.packbits(bits).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    """The bit map of what ``_pack`` gave."""
    if len(packed) == BLOCK_BITS // 8:
        return np.frombuffer(packed, np.uint8)
    bits = np.zeros(BLOCK_BITS, bool)
    bits[np.frombuffer(packed, "<u2")] = True
    return np.packbits(bits)


def _lines(text: str) -> list[bytes]:
    return text.encode().split(b"\n")


def build_filter(df: DataFrame, blocks: int, folder: str) -> None:
    """Write the merged second filter of ``df`` (text) to ``folder``, FILE_BLOCKS blocks a file."""
    schema = pa.schema([("block", pa.int64()), ("once", pa.binary()), ("again", pa.binary())])

    def fill(batches):
        found = []
        for batch in slices(batches, "text"):
            for text in strings(batch["text"]):
                found.append(_hash(list({k for k in map(key_of, _lines(text)) if k})))
        hashes, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, int))
        if not len(hashes):
            return
        block, bits = _probes(hashes, blocks)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1))
        rows = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            twice = own[times[own] > 1]
            rows.append((int(block[own[0]]), _pack(np.unique(bits[own])), _pack(np.unique(bits[twice]))))
            if len(rows) == 512:
                yield batch_of(schema, *(list(x) for x in zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch_of(schema, *(list(x) for x in zip(*rows, strict=True)))

    written = pa.schema([("file", pa.int32())])

    def merge(batches):
        file, at, table = None, None, None
        for batch in batches:
            for key, x, y in zip(*(batch[c].to_pylist() for c in ("block", "once", "again")), strict=True):
                if key // FILE_BLOCKS != file:
                    if file is not None:
                        write_file(_file(folder, file), [table])
                        yield batch_of(written, [file])
                    file, table = key // FILE_BLOCKS, np.zeros((min(FILE_BLOCKS, blocks - key // FILE_BLOCKS * FILE_BLOCKS), BLOCK_BYTES), np.uint8)
                if key != at:
                    at, once = key, np.zeros(BLOCK_BYTES, np.uint8)
                again, bits = table[key % FILE_BLOCKS], _unpack(x)
                again |= (once & bits) | _unpack(y)
                once |= bits
        if file is not None:
            write_file(_file(folder, file), [table])
            yield batch_of(written, [file])

    parts = df.select("text").mapInArrow(fill, "block long, once binary, again binary").withColumn("file", F.expr(f"cast(block div {FILE_BLOCKS} as int)"))
    parts.repartition("file").sortWithinPartitions("block").mapInArrow(merge, "file int").count()


def _file(folder: str, file: int) -> str:
    return f"{folder}/again-{file:06d}.bin"


def _held(hashes: np.ndarray, blocks: int, folder: str) -> np.ndarray:
    """Which line hashes the second filter holds; its files are mapped while they are read."""
    block, bits = _probes(hashes, blocks)
    out, file = np.zeros(len(hashes), bool), block // FILE_BLOCKS
    order = np.argsort(file, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
        if len(own):
            try:
                again = map_file(_file(folder, int(file[own[0]])), np.uint8).reshape(-1, BLOCK_BYTES)
            except FileNotFoundError:  # no line fell there
                continue
            at = bits[own]
            out[own] = ((again[(block[own] % FILE_BLOCKS)[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
    return out


def suspects(df: DataFrame, blocks: int, folder: str) -> DataFrame:
    """(key, doc_id, first_line): a row for each document and distinct line that the second filter holds."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("first_line", pa.int64())])

    def probe(batches):
        for batch in slices(batches, "text"):
            keys, docs, at = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), strings(batch["text"]), strict=True):
                own: dict[bytes, int] = {}
                for n, k in enumerate(map(key_of, _lines(text))):
                    if k:
                        own.setdefault(k, n)
                keys += own
                docs += [doc] * len(own)
                at += own.values()
            keep = np.flatnonzero(_held(_hash(keys), blocks, folder)).tolist()
            yield batch_of(schema, [keys[k] for k in keep], [docs[k] for k in keep], [at[k] for k in keep])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(probe, "key binary, doc_id long, first_line long")


def found(df: DataFrame) -> DataFrame:
    """(key, doc_id, first_line) of all suspected repeats, written to the shared folder; the filter goes."""
    spark = df.sparkSession
    small_batches(spark)
    n = df.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    blocks, folder = max(1, -(-n * BITS_A_LINE // BLOCK_BITS)), shared_dir(spark, "line-filter")
    build_filter(df, blocks, folder)
    # a document's own copy of a line counts once, also where rows share an id
    out = cut(suspects(df, blocks, folder).groupBy("key", "doc_id").agg(F.min("first_line").alias("first_line")), "suspects")
    remove(spark, folder)
    return out


def repeated(suspected: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs, first_doc, first_line): lines found in at least ``min_docs`` documents, counted exactly."""
    rows = suspected.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "first_line")).alias("first")).where(F.col("n_docs") >= min_docs)
    return rows.select("key", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.first_line").alias("first_line"))


def write_lost(hot: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> int:
    """Write the lines of ``hot`` (key, first_doc, first_line) as files by hash; how many there may be."""
    size = hot.select(F.sum(F.length("key") + 40)).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    hashed = pa.schema([("file", pa.int32()), ("hash", pa.int64()), ("key", pa.binary()), ("first_doc", pa.int64()), ("first_line", pa.int64())])

    def deal(batches):
        for batch in slices(batches, "key"):
            own = _hash(batch["key"].to_pylist())
            yield batch_of(hashed, _lost_file(own, files), own.view(np.int64), batch["key"], batch["first_doc"], batch["first_line"])

    def put(tables):
        own = pa.concat_tables(tables).combine_chunks()
        key, doc = own["key"].combine_chunks(), own["first_doc"].combine_chunks()
        ends = np.cumsum([0, *map(len, key.to_pylist())]).astype(np.int64)
        columns = [np.array([len(own)], np.int64), own["hash"].to_numpy(), np.asarray(doc.fill_null(0)), np.asarray(doc.is_valid()).astype(np.int64), own["first_line"].to_numpy(), ends]
        write_file(f"{folder}/lost-{own['file'][0].as_py():06d}.bin", [*columns, b"".join(key.to_pylist())])

    def write(batches):
        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            file = table["file"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if held and held[0]["file"][0] != table["file"][a]:
                        put(held)
                        yield batch_of(written, [held[0]["file"][0].as_py()])
                        held = []
                    held.append(table.slice(a, b - a))
        if held:
            put(held)
            yield batch_of(written, [held[0]["file"][0].as_py()])

    written = pa.schema([("file", pa.int32())])
    dealt = hot.select("key", "first_doc", "first_line").mapInArrow(deal, "file int, hash long, key binary, first_doc long, first_line long")
    dealt.repartition("file").sortWithinPartitions("file", "hash", "key").mapInArrow(write, "file int").count()
    return files


def _lost_file(hashes: np.ndarray, files: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(files)).astype(np.int32)


def lost(keys: list[bytes], folder: str, files: int) -> dict[bytes, tuple[int | None, int]]:
    """Of distinct keys, those of lines to drop with the first occurrence's doc_id and line."""
    out: dict[bytes, tuple[int | None, int]] = {}
    hashes = _hash(keys)
    file, signed = _lost_file(hashes, files), hashes.view(np.int64)
    order = np.argsort(file, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(file[order])) + 1):
        if not len(own):
            continue
        try:
            flat = map_file(f"{folder}/lost-{int(file[own[0]]):06d}.bin", np.uint8)
        except FileNotFoundError:  # no line fell there
            continue
        n = int(flat[:8].view(np.int64)[0])
        numbers, text = flat[8 : 8 * (5 * n + 2)].view(np.int64), flat[8 * (5 * n + 2) :]
        known, docs, has, lines, ends = numbers[:n], numbers[n : 2 * n], numbers[2 * n : 3 * n], numbers[3 * n : 4 * n], numbers[4 * n :]
        first, last = np.searchsorted(known, signed[own], "left"), np.searchsorted(known, signed[own], "right")
        for k in np.flatnonzero(last > first).tolist():
            key = keys[own[k]]
            for at in range(first[k], last[k]):  # more than one only where hashes of lines are equal
                if text[ends[at] : ends[at + 1]].tobytes() == key:
                    out[key] = (int(docs[at]) if has[at] else None, int(lines[at]))
    return out


def dedup(df: DataFrame, min_docs: int = 10, keep_first: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """All columns of ``df`` and ``n_lines``, ``n_dropped``, ``kept_text``.

    Lines found in at least ``min_docs`` documents go; with ``keep_first`` the first one stays, by doc_id and line. The files
    of lines to drop stay in the shared folder, as the result reads them.
    """
    source = df.drop("n_lines", "n_dropped", "kept_text")
    suspected = found(source)
    hot = cut(repeated(suspected, min_docs), "repeated-lines")
    folder = shared_dir(df.sparkSession, "lost-lines")
    files = write_lost(hot, folder, file_bytes)
    drop(suspected, hot)
    fields = [*source.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]

    def run(batches):
        for batch in slices(batches, "text"):
            texts = [_lines(x) for x in strings(batch["text"])]
            keys = [[key_of(x) for x in own] for own in texts]
            gone = lost(list({k for own in keys for k in own if k}), folder, files)
            kept = []
            for doc, own, of in zip(batch["doc_id"].to_pylist(), texts, keys, strict=True):
                kept.append([x for n, (x, k) in enumerate(zip(own, of, strict=True)) if k not in gone or (keep_first and gone[k] == (doc, n))])
            columns = [pa.array(map(len, texts), pa.int64()), pa.array([len(a) - len(b) for a, b in zip(texts, kept, strict=True)], pa.int64()), pa.array([b"\n".join(x).decode() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n_lines", "n_dropped", "kept_text"])

    return source.mapInArrow(run, T.StructType(fields))


def digests(df: DataFrame, min_docs: int) -> DataFrame:
    out = dedup(df, min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_number() OVER () AS r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
