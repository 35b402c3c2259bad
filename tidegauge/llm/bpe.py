"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives one token's bytes a line. The library works on characters, so every byte is named by a
printable character (the usual byte table); decoding reverses that table. Texts are cut where no match of the
pre-split pattern can span (before blanks that follow a non-blank), and what the library answers for a piece is
remembered, because most words of a corpus repeat; a text that holds other white space goes to the library whole.

Edge cases: a null text is empty and gives no tokens; null ids decode to null; ids are unsigned and a
token may hold part of a character, which ``offsets`` gives the span of the whole character and ``decode_text``
joins again before it is read as UTF-8. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidegauge.llm.common import batch_of, slices, small_batches, strings

#: Pieces: blanks and line feeds, then what follows up to the next of them.
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space beside these two would let a match span two pieces.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")
REMEMBERED = 250_000


def byte_table() -> list[str]:
    """Byte -> character: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks, table = read_ranks(ranks_path), byte_table()
        named = {token: "".join(map(table.__getitem__, token)) for token in ranks}
        merges = [
            (named[token[:i]], named[token[i:]])
            for token, rank in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if ranks.get(token[:i], rank) < rank and ranks.get(token[i:], rank) < rank
        ]
        self.library = Tokenizer(models.BPE({named[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(table)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for name, rank in self.library.get_vocab().items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, name))
        self.pieces: dict[str, bytes] = {}

    def __missing(self, piece: str) -> bytes:
        ids = np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.pieces) < REMEMBERED:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if OTHER_SPACE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.pieces
        return b"".join([known[p] if p in known else self.__missing(p) for p in PIECES.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point of each token; parts of one character all give its span."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = np.array([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        ends = np.cumsum(sizes)
        return (char[ends - sizes], char[ends - 1] + 1) if len(ends) else (ends, ends)

    def decode_text(self, ids: bytes) -> list[str]:
        """Text of each token in turn; a character that tokens split comes out with its last part."""
        held, out = b"", []
        for i in np.frombuffer(ids, "<u4").tolist():
            held += self.bytes_of[i]
            try:
                out.append(held.decode())
                held = b""
            except UnicodeDecodeError:
                out.append("")
        if held and out:
            out[-1] += held.decode(errors="replace")
        return out


@lru_cache(2)
def coder(ranks_path: str, pattern: str) -> Coder:
    """One coder a worker; what it remembers serves the worker's later tasks too."""
    return Coder(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """id, ``ids`` (binary: little-endian unsigned 32-bit) and, on request, ``starts`` and ``ends`` (code points) and
    ``decoded`` (binary), what the ids decode to: a round trip in the worker that has the coder already."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    spans = [("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))] if offsets else []
    spans += [("decoded", pa.binary())] if decoded else []

    def run(batches):
        own = coder(ranks_path, pattern)
        for batch in slices(batches, "text"):
            texts = strings(batch["text"])
            ids = [own.encode(x) for x in texts]
            schema = pa.schema([("id", batch["id"].type), ("ids", pa.binary()), *spans])
            pairs = [own.offsets(x, y) for x, y in zip(texts, ids, strict=True)] if offsets else []
            yield batch_of(schema, batch["id"], ids, *([[p[k] for p in pairs] for k in (0, 1)] if offsets else []), *([list(map(own.decode, ids))] if decoded else []))

    out = source.mapInArrow(run, f"id {kind}, ids binary" + ", starts array<bigint>, ends array<bigint>" * offsets + ", decoded binary" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` but ``decoded``, and ``decoded`` (binary) made from ``ids_col``."""
    small_batches(df.sparkSession)
    source = df.drop("decoded")

    def run(batches):
        own = coder(ranks_path, pattern)
        for batch in batches:
            decoded = [None if x is None else own.decode(x) for x in batch[ids_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: ids and what they decode to."""
    coded = encode(df, ranks_path, pattern, decoded=True)
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
