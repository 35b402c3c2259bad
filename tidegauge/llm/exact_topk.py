"""Exact top-k by inner product over a bit-sliced index.

A component becomes floor(256 * x). An index block holds, for each component, one bitmap over the block's rows for each
bit of the (two's complement) value. A query's score of all rows of a block is a weighted sum of these bitmaps: each
component of the query is written in signed binary digits, a digit adds the component's bitmaps at its weight, a
negative one their complements and a constant. The bitmaps of a weight are added by carry-save adders: three of one
weight become one of it and one of the next. What is left is one bitmap a weight, the bit-sliced scores.

The best k rows are selected from the most significant slice downward: rows that have the bit are taken where they
are at most k, else they are what remains to choose from. Rows left at the last slice have equal scores; of these
boundary rows the smallest ids fill up the k. Values of the chosen rows are read off the slices, so scores are exact.

Tiles (the queries of some blocks against a run of blocks) are tasks; each gives k rows a query at most, and a window
over these picks the k best. Every row is indexed and every query asks every block.

Edge cases: rows with a null id, a null vector or one with null or non-finite components take no part; vectors of
another length are not compared; empty vectors score 0; rows that repeat are rows of their own, and a query leaves out its own row alone; a query with
fewer other rows gets all of them; an empty table gives no rows. Only the id and vector columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import batch_of, cut, small_batches
from tidegauge.llm.vector_blocks import BLOCK, Asked, Best, Block, Blocks, asked, quantised

BATCH = 16  # queries scored side by side


def sliced(x: np.ndarray) -> list[np.ndarray]:
    """[bits, words], then the bitmaps: component by component, bit by bit from the lowest; the last one is the sign's."""
    n, size = x.shape
    bits = max(int(v).bit_length() for v in (x.max(initial=0), -x.min(initial=0) - 1, 0)) + 1
    words = -(-n // 64)
    padded = np.zeros((size, bits, words * 64), np.uint8)
    for b in range(bits):
        padded[:, b, :n] = (x.T >> b) & 1
    maps = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)
    return [np.array([bits, words], np.int64), maps.reshape(size * bits, words).view(np.int64)]


def digits(value: int) -> list[tuple[int, int]]:
    """(place, +1 or -1): signed binary digits of a number, no two of them side by side."""
    out, place = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((place, digit))
            value -= digit
        value >>= 1
        place += 1
    return out


def _terms(query: np.ndarray, bits: int) -> tuple[list[list[int]], int]:
    """For each weight, the numbers of the bitmaps to add (those from size * bits on are complements), and the constant."""
    of: list[list[int]] = []
    constant, half = 0, len(query) * bits
    for component, value in enumerate(query.tolist()):
        for place, digit in digits(value):
            for b in range(bits):
                sign = -digit if b == bits - 1 else digit  # the sign's bitmap counts negative
                while len(of) <= place + b:
                    of.append([])
                of[place + b].append(component * bits + b + (0 if sign > 0 else half))
                constant -= 0 if sign > 0 else 1 << (place + b)
    return of, constant


def prepared(queries: np.ndarray, bits: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each ``BATCH`` of queries: for each weight the numbers of the bitmaps that each adds (filled up with that of the empty
    one), and the constants. The same for all blocks whose values take ``bits`` bits."""
    out = []
    for start in range(0, len(queries), BATCH):
        told = [_terms(q, bits) for q in queries[start : start + BATCH]]
        numbers = []
        for weight in range(max(len(of) for of, _ in told)):
            own = [of[weight] if weight < len(of) else [] for of, _ in told]
            which = np.full((max(map(len, own)), len(told)), 2 * queries.shape[1] * bits)
            for k, terms in enumerate(own):
                which[: len(terms), k] = terms
            numbers.append(which)
        out.append((numbers, np.array([c for _, c in told], object)))
    return out


def added(maps: np.ndarray, numbers: list[np.ndarray], n: int) -> np.ndarray:
    """(weights, queries, words): the bit-sliced scores of all rows for each of n queries, less its constant.

    ``maps`` has the bitmaps, then their complements, then an empty one; ``numbers`` is of ``prepared``.
    """
    # piles are (bitmaps, queries, words): what is added side by side lies side by side
    out, carried, weight = [], np.zeros((0, n, maps.shape[1]), np.uint64), 0
    while weight < len(numbers) or len(carried):
        pile = carried
        if weight < len(numbers) and len(numbers[weight]):
            pile = np.concatenate([maps[numbers[weight]], carried])
        up = []
        while len(pile) > 2:
            k = len(pile) // 3
            a, b, c, rest = pile[:k], pile[k : 2 * k], pile[2 * k : 3 * k], pile[3 * k :]
            odd = a ^ b
            carry = a & b
            pile = np.concatenate([odd ^ c, rest]) if len(rest) else odd ^ c
            odd &= c
            carry |= odd
            up.append(carry)
        if len(pile) == 2:
            up.append(pile[:1] & pile[1:])
            pile = pile[:1] ^ pile[1:]
        out.append(pile[0] if len(pile) else np.zeros((n, maps.shape[1]), np.uint64))
        carried = np.concatenate(up) if up else carried[:0]
        weight += 1
    return np.stack(out) if out else np.zeros((1, n, maps.shape[1]), np.uint64)


def selected(slices: np.ndarray, live: np.ndarray, k: int) -> np.ndarray:
    """(queries, words): bitmaps of the k best rows (all, if fewer); of equal ones at the boundary those that come first."""
    sure, open_ = np.zeros_like(live), live.copy()
    for bitmap in slices[::-1]:
        hit = sure | (open_ & bitmap)
        few = (np.bitwise_count(hit).sum(1) <= k)[:, None]
        # up to k rows have the bit: they are in, and the others stay open; else only those with it stay open
        sure, open_ = np.where(few, hit, sure), np.where(few, open_ & ~bitmap, open_ & bitmap)
    need = k - np.bitwise_count(sure).sum(1, dtype=np.int64)
    rows = np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little")
    rows &= np.cumsum(rows, 1, dtype=np.int32) <= need[:, None]
    return sure | np.packbits(rows, axis=1, bitorder="little").view(np.uint64)


def best(block: Block, asking: Asked, k: int, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of a block, a query's own row left out. ``known`` keeps what was
    prepared for the queries by the bits of the blocks so far."""
    bits, words = block.rest[:2].tolist()
    bitmaps = block.rest[2:].reshape(block.size * bits, words).view(np.uint64)
    maps = np.concatenate([bitmaps, ~bitmaps, np.zeros((1, words), np.uint64)])
    live = np.repeat(np.packbits(np.arange(words * 64) < len(block.ids), bitorder="little").view(np.uint64)[None], len(asking.ids), 0)
    own, at = asking.own(block.name)
    live[own, at // 64] &= ~(np.uint64(1) << (at % 64).astype(np.uint64))
    if bits not in known:
        known[bits] = prepared(asking.queries, bits)
    found = []
    for start, (numbers, constants) in zip(range(0, len(asking.ids), BATCH), known[bits], strict=True):
        slices = added(maps, numbers, len(constants))
        chosen = np.unpackbits(selected(slices, live[start : start + BATCH], k).view(np.uint8), axis=1, bitorder="little")
        q, row = np.nonzero(chosen)
        picked = (slices[:, q, row // 64] >> (row % 64).astype(np.uint64)) & np.uint64(1)
        total = sum((bit.astype(np.int64) << weight for weight, bit in enumerate(picked)), np.zeros(len(q), np.int64))
        found.append((q + start, row, total + constants.astype(np.int64)[q]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def top(df: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for each row whose id ``every`` divides."""
    small_batches(df.sparkSession)
    blocks = Blocks(quantised(df, id_col, vector_col, scale=scale), every, sliced, block)
    folder = blocks.folder
    schema = pa.schema([("ask", pa.int64()), ("number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for ask, asks, others in zip(*(batch[c].to_pylist() for c in ("ask", "asks", "others")), strict=True):
                asking = asked(folder, asks)
                kept, known = {size: Best(len(own.ids), k) for size, own in asking.items()}, {size: {} for size in asking}
                for name in others:
                    block = Block(folder, name)
                    if block.size in asking:
                        q, row, score = best(block, asking[block.size], k, known[block.size])
                        kept[block.size].add(q, score, block.ids[row])
                for size, own in asking.items():
                    out = kept[size]
                    yield batch_of(schema, np.full(len(out.keys), ask), own.numbers[out.keys], own.ids[out.keys], out.ids, out.scores)

    found = blocks.tiles().mapInArrow(run, "ask long, number long, query_id long, vec_id long, score long")
    line = Window.partitionBy("ask", "number").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", F.row_number().over(line).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    out = cut(ranked, "top")
    blocks.drop()
    return out


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
