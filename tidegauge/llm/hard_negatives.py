"""Hard-negative mining: for each anchor and each of its best positives, the best rows of other labels in a score window.

A component becomes floor(256 * x). Anchor blocks meet candidate blocks as dense matrix products in float64, which are
exact while every partial sum stays below 2 ** 53; blocks whose lengths could pass that are multiplied as 64-bit
integers, and it is an error where these could overflow. A block of anchors reaches the tasks as a file of bounded size.

The first pass keeps, for each anchor, its ``positives`` best other rows of the same label; what a tile keeps merges with
what others keep, so a window over a few rows a tile gives the exact ones. A row for each ask (the anchors of at most 32
blocks) carries them into the second pass, which multiplies again and keeps, for each anchor and positive, the
``negatives`` best rows of other labels whose score s has low * p <= 100 * s <= high * p for the positive's score p;
these merge in the same way. Higher scores come first, ties by smaller id.

Edge cases: rows with a null id or label, a null vector or one with null or non-finite components take no part;
vectors of another length are not compared; rows that repeat are rows of their own, and an anchor leaves out its own
row alone; a positive of negative score has an empty window; anchors without positives, and positives without negatives,
have no rows; an empty table gives none. Only the id, vector and label are read, so other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import batch_of, cut, drop, small_batches
from tidegauge.llm.vector_blocks import BLOCK, Best, Block, Blocks, asked, quantised

MANY = 8  # cells of a key for each one that it keeps, above which a row's k-th best score bounds them first


def products(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products (long) of integer vectors."""
    most = max(1, anchors.shape[1]) * int(np.abs(anchors).max(initial=0)) * int(np.abs(x).max(initial=0))
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 56:
        raise ValueError("inner products may be too large for a long")
    return anchors @ x.T


def _add(best: Best, keys: np.ndarray, scores: np.ndarray, mask: np.ndarray, ids: np.ndarray) -> None:
    """Give ``best`` the cells of a matrix of scores (a row a key) that ``mask`` allows and that may still come in."""
    mask &= scores >= best.bar[keys][:, None]
    if scores.shape[1] > best.k and np.count_nonzero(mask) > MANY * best.k * len(keys):
        mask &= scores >= np.partition(np.where(mask, scores, np.iinfo(np.int64).min), -best.k, axis=1)[:, -best.k][:, None]
    q, c = np.nonzero(mask)
    best.add(keys[q], scores[q, c], ids[c])


def mine(
    df: DataFrame,
    every: int,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows whose id ``every`` divides."""
    small_batches(df.sparkSession)
    blocks = Blocks(quantised(df, id_col, vector_col, F.col("label") if label is None else label, scale), every, lambda x: [x], block)
    folder = blocks.folder
    first = pa.schema([("ask", pa.int64()), ("number", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def compared(asking, others):
        """(anchors, block, scores of its rows) for the blocks of a tile."""
        for name in others:
            block = Block(folder, name)
            if block.size in asking:
                anchors = asking[block.size]
                yield anchors, block, products(anchors.queries, block.rest.reshape(len(block.ids), block.size))

    def same(batches):
        for batch in batches:
            for ask, asks, others in zip(*(batch[c].to_pylist() for c in ("ask", "asks", "others")), strict=True):
                asking = asked(folder, asks)
                kept = {size: Best(len(own.ids), positives) for size, own in asking.items()}
                for anchors, block, scores in compared(asking, others):
                    mask = anchors.labels[:, None] == block.labels
                    mask[anchors.own(block.name)] = False
                    _add(kept[block.size], np.arange(len(mask)), scores, mask, block.ids)
                for size, own in asking.items():
                    out = kept[size]
                    yield batch_of(first, np.full(len(out.keys), ask), own.numbers[out.keys], out.ids, out.scores)

    line = Window.partitionBy("ask", "number").orderBy(F.desc("score"), "positive_id")
    found = blocks.tiles().select("ask", "asks", "others").mapInArrow(same, "ask long, number long, positive_id long, score long")
    ranked = found.withColumn("order", F.row_number().over(line)).where(F.col("order") <= positives)
    # at most ``positives`` entries for each anchor of an ask's blocks
    pairs = F.sort_array(F.collect_list(F.struct("number", "order", "positive_id", "score")))
    chosen = cut(ranked.groupBy("ask").agg(pairs.alias("pairs")), "positives")

    last = pa.schema([("ask", pa.int64()), ("number", pa.int64()), ("order", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def different(batches):
        for batch in batches:
            for ask, asks, others, pairs in zip(*(batch[c].to_pylist() for c in ("ask", "asks", "others", "pairs")), strict=True):
                asking = asked(folder, asks)
                number, order, positive, p = (np.array([x[f] for x in pairs], np.int64) for f in ("number", "order", "positive_id", "score"))
                lowest, highest = -((-low * p) // 100), (high * p) // 100
                best, ids = Best(len(p), negatives), np.zeros(len(p), np.int64)
                mine = {size: (np.flatnonzero(np.isin(number, own.numbers)), own) for size, own in asking.items()}
                rows = {size: np.searchsorted(own.numbers, number[at]) for size, (at, own) in mine.items()}
                for size, (at, own) in mine.items():
                    ids[at] = own.ids[rows[size]]
                for anchors, block, scores in compared(asking, others):
                    at, row = mine[block.size][0], rows[block.size]
                    for k in range(1, positives + 1):  # the k-th positives of all anchors side by side
                        own, line = at[order[at] == k], row[order[at] == k]
                        s = scores[line]
                        mask = (anchors.labels[line][:, None] != block.labels) & (s >= lowest[own, None]) & (s <= highest[own, None])
                        _add(best, own, s, mask, block.ids)
                at = best.keys
                yield batch_of(last, np.full(len(at), ask), number[at], order[at], ids[at], positive[at], p[at], best.ids, best.scores)

    told = blocks.tiles(chosen).select("ask", "asks", "others", "pairs").mapInArrow(different, "ask long, number long, order long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best_first = Window.partitionBy("ask", "number", "order").orderBy(F.desc("negative_score"), "negative_id")
    out = told.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= negatives)
    out = cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop(chosen)
    blocks.drop()
    return out


#: Integer inner products of all anchors and rows, then windows.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
