"""Fewest steps in a directed graph, from many sources at once.

Nodes are numbered in their order and dealt to shards of ``SHARD`` numbers; a shard's edges are one row. A round groups the
messages (node, steps, sources as bits) of a shard with its edges and the steps known so far, and follows them inside the
shard, level by level; what leaves it are the messages of the next round. The first ``LEVELS`` rounds go one step, so that a
dense graph is walked by levels; later ones twice as far each time. A pair that gets fewer steps later is told again, so
the end is exact. So long chains take a round for each shard they cross, not for each step,
and a round reads the shards that have messages, not the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.shared import cut, drop

SHARD = 131_072
BITS = 62  # sources of a block
LEVELS = 8  # rounds of one step each, in which a graph without long chains is done
FAR = np.int32(2**31 - 1)
ROUND = "kind int, block long, shard long, node long, hop int, mask long, state binary"


def _numbered(nodes: DataFrame) -> DataFrame:
    """(node, id): distinct nodes numbered in their order."""
    ranged = cut(nodes.distinct().repartitionByRange("node").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    out = cut(ranged.withColumn("place", place).join(F.broadcast(bases), "part").select("node", (F.col("base") + F.col("place")).alias("id")), "numbered")
    drop(ranged)
    return out


def _summed(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of all columns but the last, whose bits are joined."""
    *keys, mask = columns
    if not len(mask):
        return list(columns)
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    at = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [*[k[at] for k in keys], np.bitwise_or.reduceat(mask[order], at)]


def _adjacency(shard: int):
    """A shard's rows (a, b) as one: offsets and targets, sorted."""

    def run(key, table):
        a, b = table["a"].to_numpy() - key[0].as_py() * shard, table["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        offsets = np.searchsorted(a[order], np.arange(shard + 1))
        return pa.table({"shard": [key[0].as_py()], "offsets": [offsets.astype("<i8").tobytes()], "targets": [b[order].astype("<i8").tobytes()]})

    return run


def _followed(shard: int, width: int, most: int | None, until: int):
    """Messages of a shard, followed inside it up to so many steps: its steps, and the messages that leave it or wait."""

    def run(key, inbox, own):
        block, k = (x.as_py() for x in key)
        steps, offsets, targets = np.full((shard, width), FAR), np.zeros(shard + 1, np.int64), np.empty(0, np.int64)
        for row in own.to_pylist():
            if row["state"] is not None:
                steps = np.frombuffer(row["state"], "<i4").reshape(shard, -1).copy()
            if row["offsets"] is not None:
                offsets, targets = np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["targets"], "<i8")
        bit, first = np.arange(width), k * shard
        node, hop, mask = (inbox[c].to_numpy() for c in ("node", "hop", "mask"))
        waiting = {int(h): [(node[hop == h] - first, mask[hop == h])] for h in np.unique(hop)}
        gone = []
        while waiting and min(waiting) <= until:
            h = min(waiting)
            at, bits = _summed(*map(np.concatenate, zip(*waiting.pop(h), strict=True)))
            if h:  # a source is not its own node
                better = ((bits[:, None] >> bit) & 1).astype(bool) & (steps[at] > h)
                steps[at] = np.where(better, h, steps[at])
                bits = (better.astype(np.int64) << bit).sum(1)
                at, bits = at[bits != 0], bits[bits != 0]
            n = offsets[at + 1] - offsets[at]
            if h == most or not n.sum():
                continue
            places = np.arange(n.sum()) + np.repeat(offsets[at] - (np.cumsum(n) - n), n)
            to, bits = _summed(targets[places], np.repeat(bits, n))
            inside = to // shard == k
            if inside.any():
                waiting.setdefault(h + 1, []).append((to[inside] - first, bits[inside]))
            if not inside.all():
                gone.append((to[~inside], np.full(np.count_nonzero(~inside), h + 1), bits[~inside]))
        gone += [(at + first, np.full(len(at), h), bits) for h, own in waiting.items() for at, bits in own]
        node, hop, mask = map(np.concatenate, zip(*gone, strict=True)) if gone else (np.empty(0, np.int64),) * 3
        count = len(node)
        columns = [np.append(np.zeros(count), 1), np.full(count + 1, block), np.append(node // shard, k), np.append(node, 0), np.append(hop, 0), np.append(mask, 0)]
        told = [pa.array(c.astype(np.int64)) for c in columns]
        return pa.table([told[0].cast("int32"), *told[1:4], told[4].cast("int32"), told[5], pa.array([None] * count + [steps.astype("<i4").tobytes()], pa.binary())], names=[c.split()[0] for c in ROUND.split(", ")])

    return run


def _told(shard: int):
    """Rows (source, id, hop) of shards' steps."""
    schema = pa.schema([("source", pa.int64()), ("id", pa.int64()), ("hop", pa.int32())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                steps = np.frombuffer(row["state"], "<i4").reshape(shard, -1)
                node, source = np.nonzero(steps != FAR)
                yield pa.RecordBatch.from_arrays([pa.array(source + row["block"] * BITS), pa.array(node + row["shard"] * shard), pa.array(steps[node, source])], schema=schema)

    return run


def reachable(edges: DataFrame, sources: DataFrame, most: int | None = None, shard: int | None = None) -> DataFrame:
    """src, node, hop: every node that each of ``sources`` (src) reaches along ``edges`` (src, dst), in the fewest steps (at
    most ``most``). A source is not its own node unless a cycle leads back to it. The driver sees a row a block of
    sources and shard with messages."""
    spark, shard = edges.sparkSession, shard or SHARD
    steps = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    nodes = _numbered(steps.select(F.col("src").alias("node")).union(steps.select("dst")))
    begun = sources.where("src IS NOT NULL").select(F.col("src").alias("node")).distinct().join(nodes, "node")
    begun = cut(begun.select("node", F.col("id").alias("at")), "begun")
    named = _numbered(begun.select("node"))
    width = min(BITS, named.count())
    a, b = (nodes.select(F.col("node").alias(c), F.col("id").alias(k)) for c, k in (("src", "a"), ("dst", "b")))
    graph = steps.join(a, "src").join(b, "dst").select((F.col("a") / shard).cast("long").alias("shard"), "a", "b")
    graph = cut(graph.groupBy("shard").applyInArrow(_adjacency(shard), "shard long, offsets binary, targets binary").repartition("shard"), "graph")
    source = (F.col("id") / BITS).cast("long")
    told = begun.join(named, "node").select(source.alias("block"), (F.col("at") / shard).cast("long").alias("shard"), F.col("at").alias("node"), F.lit(0).alias("hop"), F.expr(f"shiftleft(1L, cast(id % {BITS} as int))").alias("mask"))
    inbox, rounds, last = told, [], {}
    while active := [(r["block"], r["shard"]) for r in inbox.select("block", "shard").distinct().collect()]:
        now = spark.createDataFrame([(*key, last.get(key)) for key in active], "block long, shard long, round int")
        own = F.broadcast(now).join(graph.where(F.col("shard").isin(sorted({k for _, k in active}))), "shard", "left")
        states = _states(rounds, sorted({last[key] for key in active if key in last}))
        own = own.withColumn("state", F.lit(None).cast("binary")) if states is None else own.join(states, ["round", "block", "shard"], "left")
        until = len(rounds) if len(rounds) < LEVELS else LEVELS << (len(rounds) - LEVELS + 1)
        found = inbox.groupBy("block", "shard").cogroup(own.groupBy("block", "shard")).applyInArrow(_followed(shard, width, most, until), ROUND)
        rounds.append(cut(found, "round"))
        last |= dict.fromkeys(active, len(rounds) - 1)
        sent = rounds[-1].where("kind = 0").groupBy("block", "shard", "node", "hop").agg(F.bit_or("mask").alias("mask"))
        inbox = sent.select("block", "shard", "node", "hop", "mask")
    ends = spark.createDataFrame([(*key, k) for key, k in last.items()], "block long, shard long, round int")
    states = _states(rounds, sorted(set(last.values())))
    if states is None:
        out = steps.limit(0).select("src", F.col("dst").alias("node"), F.lit(0).alias("hop"))
    else:
        rows = states.join(F.broadcast(ends), ["round", "block", "shard"]).select("block", "shard", "state").mapInArrow(_told(shard), "source long, id long, hop int")
        names = named.select(F.col("node").alias("src"), F.col("id").alias("source"))
        out = rows.join(names, "source").join(nodes, "id").select("src", "node", "hop")
    out = cut(out, "reachable")
    drop(steps, nodes, begun, named, graph, *rounds)
    return out


def _states(rounds: list[DataFrame], of: list[int]) -> DataFrame | None:
    """(round, block, shard, state) of some rounds."""
    out = None
    for k in of:
        own = rounds[k].where("kind = 1").select(F.lit(k).alias("round"), "block", "shard", "state")
        out = own if out is None else out.unionByName(own)
    return out
