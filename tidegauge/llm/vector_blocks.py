"""Integer vectors in blocks of bounded size: one immutable file a block in the shared folder, and tiles of block numbers.

Work on a stated query set and all rows is cut into tiles: the queries of ``ASK`` blocks against a run of blocks that
answer. Only numbers and file names are shuffled; a task maps the files that its tile names, so a block reaches the
tasks that need it by file (a broadcast whose size is a block's, whatever the table's). A run has ``LEAST_RUN`` blocks or a
``MOST_RUNS``-th of all, so what the tiles keep of a query and merge is at most ``MOST_RUNS`` times k rows.

A lost task reads the same files again; a lost writer writes the same file again, as rows are dealt by id and sorted by
id and vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import batch_of, cut, drop, map_file, remove, shared_dir, write_file

BLOCK = 4096
ASK = 32
LEAST_RUN = 1
MOST_RUNS = 512
MOST_TASKS = 20_000


def quantised(df: DataFrame, id_col: str, vector_col: str, label: Column | None = None, scale: int = 256) -> DataFrame:
    """id, label, x: components as floor(scale * x). Rows with a null id, with a null vector or one that holds null or
    non-finite components, or with a null label where labels are given, are left out. A component that is no 32-bit
    integer after scaling is an error."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    own = df.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), x.alias("x"))
    fit = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    wide = F.raise_error(F.lit("a scaled component passes 32 bits")).cast("long")
    return fit.select("id", "label", F.transform("x", lambda v: F.when(F.abs(v * scale) < 2.0**31, F.floor(v * scale)).otherwise(wide)).alias("x"))


class Blocks:
    """Files of ``rows`` (id, label, x) under a fresh folder, and ``catalogue``: number, name, n, n_queries of each.

    A query is a row whose id ``every`` divides. ``encode`` gives the arrays that a file holds besides ids, labels and
    places of queries; blocks hold vectors of one length.
    """

    def __init__(self, rows: DataFrame, every: int, encode, block: int = BLOCK):
        spark = rows.sparkSession
        folder = self.folder = shared_dir(spark, "blocks")
        self.spark = spark
        kept = pa.schema([("name", pa.string()), ("n", pa.int64()), ("n_queries", pa.int64())])

        def write(batches):
            part, count = TaskContext.get().partitionId(), 0
            for table in _chunks(batches, block):
                sizes = np.asarray(pa.compute.list_value_length(table["x"]))
                for size in np.unique(sizes).tolist():
                    own = table.filter(pa.array(sizes == size))
                    ids, labels = (own[c].to_numpy() for c in ("id", "label"))
                    x = np.asarray(own["x"].combine_chunks().flatten()).reshape(len(ids), size)
                    at = np.flatnonzero(ids % every == 0)
                    name = f"{part}-{count}"
                    head = np.array([len(ids), size, len(at)], np.int64)
                    write_file(f"{folder}/{name}", [np.ravel(part) for part in (head, ids, labels, at, x[at], *encode(x))])
                    count += 1
                    yield batch_of(kept, [name], [len(ids)], [len(at)])

        n = rows.count()
        parts = max(1, -(-n // block))
        dealt = rows.repartition(parts, "id").sortWithinPartitions("id", "x")
        written = cut(dealt.mapInArrow(write, "name string, n long, n_queries long"), "catalogue")
        # a row a block: the files' names are numbered through
        self.catalogue = written.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("number"), "name", "n", "n_queries")
        self.written, self.n = written, written.count()

    def tiles(self, beside: DataFrame | None = None) -> DataFrame:
        """ask (number), asks (names of the blocks whose queries ask), others (names of the blocks that answer), and the
        columns of ``beside`` (ask, ...), one row for each ask and run."""
        run = max(LEAST_RUN, -(-self.n // MOST_RUNS))
        count = max(1, -(-self.n // run))
        grouped = lambda by, size, name: self.catalogue.groupBy(F.floor(F.col("number") / size).alias(by)).agg(F.sort_array(F.collect_list("name")).alias(name))
        asked = grouped("ask", ASK, "asks").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>")))
        tiles = asked.join(grouped("run", run, "others"), "run")
        if beside is not None:
            tiles = tiles.join(beside, "ask")
        tasks = min(MOST_TASKS, count * max(1, -(-self.n // ASK)))
        return tiles.repartitionById(tasks, F.pmod(F.col("ask") * count + F.col("run"), F.lit(tasks)).cast("int")).drop("run")

    def drop(self) -> None:
        drop(self.written)
        remove(self.spark, self.folder)


class Block:
    """A mapped file: ids, labels, and its queries' places and vectors; ``rest`` is what ``encode`` gave."""

    def __init__(self, folder: str, name: str):
        flat = map_file(f"{folder}/{name}", np.int64)
        n, self.size, q = flat[:3].tolist()
        ends = np.cumsum([3, n, n, q, q * self.size])
        self.name = name
        self.ids, self.labels, self.places, asked = (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        self.queries, self.rest = asked.reshape(q, self.size), flat[ends[-1] :]


class Asked:
    """The queries of some blocks side by side: number (among all of them), id, label, vector, and where each lies."""

    def __init__(self, blocks: list[Block], numbers: list[np.ndarray]):
        self.numbers = np.concatenate(numbers)
        self.ids = np.concatenate([b.ids[b.places] for b in blocks])
        self.labels = np.concatenate([b.labels[b.places] for b in blocks])
        self.queries = np.concatenate([b.queries for b in blocks])
        ends = np.cumsum([len(b.places) for b in blocks])
        self.of = {b.name: (slice(end - len(b.places), end), b.places) for b, end in zip(blocks, ends.tolist(), strict=True)}

    def own(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(query, row): which of the queries are rows of the block of this name, and which rows."""
        if name not in self.of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part, places = self.of[name]
        return np.arange(part.start, part.stop), places


def asked(folder: str, names: list[str]) -> dict[int, Asked]:
    """Queries of the named blocks by the length of their vectors."""
    blocks = [Block(folder, name) for name in names]
    ends = np.cumsum([0, *[len(b.places) for b in blocks]])
    numbers = [np.arange(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    of: dict[int, list[int]] = {}
    for k, block in enumerate(blocks):
        if len(block.places):
            of.setdefault(block.size, []).append(k)
    return {size: Asked([blocks[k] for k in at], [numbers[k] for k in at]) for size, at in of.items()}


class Best:
    """The k best (score, then smaller id) of each of some keys, merged block by block."""

    def __init__(self, keys: int, k: int):
        self.k, self.bar = k, np.full(keys, np.iinfo(np.int64).min)
        self.keys = self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(keys):
            return
        own = [np.concatenate(pair) for pair in ((self.keys, keys), (self.scores, scores), (self.ids, ids))]
        order = np.lexsort((own[2], -own[1], own[0]))
        self.keys, self.scores, self.ids = (o[order] for o in own)
        kept = np.arange(len(order)) - np.searchsorted(self.keys, self.keys) < self.k
        self.keys, self.scores, self.ids = self.keys[kept], self.scores[kept], self.ids[kept]
        full = np.flatnonzero(np.bincount(self.keys, minlength=len(self.bar)) >= self.k)
        self.bar[full] = self.scores[np.searchsorted(self.keys, full, "right") - 1]  # a lower score cannot come in any more


def _chunks(batches, rows: int):
    """Tables of ``rows`` rows, the last one of fewer."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while batch.num_rows - at >= rows - n:
            yield pa.Table.from_batches([*held, batch.slice(at, rows - n)])
            at, held, n = at + rows - n, [], 0
        if at < batch.num_rows:
            held.append(batch.slice(at))
            n += batch.num_rows - at
    if n:
        yield pa.Table.from_batches(held)
