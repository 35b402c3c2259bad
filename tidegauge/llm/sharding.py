"""Size-tiered compaction of document shards, in DataFrame functions only.

Arrivals are appended as small immutable shards of about ``ARRIVAL_BYTES``: each file that an append writes is one. A shard's tier is the power
of ``FANOUT`` by which its text exceeds ``LEAST_BYTES``. Shards of one tier, in order of arrival, form runs of up to
``target_bytes``, and a run of two shards or more merges into one file. A version of the table is a manifest with a
row for each live shard, named relative to the table's folder, so any spelling of that folder reads them. A manifest is written
aside, and a small file with its name is renamed to the version's number, which fails where that exists. So readers
see whole versions only; a writer that dies leaves no version, and of two writers of one version the one that comes
second commits again on top of the other's version, unless that has merged the same shards. Shards never change. A compaction counts the rows
that it wrote of each run and commits only what the manifest says they hold. ``vacuum`` forgets all but the last versions and removes the folders that
forgotten versions name and kept ones do not, and what no version names once it is older than ``grace`` seconds (what a dead writer left).

Runs follow from the manifest alone (one row a shard), so a lost task writes its shard again from the same rows, and
runs hold about the same bytes whatever source or key the rows have.

Edge cases: null texts have 0 bytes; rows that repeat stay; a shard of half the target or more is left alone; an empty
arrival commits a version without new shards; rows may have columns of any names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, drop, shared_dir

FANOUT = 4
LEAST_BYTES = 1 << 20
TARGET_BYTES = 128 << 20
ARRIVAL_BYTES = 4 << 20
MOST_BROADCAST_SHARDS = 100_000
ATTEMPTS = 10
GRACE = 7 * 24 * 3600
SHARD = r"(data/[0-9]{9}-[0-9a-f]{32}/.+)$"
MANIFEST = "shard string, tier int, n_docs long, n_bytes long, arrived long, version long"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardedTable:
    """A table of immutable shards under ``path`` with versioned manifests."""

    def __init__(self, spark: SparkSession, path: str | None = None, target_bytes: int = TARGET_BYTES, arrival_bytes: int = ARRIVAL_BYTES):
        self.spark, self.path, self.target, self.arrival = spark, path or shared_dir(spark, "shards"), target_bytes, arrival_bytes
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("versions")):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(self._at("versions")))

    def _manifest_of(self, version: int) -> str:
        opened = self._fs.open(self._at(f"versions/{version:09d}"))
        name = opened.readUTF()
        opened.close()
        return name

    def manifest(self, version: int | None = None) -> DataFrame:
        """shard, tier, n_docs, n_bytes, arrived (order), version (that added it); of the last version by default."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._manifest_of(known[-1] if version is None else version)}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        name = f"{version:09d}-{uuid.uuid4().hex}"
        manifest.select(*[x.split()[0] for x in MANIFEST.split(", ")]).write.parquet(f"{self.path}/manifests/{name}")
        aside = self._at(f"aside/{name}")
        told = self._fs.create(aside)
        told.writeUTF(name)
        told.close()
        self._fs.mkdirs(self._at("versions"))
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        never_over[0] = self._hadoop.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._at(f"versions/{version:09d}")), never_over)
        except Py4JJavaError as error:
            for left in (f"manifests/{name}", f"aside/{name}"):
                self._fs.delete(self._at(left), True)
            if self._fs.exists(self._at(f"versions/{version:09d}")):
                raise Conflict(f"version {version} was committed by another writer") from error
            raise
        return version

    def _commit_next(self, change: Callable[[DataFrame, int], DataFrame]) -> int:
        """Commit what ``change`` makes of the last manifest; again, from the newer one, where another writer was first."""
        for _ in range(ATTEMPTS):
            version = self._next()
            try:
                return self._commit(change(self.manifest(), version), version)
            except Conflict as conflict:
                last = conflict
        raise last

    def _next(self) -> int:
        return (self.versions() or [0])[-1] + 1

    def _described(self, shards: DataFrame, version: int) -> DataFrame:
        """Manifest rows for (shard, n_docs, n_bytes, arrived)."""
        tier = F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.greatest(F.col("n_bytes"), F.lit(1)) / LEAST_BYTES))).cast("int")
        return shards.select("shard", tier.alias("tier"), "n_docs", "n_bytes", "arrived", F.lit(version).cast("long").alias("version"))

    def append(self, df: DataFrame) -> int:
        """Add rows as small shards; returns the version that has them."""
        folder = f"data/{self._next():09d}-{uuid.uuid4().hex}"
        n, size = df.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        rows_a_file = max(1, self.arrival * n // max(1, size or 0))
        df.write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")
        bytes_of = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        files = rows.groupBy(self._shard().alias("shard")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bytes_of).alias("n_bytes"))

        def change(manifest, version):
            # one row a file; order of arrival: version, then file
            arrived = files.withColumn("arrived", F.lit(version * 1_000_000_000) + F.row_number().over(Window.orderBy("shard")))
            return manifest.unionByName(self._described(arrived, version))

        return self._commit_next(change)

    def plan(self) -> DataFrame:
        """(shard, run): live shards to merge. Runs are cut where the bytes before a shard in its tier pass the target."""
        line = Window.partitionBy("tier").orderBy("arrived")
        small = self.manifest().where(F.col("n_bytes") < self.target / 2)
        before = F.coalesce(F.sum("n_bytes").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        runs = small.withColumn("cut", F.floor(before / self.target)).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("tier", "cut"))).where("members > 1")
        # runs are numbered through; a row a shard
        return runs.withColumn("run", (F.dense_rank().over(Window.orderBy("tier", "cut")) - 1).cast("int")).drop("cut", "members")

    def compact(self, schema) -> int | None:
        """Merge what ``plan`` calls for and commit; None where nothing is to merge."""
        plan = cut(self.plan(), "compaction-plan")
        n = plan.agg(F.max("run")).first()[0]
        if n is None:
            drop(plan)
            return None
        folder = f"data/{self._next():09d}-{uuid.uuid4().hex}"
        names = [f.name for f in schema]
        run = next(x for x in (f"run{'_' * k}" for k in range(1, len(names) + 2)) if x not in names)
        of = plan.select("shard", "run")
        few = plan.count() <= MOST_BROADCAST_SHARDS
        dealt = self._rows(plan, schema).join(F.broadcast(of) if few else of, "shard").select("row.*", F.col("run").alias(run))
        dealt.repartitionById(n + 1, F.col(run)).write.partitionBy(run).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        # the manifest has a row for each run; its shard is the folder of its one file
        merged = plan.groupBy("run").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.min("arrived").alias("arrived"))
        named = merged.withColumn("shard", F.concat(F.lit(f"{folder}/{run}="), F.col("run").cast("string")))
        written = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").groupBy(self._shard().alias("shard")).agg(F.count(F.lit(1)).alias("n"))
        wrong = named.join(written, "shard", "full").where(~F.col("n_docs").eqNullSafe(F.col("n"))).first()
        if wrong is not None:
            self._fs.delete(self._at(folder), True)
            raise RuntimeError(f"a merged shard has not the rows of its parts: {wrong}")

        def change(manifest, version):
            gone = plan.join(manifest, "shard", "left_anti").first()
            if gone is not None:
                self._fs.delete(self._at(folder), True)
                raise RuntimeError(f"another writer has merged {gone['shard']}")
            return manifest.join(plan.select("shard"), "shard", "left_anti").unionByName(self._described(named, version))

        version = self._commit_next(change)
        drop(plan)
        return version

    @staticmethod
    def _shard():
        """A row's shard: its file, or the folder of a run, relative to the table's folder."""
        file = F.regexp_extract(F.col("_metadata.file_path"), SHARD, 1)
        return F.when(file.rlike("/run_+=[0-9]+/[^/]+$"), F.regexp_replace(file, "/[^/]+$", "")).otherwise(file)

    def _rows(self, shards: DataFrame, schema) -> DataFrame:
        """(row: the columns, shard) of the given shards."""
        paths = [f"{self.path}/{r['shard']}" for r in shards.select("shard").toLocalIterator()]  # one a shard: the scan's file listing
        if not paths:
            return self.spark.createDataFrame([], schema).select(F.struct("*").alias("row"), F.lit("").alias("shard"))
        return self.spark.read.schema(schema).parquet(*paths).select(F.struct("*").alias("row"), self._shard().alias("shard"))

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of a version."""
        return self._rows(self.manifest(version), schema).select("row.*")

    def _folders(self, version: int) -> DataFrame:
        return self.manifest(version).select(F.regexp_extract("shard", "^data/([^/]+)/", 1).alias("folder")).distinct()

    def _left(self, kind: str, named: set[str], grace: float) -> list[str]:
        """Names under a folder that no version has, older than ``grace`` seconds."""
        if not self._fs.exists(self._at(kind)):
            return []
        old = (time.time() - grace) * 1000
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(kind)) if x.getModificationTime() < old and x.getPath().getName() not in named]

    def vacuum(self, retain: int = 1, grace: float = GRACE) -> None:
        """Forget all versions but the last ``retain`` (readers of the others must be done), and remove what a writer
        that died more than ``grace`` seconds ago left: no commit may take longer."""
        versions = self.versions()
        old, kept = versions[:-retain], versions[-retain:]
        live = reduce(DataFrame.unionByName, map(self._folders, kept)).distinct() if kept else None
        if old:
            named = reduce(DataFrame.unionByName, map(self._folders, old)).distinct()
            for row in named.join(live, "folder", "left_anti").toLocalIterator():  # a folder a commit
                self._fs.delete(self._at(f"data/{row['folder']}"), True)
        for version in old:
            manifest = self._manifest_of(version)
            self._fs.delete(self._at(f"versions/{version:09d}"), True)
            self._fs.delete(self._at(f"manifests/{manifest}"), True)
        held = set() if live is None else {r["folder"] for r in live.toLocalIterator()}  # a name a commit
        manifests = {self._manifest_of(v) for v in kept}
        for kind, named in (("data", held), ("manifests", manifests), ("aside", set())):
            for name in self._left(kind, named, grace):
                self._fs.delete(self._at(f"{kind}/{name}"), True)


def compacted(df: DataFrame, **options) -> ShardedTable:
    """A new table with the rows of ``df`` appended, then compacted until no run is left to merge."""
    table = ShardedTable(df.sparkSession, **options)
    table.append(df)
    while table.compact(df.schema) is not None:
        pass
    table.vacuum()
    return table


def digests(df: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, text_sha256 of every row of the committed table, and of its version: table_docs, table_bytes,
    mergeable (shards that a further compaction would merge) and oversized (merged shards of over twice the target)."""
    table = compacted(df, **options)
    rows = table.read(df.schema)
    merged = F.col("shard").rlike("/run_+=[0-9]+$")
    whole = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    oversized = table.manifest().agg(F.count_if(merged & (F.col("n_bytes") > 2 * table.target))).first()[0]
    text = F.coalesce(F.col("text"), F.lit(""))
    told = {"table_docs": whole[0], "table_bytes": whole[1] or 0, "mergeable": table.plan().count(), "oversized": oversized}
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), *[F.lit(v).cast("long").alias(k) for k, v in told.items()])


ORACLE_SQL = """
SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256,
       (SELECT count(*) FROM documents) AS table_docs, (SELECT sum(strlen(text))::BIGINT FROM documents) AS table_bytes,
       0::BIGINT AS mergeable, 0::BIGINT AS oversized
FROM documents
"""
