"""Delimited and JSON files: sensor matrices of normal and fault runs, line-delimited records, artifacts, replay streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURED, MANIPULATED = 41, 11
STREAM = T.StructType([T.StructField("sample_index", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("is_fault", T.BooleanType()), T.StructField("fault_label", T.IntegerType())])


def default_names() -> list[str]:
    """Measured variables first, then manipulated ones, numbered through."""
    return [f"XMEAS_{k}" for k in range(1, MEASURED + 1)] + [f"XMV_{k}" for k in range(MEASURED + 1, MEASURED + MANIPULATED + 1)]


def read_matrix(spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", names: list[str] | None = None, drop: tuple[str, ...] = (), onset: str | None = None, features: int | None = None) -> DataFrame:
    """file, row (position in its file), values and, with an onset column, onset: rows of delimited files.

    Rows are numbered by blocks of a file, wherever these are read, so a file of any length is no task of its own.

    Header names are trimmed; without a header ``names`` (the default names where not given) name the columns. Columns
    in ``drop`` (time stamps) are left out, as are those past the first ``features``. Text that is no number is null.
    """
    raw = spark.read.option("header", has_header).option("sep", delimiter).option("inferSchema", False).csv(path)
    own, onset_of = _columns(raw, has_header, names, drop, onset, features)
    raw = raw.toDF(*own.names)
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    block = F.col("_metadata.file_block_start")
    placed = raw.select(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), own.values.alias("values"), *onset_of)
    # the rows of a block follow each other in one partition: a row's number is its block's first one and its place there
    blocks = placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", (F.coalesce(F.sum("n").over(line), F.lit(0)) - F.col("first")).alias("base"))
    return placed.join(bases, ["file", "block"]).withColumn("row", F.col("base") + F.col("at")).drop("block", "at", "base")


class _Own:
    def __init__(self, names: list[str], values):
        self.names, self.values = names, values


def _columns(raw: DataFrame, has_header: bool, names: list[str] | None, drop: tuple[str, ...], onset: str | None, features: int | None):
    """Names of a delimited file's columns with the vector of its values, and the onset column where there is one."""
    named = [c.strip() for c in raw.columns] if has_header else (names or default_names())[: len(raw.columns)]
    own = [c for c in named if c not in drop and c != onset][:features]
    number = lambda c, kind: F.expr(f"try_cast(`{c}` AS {kind})")
    return _Own(named, F.array(*[number(c, "double") for c in own])), [number(onset, "int").alias("onset")] if onset else []


def normal_runs(spark: SparkSession, path: str, **options) -> DataFrame:
    """matrix of all files of a pattern as one run, files in order of name."""
    rows = read_matrix(spark, path, **options)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("base", before).drop("n")  # a row a file
    return rows.join(bases, "file").select(F.lit("normal").alias("run_id"), (F.col("base") + F.col("row")).alias("sample_index"), "values", F.lit(None).cast("int").alias("fault_label"))


def fault_id(stem) -> F.Column:
    """All digits of a file's stem as a number; null without any."""
    return F.nullif(F.regexp_replace(stem, "[^0-9]", ""), F.lit("")).cast("int")


def fault_label(stem) -> F.Column:
    """The number after "fault", with or without a dash or underscore; null where there is none."""
    return F.nullif(F.regexp_extract(stem, r"(?i)fault[_-]?(\d+)", 1), F.lit("")).cast("int")


def fault_runs(spark: SparkSession, path: str, onset: str | None = None, default_onset: int = 161, **options) -> DataFrame:
    """matrix with onset_index, a run a file: the first value of the onset column or the default."""
    rows = read_matrix(spark, path, onset=onset, **options)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    if onset:
        first = rows.where("row = 0").select("file", F.col("onset").alias("given"))  # a row a file
        rows = rows.join(first, "file", "left")
    given = F.col("given") if onset else F.lit(None).cast("int")
    return rows.select(F.col("file").alias("run_id"), F.col("row").alias("sample_index"), "values", fault_id(stem).alias("fault_label"), F.coalesce(given, F.lit(default_onset)).alias("onset_index"))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_artifact(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON artifact (baseline, threshold, metrics) written by ``write_artifact``."""
    return spark.read.schema(schema).json(path)


def write_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Replay: record files in order of arrival as a stream."""
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", files_per_trigger).json(path)


def csv_stream(spark: SparkSession, path: str, columns: list[str], run_id: str = "normal", delimiter: str = ",", has_header: bool = True, drop: tuple[str, ...] = (), features: int | None = None, fault_label: int | None = None, files_per_trigger: int = 1, by_name: bool = False) -> DataFrame:
    """Delimited files in a folder as a stream of run_id, arrival, values, fault_label: one run, files in order of arrival (time
    of change, then name; ``by_name``: the files of a batch in order of name alone, as one job may write them side by side). ``columns`` names the files' columns. ``arrival`` orders the records; ``streaming.numbering``
    turns it into sample numbers."""
    schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in columns])
    raw = spark.readStream.schema(schema).option("header", has_header).option("sep", delimiter).option("maxFilesPerTrigger", files_per_trigger).csv(path)
    own, _ = _columns(raw, True, None, drop, None, features)
    meta = F.col("_metadata")
    time = F.lit(0).cast("timestamp") if by_name else meta["file_modification_time"]
    rows = raw.select(time.alias("time"), meta["file_name"].alias("file"), meta["file_block_start"].alias("block"), own.values.alias("values"))

    def placed(batches):
        """A partition's rows with their place in it; those of a block of a file follow each other there."""
        n = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(range(n, n + batch.num_rows), pa.int64()))
            n += batch.num_rows

    told = rows.mapInArrow(placed, "time timestamp, file string, block long, values array<double>, at long")
    return told.select(F.lit(run_id).alias("run_id"), F.struct("time", "file", "block", "at").alias("arrival"), "values", F.lit(fault_label).cast("int").alias("fault_label"))


def load(spark: SparkSession, kind: str, path: str, repair: str | None = None, features: int | None = None, **options) -> DataFrame:
    """Entry by format: "csv" (normal runs), "csv_faults", "jsonl", "parquet".

    Matrices may be repaired by a strategy of ``operators.repair`` (over whole vectors), then truncated to ``features``.
    """
    loaders = {"csv": normal_runs, "csv_faults": fault_runs, "jsonl": read_records, "parquet": lambda s, p: s.read.parquet(p)}
    if kind not in loaders:
        raise ValueError(f"format {kind!r} is none of {sorted(loaders)}")
    rows = loaders[kind](spark, path, **options)
    if repair is not None:
        from tidegauge.operators.repair import repair_matrix

        return repair_matrix(rows, repair, features)
    return rows if features is None else rows.withColumn("values", F.slice("values", 1, features))


def write_windows(windows: DataFrame, path: str) -> DataFrame:
    """Write windows by split (run_id, window_id, split, values: an array of its samples' vectors) as Parquet, a folder a
    split, and return the splits' counts with the windows' shape: split, n_windows, size, n_features."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)
    kept = windows.sparkSession.read.parquet(path)
    return kept.groupBy("split").agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.size("values")).alias("size"), F.max(F.size(F.element_at("values", 1))).alias("n_features"))
