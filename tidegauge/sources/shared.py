"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='shared-')}"


def folder(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: its lineage ends at files that outlive executors."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_folder = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for these; nothing may read them afterwards."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.cut_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
