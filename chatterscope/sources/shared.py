"""Tables in the folder that driver and executors share: they cut a plan's lineage, and a lost executor costs a task."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session has none, a folder of our own, in one JVM alone (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not hasattr(sc, "_chatterscope_shared"):
        sc._chatterscope_shared = f"file://{tempfile.mkdtemp(prefix='chatterscope-')}"
        atexit.register(removed, spark, sc._chatterscope_shared)
    return sc._chatterscope_shared


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the session ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # the session has ended
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
