"""What the operators of this subpackage share: tables in the shared folder, dense numbering, reading."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words are runs of other characters than these (space and \x09-\x0D).
BLANKS = r"[\x20\x09-\x0D]+"
#: The most that a bit map of keys holds: 64 MB, whatever the number of keys.
SIEVE_BITS = 1 << 29


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where the session names none, one of our own, in one JVM alone (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not hasattr(sc, "_chatterscope_dir"):
        sc._chatterscope_dir = "file://" + tempfile.mkdtemp(prefix="chatterscope-")
        atexit.register(drop_path, spark, sc._chatterscope_dir)
    return sc._chatterscope_dir


def drop_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables an operator writes to the shared folder to cut lineage; a lost executor costs one task, not the plan.

    ``put`` writes a frame once and gives it back as a scan. ``drop`` removes a table that nothing reads any more.
    Tables behind the returned frame stay until the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0, {}
        atexit.register(self.close)

    def put(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if got := self.paths.pop(id(df), None):
                drop_path(self.spark, got[0])

    def release(self) -> None:
        """Shuffle files of steps that are written and read no more go now, not at some later collection of the driver's memory."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            drop_path(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            pass


def dense_index(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str, per_bucket: int = 50_000) -> DataFrame:
    """Add ``name``: 0, 1, 2... without gaps within ``keys``, in an order fixed by the row's own columns.

    A key may hold most rows: each key is cut into buckets by a hash of ``order``, rows are numbered in
    their bucket and the buckets' sizes are summed before them. ``rows`` is the number of rows of df.
    """
    n = max(1, -(-rows // per_bucket))
    n = max(n, 16)
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_s"))
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return ranked.join(starts, [*keys, "_b"]).withColumn(name, (F.col("_s") + F.col("_r")).cast("long")).drop("_b", "_r", "_s")


def ranged(df: DataFrame, parts: int, order: list) -> DataFrame:
    """The rows dealt in ascending ranges of ``order`` to so many partitions, whose number is ``part``: write it before it is used.

    Rows equal in all of ``order`` go to one partition.
    """
    return df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id().cast("long"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits, set at the leading bits of each key: 32 a key, and SIEVE_BITS at most."""
    n = keys.count()
    bits = min(max(32 * n, 1 << 12), SIEVE_BITS)
    bits = 1 << (bits - 1).bit_length()
    part = bits // 64

    def slices(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(part, bool)
        flags[place_in(pdf["key"].to_numpy(np.int64), bits) % part] = True
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(flags).tobytes()]})

    found = keys.select(F.shiftrightunsigned("key", 58).alias("part"), "key").groupBy("part").applyInPandas(slices, "part long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def place_in(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    i = place_in(keys, 8 * len(bits))
    return (bits[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 > 0
