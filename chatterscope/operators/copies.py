"""Verified copies of tables that survive an interruption.

A copy goes slice by slice (a slice is a hash range of the key), each one commit. A log beside the rows tells each table's
state; a resumed copy appends, by anti join on the key, what the target lacks. Nothing is readable through ``opened`` before
every table's count, digest of all rows and ordered sample agree with the source, and the copy has been activated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "name string, state string, n long, digest string, sample string"
#: Digests are taken in this many key ranges, so that a difference is looked for in those alone that differ.
PARTS = 4096


@dataclass(frozen=True)
class Table:
    """A table and its key; the key's columns may be null, as a key's part."""

    name: str
    rows: DataFrame
    key: tuple[str, ...]


class Differs(ValueError):
    """A copy that is not its source."""


def part_of(key: tuple[str, ...], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts))


def row_hash(df: DataFrame) -> Column:
    """Null and empty text, and a value in one column or the next, are told apart."""
    fields = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.conv(F.substring(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")


def digests(df: DataFrame, key: tuple[str, ...], parts: int = PARTS) -> DataFrame:
    """part, n, digest: sums over the rows of a key range, whatever their order."""
    return df.groupBy(part_of(key, parts).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(row_hash(df)).alias("digest"))


def sample_hash(df: DataFrame, key: tuple[str, ...], n: int = 100) -> str:
    """The first rows in key order as one hash: an order-sensitive check beside the digest."""
    place = [F.col(f"`{k}`") for k in key]
    first = df.withColumn("_h", row_hash(df)).orderBy(*[p.asc_nulls_first() for p in place], "_h").limit(n)
    return first.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*place, "_h")))), 256).alias("s")).first()["s"]


def manifest(table: Table, rows: DataFrame) -> tuple[int, str, str]:
    total = digests(rows, table.key, 1).first()
    return (total["n"], str(total["digest"]), sample_hash(rows, table.key)) if total else (0, "0", sample_hash(rows, table.key))


def differences(source: DataFrame, copy: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key, change: rows that are missing, extra or changed. Only key ranges whose digests differ are compared by row."""
    a, b = digests(source, key), digests(copy, key).select("part", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    parts = F.broadcast(a.join(b, "part", "full").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest")))).select(F.col("part").alias("_part")))  # PARTS rows at most

    def counted(df: DataFrame, named: str) -> DataFrame:
        rows = df.join(parts, part_of(key, PARTS) == F.col("_part"), "left_semi")
        return rows.groupBy(*key, row_hash(df).alias("_h")).agg(F.count(F.lit(1)).alias(named))

    both = counted(source, "_s").withColumn("_c", F.lit(0)).unionByName(counted(copy, "_c").withColumn("_s", F.lit(0)))
    each = both.groupBy(*key, "_h").agg((F.sum("_s") - F.sum("_c")).alias("_d")).where("_d <> 0")
    less, more = F.bool_or(F.col("_d") > 0), F.bool_or(F.col("_d") < 0)
    return each.groupBy(*key).agg(F.when(less & more, "changed").when(less, "missing").otherwise("extra").alias("change"))


def log(spark: SparkSession, target: str) -> DataFrame:
    """What has been done so far; empty where nothing has."""
    try:
        return spark.read.schema(LOG).json(f"{target}/_log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def told(spark: SparkSession, target: str, *entries: tuple) -> None:
    spark.createDataFrame(list(entries), LOG).coalesce(1).write.mode("append").json(f"{target}/_log")


def held(spark: SparkSession, target: str, table: Table) -> DataFrame:
    try:
        return spark.read.schema(table.rows.schema).parquet(f"{target}/{table.name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], table.rows.schema)


def copied(spark: SparkSession, tables: list[Table], target: str, *, resume: bool = False, slices: int = 4, progress: Callable[[str, int], None] = lambda name, i: None) -> DataFrame:
    """Copies, verifies and activates; the log's last states are returned.

    A target that holds something is an error unless the copy is resumed. ``progress`` hears of every slice that is in place;
    what it raises interrupts the copy. Each slice reads the source once, so take as many as losing one is worth.
    """
    states = {(r["name"], r["state"]) for r in log(spark, target).select("name", "state").distinct().collect()}  # two a table
    if states and not resume:
        raise ValueError(f"the target is not empty ({', '.join(sorted({n for n, _ in states}))}): resume the copy or take another")
    for t in tables:
        if (t.name, "verified") not in states:
            if (t.name, "begun") not in states:
                told(spark, target, (t.name, "begun", None, None, None))
            for i in range(slices):
                rows = t.rows.where(part_of(t.key, slices) == i)
                if resume:
                    there = held(spark, target, t).where(part_of(t.key, slices) == i).select(*[F.col(f"`{k}`").alias(f"_held{j}") for j, k in enumerate(t.key)])
                    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_held{j}")) for j, k in enumerate(t.key)]
                    rows = rows.join(there, same, "left_anti")
                rows.write.mode("append").parquet(f"{target}/{t.name}")
                progress(t.name, i)
            verified(spark, t, target)
    told(spark, target, *[(t.name, "active", None, None, None) for t in tables])
    return log(spark, target).where("state = 'verified'").select("name", "n", "digest", "sample")


def verified(spark: SparkSession, table: Table, target: str) -> None:
    want, got = manifest(table, table.rows), manifest(table, held(spark, target, table))
    if want != got:
        raise Differs(f"{table.name}: the source has (rows, digest, sample) {want}, the copy {got}")
    told(spark, target, (table.name, "verified", *got))


def opened(spark: SparkSession, target: str, table: Table) -> DataFrame:
    """An active copy's rows. One that is not whole has none to give."""
    if log(spark, target).where((F.col("name") == table.name) & (F.col("state") == "active")).isEmpty():
        raise ValueError(f"{table.name} has not been verified and activated at {target}")
    return held(spark, target, table)
