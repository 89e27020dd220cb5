"""Checked JSON lines: every line is a record of the schema, no more and no less, or reading fails with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checked(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = (), positive: tuple[str, ...] = (), counters: tuple[str, ...] = ()) -> DataFrame:
    """lines: value. Unknown fields, values of another type, missing required ones, ids under 1 and counters under 0 are errors."""
    names = F.array(*[F.lit(f.name) for f in schema])
    wide = T.StructType([*schema, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select("value", parsed.alias("r"), F.json_object_keys("value").alias("keys"))
    r = lambda c: F.col(f"r.{c}")
    reason: Column = F.when(r("_bad").isNotNull() | F.col("keys").isNull(), "not a record of the schema").when(F.size(F.array_except("keys", names)) > 0, "unknown fields")
    for c in required:
        reason = reason.when(r(c).isNull(), f"{c} is missing")
    for c in positive:
        reason = reason.when(r(c) < 1, f"{c} is under 1")
    for c in counters:
        reason = reason.when(r(c) < 0, f"{c} is under 0")
    stop = F.raise_error(F.concat(reason, F.lit(": "), F.substring("value", 1, 200))).cast(schema)
    return rows.select(F.when(reason.isNotNull(), stop).otherwise(F.struct(*[r(f.name).alias(f.name) for f in schema])).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, **checks: tuple[str, ...]) -> DataFrame:
    return checked(spark.read.text(path), schema, **checks)


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidates by product and day, as JSON lines: a reader of one product's day opens its folder only."""
    rows.repartition("code", "day").write.partitionBy("code", "day").json(path)
