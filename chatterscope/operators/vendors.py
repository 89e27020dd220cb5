"""Which vendor's price series is active, and the switch to another.

A plan tells what each vendor delivered: code, vendor, interval, status, reason, n; several rows an interval are its chunks.
A vendor is complete for a code if every required interval is there, has bars and no chunk failed. The active series of a code
is replaced only by a complete one, as a whole; until then the old one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NO_DATA = "no_data_returned"


def completeness(plan: DataFrame, required: list[str], fine: str) -> DataFrame:
    """code, vendor, complete, empty: ``empty`` if the fine interval is known to hold nothing and nothing else failed."""
    ok, none = F.col("status") == "ok", F.coalesce(F.col("reason") == NO_DATA, F.lit(False))
    away = F.col("status") == "unavailable"
    each = plan.groupBy("code", "vendor", "interval").agg(
        F.coalesce(F.bool_and(ok), F.lit(False)).alias("_ok"), F.coalesce(F.bool_or(ok & (F.col("n") > 0)), F.lit(False)).alias("_some"),
        F.coalesce(F.bool_and(away & none), F.lit(False)).alias("_none"), F.coalesce(F.bool_or(away & ~none), F.lit(False)).alias("_failed"),
    )
    known = F.col("interval").isin(required)
    return each.groupBy("code", "vendor").agg(
        (F.bool_and(known & F.col("_ok") & F.col("_some")) & (F.count_distinct(F.when(known, F.col("interval"))) == len(required))).alias("complete"),
        (F.coalesce(F.bool_or((F.col("interval") == fine) & F.col("_none")), F.lit(False)) & ~F.bool_or("_failed")).alias("empty"),
    )


def chosen(plan: DataFrame, active: DataFrame, ranked: list[str], required: list[str], fine: str) -> DataFrame:
    """code, vendor, action for each code of the plan; active: code, vendor.

    The first vendor is tried; the next stands in only where the first is known to have no fine series and is itself complete.
    ``merge``: the active vendor goes on, or there is none yet; ``replace``: another one that is complete; ``keep``: another that is not.
    """
    first, *others = ranked
    state = completeness(plan, required, fine)
    lead = state.where(F.col("vendor") == first).select("code", F.col("empty").alias("_empty"))
    rank = F.array_position(F.array(*map(F.lit, others)), F.col("vendor")) if others else F.lit(0)
    stand_in = state.where(F.col("vendor").isin(others) & F.col("complete")).groupBy("code").agg(F.min_by("vendor", rank).alias("_other"))
    out = lead.join(stand_in, "code", "left").select("code", F.when(F.col("_empty") & F.col("_other").isNotNull(), F.col("_other")).otherwise(first).alias("vendor"))
    out = out.join(state.select("code", "vendor", "complete"), ["code", "vendor"]).join(active.select("code", F.col("vendor").alias("_now")), "code", "left")
    action = F.when(F.col("_now").isNull() | (F.col("_now") == F.col("vendor")), "merge").when(F.col("complete"), "replace").otherwise("keep")
    return out.select("code", "vendor", action.alias("action"))


def switched(spark: SparkSession, path: str, choice: DataFrame, bars: DataFrame, key: list[str]) -> None:
    """Writes the active table at path (bars' columns and vendor; folders by code) as the choice says.

    bars: the delivered ones of all vendors. Replaced codes hold the new vendor's bars only; merged codes keep old bars
    and take new ones by key, of which the later wins. One dynamic overwrite swaps the folders of the codes that change when its
    job commits, and leaves all others alone.
    """
    act = choice.where("action <> 'keep'").select("code", F.col("vendor").alias("_v"), "action")
    new = bars.join(act, (bars["code"] == act["code"]) & (bars["vendor"] == act["_v"]), "left_semi").withColumn("_new", F.lit(1))
    # a code without new bars is not written, so it keeps its own
    going = act.where("action = 'merge'").join(new.select("code").distinct(), "code", "left_semi")
    old = stored(spark, path, bars).join(going.select("code"), "code", "left_semi").withColumn("_new", F.lit(0))
    latest = W.partitionBy("code", *key).orderBy(F.desc("_new"))
    rows = old.unionByName(new).withColumn("_place", F.row_number().over(latest)).where("_place = 1").drop("_place", "_new")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("code").parquet(path)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The active table; it has to be there, if empty, since an error of reading must not look like an empty one."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)


def founded(path: str, bars: DataFrame) -> None:
    bars.write.partitionBy("code").parquet(path)
