"""Streams: windowed observation, counter settlement with state, and micro-batches that are written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """Tumbling counts and sums; windows are aligned to Hong Kong days, eight hours from UTC's.

    Without ``late`` every row counts however late it comes, and all windows stay in the state (for the modes update and
    complete); with it, rows later than that are dropped and windows end.
    """
    events = events.withWatermark(ts, late) if late else events
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def settle(observations: DataFrame, hours: int = 24, repair: bool = False) -> DataFrame:
    """feed_id, settled, observed_at, likes of every post that a batch touches, in update mode.

    observations: feed_id, posted_at, observed_at, likes (null: not obtained), arrived_at, arrival (their order). In
    order of arrival the last observation counts until one comes that is ``hours`` younger than the post; that one is
    frozen, and later arrivals are kept out, be they early or late in time. ``repair`` chooses anew at each
    batch from all that came: the ripe observation of least time, else the one of greatest time. Observations seen
    again change nothing once a post is settled or under repair; those without a time are ignored.

    The state is two observations a post, whatever their number: the first that is ripe and the last of all, by arrival or
    by time. Both are least or greatest by an order of the rows' own, so how a log is cut into batches changes nothing.
    """
    observations.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at, posted, arrival = F.col("observed_at").cast("timestamp_ntz"), F.col("posted_at").cast("timestamp_ntz"), F.col("arrival")
    since = F.col("arrived_at").cast("timestamp_ntz") - F.expr("timestamp_ntz'1970-01-01'")
    came = F.struct(since.isNull(), since, arrival.isNull(), arrival)  # unknown ones last
    latest = F.struct(since.isNotNull(), -since, arrival.isNotNull(), -arrival)  # the same, descending
    ripe = at >= posted + F.make_dt_interval(hours=F.lit(hours))
    value = F.struct(at.alias("observed_at"), F.col("likes").alias("likes"))
    first, last = ((at, came), (at, latest)) if repair else ((came,), (came,))
    kept = observations.where(at.isNotNull()).groupBy("feed_id").agg(
        F.min(F.when(ripe, F.struct(*first, value.alias("value"))))["value"].alias("first"), F.max(F.struct(*last, value.alias("value")))["value"].alias("last")
    )
    chosen = F.coalesce("first", "last")
    return kept.select("feed_id", F.col("first").isNotNull().alias("settled"), chosen["observed_at"].alias("observed_at"), chosen["likes"].alias("likes"))


def write_changes(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's rows are the folder ``v=<batch>``, and a batch that is run again writes the same folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def latest_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Each key's row of its last batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "v")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("_r")).select(*keys, "_r.*")


def drained(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over all that is there now."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_batches(spark: SparkSession, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table as versions ``path/v=N``; a batch seen before changes nothing.

    The version's number is the batch's, so a replay after a crash finds its own result or writes it again, and a
    reader takes the last one marked complete.
    """

    def versions() -> list[int]:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        found = [s.getPath() for s in fs.listStatus(fs_path)]
        done = [p for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done)

    def apply(batch: DataFrame, batch_id: int) -> None:
        have = versions()
        if batch_id in have:
            return
        before = [v for v in have if v < batch_id]
        old = spark.read.parquet(f"{path}/v={before[-1]}") if before else empty
        merge(old, batch).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return apply
