"""Streams as queries: each is drained over all that its table holds, and its result is a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterscope.plans.catalog import query
from chatterscope.sources import bindings as B
from chatterscope.sources import paged, shared
from chatterscope.streaming import settlement

OBSERVED = B.ctes("feeds", "comments") + ", o AS (SELECT feed_id, posted_at, commented_at + INTERVAL 20 HOUR * (comment_id % 4) AS tm, c.k AS likes, commented_at, comment_id FROM comments c JOIN feeds USING (feed_id)), x AS (SELECT *, tm >= posted_at + INTERVAL 24 HOUR AS ripe FROM o)"
SCHEMA = "feed_id long, posted_at timestamp_ntz, observed_at timestamp_ntz, likes long, arrived_at timestamp_ntz, arrival long"


def observations(spark, sf):
    """Counters seen of each post, in the order in which they arrive."""
    hours = F.make_dt_interval(F.lit(0), (F.col("comment_id") % 4 * 20).cast("int"))
    seen = B.comments(spark, sf).select("feed_id", (F.col("commented_at") + hours).alias("observed_at"), F.col("k").alias("likes"), F.col("commented_at").alias("arrived_at"), F.col("comment_id").alias("arrival"))
    both = seen.join(B.feeds(spark, sf).select("feed_id", "posted_at"), "feed_id")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("posted_at", "observed_at", "arrived_at")}
    return both.withColumns(times).select("feed_id", "posted_at", "observed_at", "likes", "arrived_at", "arrival")


def settled(spark, sf, repair):
    """The log is a stored table, in its order; a stream pages through it by (arrived_at, arrival) and keeps each post's counter as state.

    A page has 20,000 rows, of a log of over 32 pages a 32nd, and a million at most, whatever the log holds: a batch of the
    stream has its price also where it holds little. A page is read by one task for each 50,000 rows, and by four at least.
    """
    paged.register(spark)
    log, out, checkpoint = (shared.place(spark, f"settlement-{x}") for x in ("log", "out", "checkpoint"))
    order = ["arrived_at", "arrival"]
    observations(spark, sf).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", 4 << 20).parquet(log)
    page = min(max(20_000, -(-spark.read.parquet(log).count() // 32)), 1_000_000)
    stream = spark.readStream.format("paged").schema(SCHEMA).options(path=log, ts="arrived_at", key="arrival", page=page, slices=max(4, -(-page // 50_000))).load()
    settlement.drained(settlement.settle(stream, repair=repair).writeStream.outputMode("update").foreachBatch(settlement.write_changes(out)), checkpoint)
    return settlement.latest_changes(spark, out, ["feed_id"]).select("feed_id", "settled", "likes")


@query("t10_t2_settlement_stream", OBSERVED + " SELECT feed_id, bool_or(ripe) AS settled, CASE WHEN bool_or(ripe) THEN arg_min(likes, tm) FILTER (ripe) ELSE arg_max(likes, tm) END AS likes FROM x GROUP BY 1")
def settlement_stream(spark, sf):
    """Under repair the stream chooses what the batch twin (j2) does, whatever came late."""
    return settled(spark, sf, repair=True)


@query("t11_late_arrivals", OBSERVED + ", s AS (SELECT feed_id, bool_or(ripe) AS settled, min(struct_pack(t := commented_at, i := comment_id)) FILTER (ripe) AS f, max(struct_pack(t := commented_at, i := comment_id)) AS l FROM x GROUP BY 1) SELECT s.feed_id, s.settled, x.likes FROM s JOIN x ON x.feed_id = s.feed_id AND x.comment_id = CASE WHEN s.settled THEN s.f.i ELSE s.l.i END")
def late_arrivals(spark, sf):
    """In order of arrival: the first ripe observation is frozen, and what arrives later is not selected."""
    return settled(spark, sf, repair=False)
