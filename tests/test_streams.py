"""Streams: settlement by arrival and under repair, pages by (time, id), crashes between a page and its commit."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from chatterscope.operators import facts as T
from chatterscope.sources import paged
from chatterscope.streaming import settlement

DAY = datetime(2026, 1, 1)
SCHEMA = "feed_id long, posted_at timestamp_ntz, observed_at timestamp_ntz, likes long, arrived_at timestamp_ntz, arrival long"


def hours(n):
    return None if n is None else DAY + timedelta(hours=n)


def feed(spark, path, rows, page=3):
    """rows: feed, post's hour, observed hour, likes, arrival's hour, arrival."""
    spark.createDataFrame([(f, hours(p), hours(o), n, hours(t), i) for f, p, o, n, t, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    paged.register(spark)
    return spark.readStream.format("paged").schema(SCHEMA).options(path=str(path), ts="arrived_at", key="arrival", page=page, slices=2).load()


def run(spark, tmp_path, stream, write, **options):
    settlement.drained(settlement.settle(stream, **options).writeStream.outputMode("update").foreachBatch(write), str(tmp_path / "ck"))
    return {r.feed_id: (r.settled, r.likes) for r in settlement.latest_changes(spark, str(tmp_path / "out"), ["feed_id"]).collect()}


def test_settlement(spark, tmp_path):
    write = settlement.write_changes(str(tmp_path / "out"))
    first = [(1, 0, 5, 3, 5, 1), (1, 0, 25, 9, 25, 2), (2, 0, 2, 4, 25, 3), (3, None, 90, 7, 25, 4), (4, 0, 30, None, 26, 5), (5, 0, None, 8, 26, 6)]
    assert run(spark, tmp_path, feed(spark, tmp_path / "log", first), write) == {1: (True, 9), 2: (False, 4), 3: (False, 7), 4: (True, None)}
    # later: a settled post is frozen, also for what is older in time; another goes on; a third ripens by a late row
    second = [(1, 0, 48, 20, 48, 7), (1, 0, 24, 1, 49, 8), (2, 0, 1, 6, 50, 9), (4, 0, 40, 5, 50, 10)]
    assert run(spark, tmp_path, feed(spark, tmp_path / "log", second), write) == {1: (True, 9), 2: (False, 6), 3: (False, 7), 4: (True, None)}


def test_repair_chooses_by_time(spark, tmp_path):
    write = settlement.write_changes(str(tmp_path / "out"))
    rows = [(1, 0, 48, 20, 1, 1), (1, 0, 24, 1, 2, 2), (1, 0, 24, 99, 3, 3), (2, 0, 5, 4, 4, 4), (2, 0, 1, 6, 5, 5), (1, 0, 30, 5, 6, 6)]
    assert run(spark, tmp_path, feed(spark, tmp_path / "log", rows), write, repair=True) == {1: (True, 1), 2: (False, 4)}


def rows_of(path, spark):
    return sorted((r.arrived_at, r.arrival) for r in spark.read.parquet(str(path)).collect())


def test_crash_between_page_and_commit(spark, tmp_path):
    """The page is written, then the run dies; the rerun writes the same batch again and no row twice."""
    log = [(i, 0, i, i, i // 3, i) for i in range(40)]  # several rows an instant, across pages
    stream = feed(spark, tmp_path / "log", log, page=7)
    write = settlement.write_changes(str(tmp_path / "out"))

    def dies(batch, batch_id):
        write(batch, batch_id)
        if batch_id == 0:
            raise RuntimeError("killed after the page, before the commit")

    with pytest.raises(StreamingQueryException, match="killed after the page"):
        settlement.drained(stream.writeStream.foreachBatch(dies), str(tmp_path / "ck"))
    assert rows_of(tmp_path / "out", spark)
    settlement.drained(stream.writeStream.foreachBatch(write), str(tmp_path / "ck"))
    assert rows_of(tmp_path / "out", spark) == rows_of(tmp_path / "log", spark)
    more = feed(spark, tmp_path / "log", [(99, 0, 1, 1, 13, 40), (99, 0, 1, 1, 14, 3), (99, 0, 1, 1, 15, 1)], page=7)
    settlement.drained(more.writeStream.foreachBatch(write), str(tmp_path / "ck"))
    got = rows_of(tmp_path / "out", spark)
    assert got == rows_of(tmp_path / "log", spark) and len(got) == len(set(got)) == 43


def test_a_changed_source_stops(spark, tmp_path):
    write = settlement.write_changes(str(tmp_path / "out"))
    settlement.drained(feed(spark, tmp_path / "log", [(1, 0, 1, 1, 1, 1)]).writeStream.foreachBatch(write), str(tmp_path / "ck"))
    other = feed(spark, tmp_path / "elsewhere", [(1, 0, 1, 1, 1, 1), (2, 0, 1, 1, 9, 2)])
    with pytest.raises(StreamingQueryException, match="differs from the one"):
        settlement.drained(other.writeStream.foreachBatch(write), str(tmp_path / "ck"))


def test_pages_tile_the_log(tmp_path, spark):
    feed(spark, tmp_path / "log", [(i, 0, i, i, i // 5, 100 - i) for i in range(33)])
    from pyspark.sql.types import _parse_datatype_string as parse

    reader = paged.PagedReader(parse(SCHEMA), {"path": str(tmp_path / "log"), "ts": "arrived_at", "key": "arrival", "page": "10", "slices": "3"})
    start, seen, sizes = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        got = [x for p in parts for b in reader.read(p) for x in b.to_pylist()]
        seen, sizes, start = seen + [(x["arrived_at"], x["arrival"]) for x in got], [*sizes, (len(parts), len(got))], end
    assert sizes == [(3, 10), (3, 10), (3, 10), (1, 3)] and len(set(seen)) == 33 == len(seen)
    assert reader.partitions(start, start) == []


def test_merging_versions(spark, tmp_path):
    empty = spark.createDataFrame([], "feed_id long, n long")
    apply = settlement.merge_batches(spark, str(tmp_path / "out"), lambda old, new: T.latest_per(old.unionByName(new), ["feed_id"], [F.col("n")]), empty)
    apply(spark.createDataFrame([(1, 1), (2, 5)], "feed_id long, n long"), 0)
    apply(spark.createDataFrame([(1, 3)], "feed_id long, n long"), 1)
    apply(spark.createDataFrame([(1, 99)], "feed_id long, n long"), 1)  # a batch seen before changes nothing
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()} == {(1, 3), (2, 5)}
