"""Settlement costs what its rows cost: state without Python, pages found by footers; batches change nothing."""

import glob
import io
from contextlib import redirect_stdout

from pyspark.sql.types import _parse_datatype_string as parse

from chatterscope.sources import paged
from chatterscope.streaming import settlement
from tests.test_streams import SCHEMA, feed, hours, run


def test_the_order_of_the_rows_counts_not_the_batch(spark, tmp_path):
    """A second batch holds arrivals that are before the first batch's, as after a replay in another order."""
    def stream(name, *rows):
        spark.createDataFrame([(f, hours(p), hours(o), n, hours(t), i) for f, p, o, n, t, i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))

    late, early = ((1, 0, 48, 20, 48, 7), (2, 0, 9, 4, 25, 3), (3, 0, 60, 1, 7, 5)), ((1, 0, 25, 9, 25, 2), (2, 0, 2, 6, 20, 9), (3, 0, 5, 2, 8, 6))
    write = settlement.write_changes(str(tmp_path / "out"))
    run(spark, tmp_path, stream("log", *late), write)
    assert run(spark, tmp_path, stream("log", *early), write) == {1: (True, 9), 2: (False, 4), 3: (True, 1)}


def test_repair_takes_the_first_to_arrive_of_equal_times(spark, tmp_path):
    write = settlement.write_changes(str(tmp_path / "out"))
    rows = [(1, 0, 5, 3, 9, 2), (1, 0, 5, 4, 9, 1), (2, 0, 30, 7, 9, 4), (2, 0, 30, 8, 9, 3)]
    assert run(spark, tmp_path, feed(spark, tmp_path / "log", rows), write, repair=True) == {1: (False, 4), 2: (True, 8)}


def test_state_is_kept_without_python(spark, tmp_path):
    rows = feed(spark, tmp_path / "log", [(1, 0, 5, 3, 5, 1)])
    for repair in (False, True):
        with redirect_stdout(io.StringIO()) as told:
            settlement.settle(rows, repair=repair).explain()
        assert "StateStoreSave" in told.getvalue() and "InPandas" not in told.getvalue()


def test_the_end_of_a_page_is_found_without_reading_what_follows(spark, tmp_path):
    """Files in the log's order; the data of all but the first two is made unreadable, their footers are left."""
    for at in range(0, 40, 10):
        feed(spark, tmp_path / "log" / f"{at:02}", [(i, 0, i, i, i // 2, 100 - i) for i in range(at, at + 10)])
    options = {"path": str(tmp_path / "log"), "ts": "arrived_at", "key": "arrival", "page": "12", "slices": "2"}
    reader = paged.PagedReader(parse(SCHEMA), options)
    whole = [reader.initialOffset()]
    while (end := reader.latestOffset()) != whole[-1]:
        reader.partitions(whole[-1], end)
        whole.append(end)
    assert len(whole) == 5 and [(w["ts"], w["id"]) for w in whole[1:3]] == [(hours(5).isoformat(), 90), (hours(11).isoformat(), 78)]
    for path in glob.glob(str(tmp_path / "log" / "[23]0" / "*.parquet")):
        data = bytearray(open(path, "rb").read())
        end = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
        data[4:end] = b"\xff" * (end - 4)
        open(path, "wb").write(bytes(data))
    again = paged.PagedReader(parse(SCHEMA), options)
    again.initialOffset()
    assert again.latestOffset() == whole[1]
