"""Queries against their SQL on small tables that the driver's smallest ones are unlike: large ids, texts that are empty or null."""

from datetime import datetime, timedelta

import duckdb

from chatterscope.plans import catalog


def both(spark, folder, name, **tables):
    """The query's rows and its SQL's, sorted; tables: rows and schema by name."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    told = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr), sorted(told.fetchall(), key=repr)


def events(*rows):
    """rows: event_id, user, value, k."""
    return [(i, datetime(2024, 1, 5) + timedelta(seconds=i), user, "view", value, f'{{"k": {k}}}') for i, user, value, k in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_leading_post_over_a_million_ids(spark, tmp_path):
    """Two posts two engagements apart, whose ids are five million apart; and two of equal value."""
    got, want = both(spark, tmp_path, "a21_account_leaders", events=events((4, 1, 7.0, 1), (5_000_004, 1, 5.0, 1), (8, 2, 6.0, 1), (1_000_008, 2, 5.0, 1), (12, 3, 9.0, 10)))
    assert got == want and {r[0]: r[-1] for r in got} == {"1": 5_000_004, "2": 8, "3": 12}


def test_evidence_in_texts_without_characters(spark, tmp_path):
    got, want = both(spark, tmp_path, "f52_evidence_location", documents=([(1, ""), (2, None), (3, "abc"), (4, "x" * 30), (5, "é\U0001f986" * 12)], "doc_id long, text string"))
    assert got == want and len(got) == 5
