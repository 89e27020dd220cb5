"""Selection, readers and times: errors and the cases that the tables do not hold."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterscope.functions import calendar as C
from chatterscope.functions import text as X
from chatterscope.operators import selection as S
from chatterscope.sources import dump as D
from chatterscope.sources import jsonl as J


def test_selected_products(spark):
    rows = spark.createDataFrame([("A", "x"), ("B", "y"), (None, "y")], "code string, sector string")
    assert [r.code for r in S.select_products(rows, {"code": ["A ", "B"], "sector": ["y"]}).collect()] == ["B"]
    for chosen in ({"code": ["A", "Z"]}, {"code": [" "]}, {"code": ["A"], "sector": ["y"]}):
        with pytest.raises(ValueError):
            S.select_products(rows, chosen)


def test_ready(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "k string, v string")
    told = [S.ready(rows, e).first().ready for e in ({"a": "1", "c": "3"}, {"a": "1", "b": ""}, {"a": "1", "d": "4"}, {"a": "2"})]
    assert told == [True, False, False, False]


def test_limits():
    assert [S.clamped(n, 1, 12, 6) for n in (None, 0, 5, 99)] == [6, 1, 5, 12]


def test_numeric_order(spark):
    rows = spark.createDataFrame([("10 b",), ("9 z",), ("abc",), (None,), ("009 a",)], "x string")
    assert [r.x for r in rows.orderBy(*S.numeric_first("x")).collect()] == ["009 a", "9 z", "10 b", "abc", None]


def test_layer_states(spark):
    rows = spark.createDataFrame([("2024|f", False), ("2024|f", True), ("2023|f", None), ("2025|f", False), ("2024|", False), ("2024", False), (None, None), ("|f", None)], "generation string, dirty boolean")
    assert [r.state for r in S.layer_states(rows, "2024").collect()] == ["fresh", "stale", "stale", "missing", "missing", "missing", "missing", "missing"]


def test_coerced_time(spark):
    cases = {"1704067200": datetime(2024, 1, 1), "0": None, "": None, "2024-01-01T08:00:00+08:00": datetime(2024, 1, 1), "2024-01-01T00:00:00Z": datetime(2024, 1, 1), "2024-01-01 00:00:00.5": datetime(2024, 1, 1, 0, 0, 0, 500000), "2024-01-01": datetime(2024, 1, 1), "soon": None, None: None, "2023-12-31T19:30:00-04:30": datetime(2024, 1, 1)}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert [r.t for r in rows.select(C.coerced_time(F.col("raw")).alias("t")).collect()] == list(cases.values())


def test_checked_lines(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    read = lambda *lines: J.checked(spark.createDataFrame([(x,) for x in lines], "value string"), schema, required=("id",), positive=("id",), counters=("n",)).collect()
    assert [tuple(r) for r in read('{"id": 1, "name": "a", "n": 0}', "", '{"id": 2}')] == [(1, "a", 0), (2, None, None)]
    for bad in ('{"id": 0}', '{"id": 1, "n": -1}', '{"name": "a"}', '{"id": 1, "more": 2}', '{"id": "x"}', "{id", "[1]"):
        with pytest.raises(PySparkException):
            read('{"id": 1}', bad)


def test_candidates_by_product_and_day(spark, tmp_path):
    rows = spark.createDataFrame([("A", "d1", 1), ("A", "d2", 2), ("B", "d1", 3)], "code string, day string, id long")
    J.write_candidates(rows, f"{tmp_path}/c")
    assert [r.id for r in spark.read.json(f"{tmp_path}/c").where("code = 'A' and day = 'd2'").collect()] == [2]


@pytest.mark.parametrize(("raw", "plain"), [(r"a\nb", "a\nb"), (r"a\tb\rc", "a\tb\rc"), (r"a\'b", "a'b"), (r"a\\b", "a\\b"), (r"a\"b", 'a"b'), (r"a\0b\Zc", "a\0b\x1ac"), (r"100\% a\_b", r"100\% a\_b"), ("it''s", "it's"), ("plain", "plain"), (r"\q", "q")])
def test_unescaped(raw, plain):
    assert D.unescaped(raw) == plain


def test_dump_errors(spark):
    line = lambda x: spark.createDataFrame([(f"INSERT INTO `t` VALUES {x};",)], "value string")
    assert [tuple(r) for r in D.dump_rows(line("(1,'NULL',NULL),(2,'a,(b)''c',3.5)"), "t", ["a", "b", "c"]).collect()] == [("1", "NULL", None), ("2", "a,(b)'c", "3.5")]
    assert D.dump_rows(line("(1,'x')"), "t", ["a", "b"], keep=lambda r: r["b"] == "y").count() == 0
    for bad in ("(1,'x')", "(1,'open"):
        with pytest.raises(PySparkException):
            D.dump_rows(line(bad), "t", ["a"]).collect()


def test_import_needs_the_whole_pool(spark):
    stocks = spark.createDataFrame([(1, "A"), (2, "B")], "stock_id long, code string")
    posts = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-02"), (1, "2023-01-01")], "stock_id long, posted_at string")
    assert D.import_posts(posts, stocks, ["A"], "2024-01-01").count() == 1
    with pytest.raises(PySparkException):
        D.import_posts(posts, stocks, ["A", "C"], "2024-01-01").collect()


def test_lexicon_modes(spark):
    lexicon = {"x": ("entity_or_action", ("Bank",), ("sue",), ()), "y": ("entity_and_rumor", ("fund",), (), ("heard",)), "z": ("action", ("fund",), ("scam",), ())}
    texts = ["the bank", "they SUE", "a fund", "heard of a fund", "scam", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.lexicon_tags(F.col("t"), lexicon).alias("x"))
    assert [r.x for r in rows.collect()] == [["x"], ["x"], [], ["y"], ["z"], [], []]
