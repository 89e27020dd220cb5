"""Interrupted, tampered with, changed: copies, backfills, vendor switches; a dump cut anywhere; natural order."""

import pytest
from pyspark.sql import functions as F

from chatterscope.operators import backfill as BF
from chatterscope.operators import copies as C
from chatterscope.operators import selection as S
from chatterscope.operators import vendors as V
from chatterscope.plans.resumed import Interrupted, once
from chatterscope.sources import dump_source as D

DUMP = """-- a dump
CREATE TABLE `posts` (
  `id` bigint NOT NULL,
  `title` varchar(99) DEFAULT NULL,
  `at` datetime DEFAULT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
INSERT INTO `posts` VALUES (1,'it\\'s, (one)','2024-01-02 03:04:05'),(2,NULL,NULL),(3,'NULL','2024-01-03 00:00:00');
INSERT INTO `posts_old` VALUES (9,'other','2024-01-01 00:00:00');
INSERT INTO `posts` VALUES (4,'中文\\n;',NULL);
INSERT INTO `posts` VALUES (5,'last','2024-01-05 00:00:00')"""


@pytest.fixture
def dump(spark, tmp_path):
    D.register(spark)
    (tmp_path / "a.sql").write_text(DUMP, encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("INSERT INTO `posts` VALUES (7,'no','2024-01-05 00:00:00');\n")
    return tmp_path


@pytest.mark.parametrize("split", [1, 7, 64, 100_000])
def test_dump_cut_anywhere(spark, dump, split):
    rows = spark.read.format("sqldump").schema("title string, id long, at timestamp_ntz").options(path=str(dump), table="posts", split=split).load()
    got = sorted((r["id"], r["title"], str(r["at"])) for r in rows.collect())
    assert got == [(1, "it's, (one)", "2024-01-02 03:04:05"), (2, None, "None"), (3, "NULL", "2024-01-03 00:00:00"), (4, "中文\n;", "None"), (5, "last", "2024-01-05 00:00:00")]


def test_dump_columns_and_filters(spark, dump):
    load = lambda **o: spark.read.format("sqldump").options(path=f"{dump}/a.sql", table="posts", **o)
    assert load().load().dtypes == [("id", "string"), ("title", "string"), ("at", "string")]
    rows = load(columns="id,title,at").schema("id long, title string").load()
    ids = lambda condition: sorted(r["id"] for r in rows.where(condition).collect())
    assert ids("title is null") == [2]
    assert ids("title is not null and id <= 3") == [1, 3]
    assert ids("id in (4, 5, 99)") == [4, 5]
    assert ids("title = 'last'") == [5]
    assert ids("title > 'NULL' and id <> 4") == [1, 5]
    assert ids("title like '%one%'") == [1]
    reader = D.SqlDump({"path": f"{dump}/a.sql", "table": "posts"}).reader(rows.schema)
    assert list(reader.pushFilters([D.S.EqualTo(("id",), 4)])) == []  # Spark has nothing left to apply
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[{"id": 4, "title": "中文\n;"}]]


def test_dump_errors(spark, dump):
    with pytest.raises(Exception, match="blocked: the dump's posts lacks gone"):
        spark.read.format("sqldump").schema("gone string").options(path=str(dump), table="posts").load().collect()
    with pytest.raises(Exception, match="3 columns, 2 expected"):
        spark.read.format("sqldump").schema("id long").options(path=str(dump), table="posts", columns="id,title").load().collect()
    with pytest.raises(Exception, match="no CREATE statement of absent"):
        spark.read.format("sqldump").options(path=str(dump), table="absent").load()


@pytest.fixture
def source(spark):
    rows = [(i, None if i % 10 == 0 else f"t{i}", i * 0.5) for i in range(200)] + [(None, "no key", 1.0)]
    return C.Table("facts", spark.createDataFrame(rows, "id long, text string, x double"), ("id",))


def test_copy_is_resumed(spark, source, tmp_path):
    other, at = C.Table("more", source.rows.limit(0), ("id",)), f"{tmp_path}/copy"
    with pytest.raises(Interrupted):
        C.copied(spark, [source, other], at, slices=4, progress=once(2))
    part = C.held(spark, at, source).count()
    assert 0 < part < 201
    with pytest.raises(ValueError, match="not been verified"):
        C.opened(spark, at, source)
    with pytest.raises(ValueError, match="not empty"):
        C.copied(spark, [source, other], at)
    written = []
    told = {r["name"]: r["n"] for r in C.copied(spark, [source, other], at, slices=4, resume=True, progress=lambda n, i: written.append(n)).collect()}
    assert told == {"facts": 201, "more": 0}
    assert C.differences(source.rows, C.opened(spark, at, source), source.key).isEmpty()
    C.copied(spark, [source, other], at, slices=4, resume=True, progress=lambda n, i: written.append("again"))
    assert "again" not in written  # verified tables are left alone


def test_tampered_copy_is_not_activated(spark, source, tmp_path):
    at = f"{tmp_path}/copy"

    def tamper(name, i):
        if i == 0:  # a row that a later slice holds: the count stays, a value differs
            late = source.rows.where((C.part_of(source.key, 2) == 1) & F.col("id").isNotNull()).orderBy("id").limit(1)
            late.withColumn("x", F.col("x") + 1).write.mode("append").parquet(f"{at}/facts")
            raise Interrupted

    with pytest.raises(Interrupted):
        C.copied(spark, [source], at, slices=2, progress=tamper)
    with pytest.raises(C.Differs):
        C.copied(spark, [source], at, slices=2, resume=True)
    with pytest.raises(ValueError, match="not been verified"):
        C.opened(spark, at, source)
    assert [r["change"] for r in C.differences(source.rows, C.held(spark, at, source), source.key).collect()] == ["changed"]


def test_differences(spark, source):
    copy = source.rows.where("id <> 5 or id is null").withColumn("text", F.when(F.col("id") == 10, "").otherwise(F.col("text")))
    copy = copy.unionByName(spark.createDataFrame([(900, "extra", 0.0), (7, "t7", 3.5)], source.rows.schema))
    got = {(r["id"], r["change"]) for r in C.differences(source.rows, copy, source.key).collect()}
    assert got == {(5, "missing"), (10, "changed"), (900, "extra"), (7, "extra")}  # a repeated row is one too many


def doubled(rows, pool):
    return rows.join(pool, "code", "left").select("id", "code", "t")


@pytest.fixture
def posts(spark):
    return spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 41)], "id long, code string")


def test_backfill_goes_on_under_the_same_rule_only(spark, posts, tmp_path):
    pool = spark.createDataFrame([("a", "1"), ("b", None)], "code string, t string")
    made = lambda p: BF.Backfill(spark, f"{tmp_path}/fill", doubled, "v1", p, "id", "t")
    first = made(pool)
    with pytest.raises(Interrupted):
        first.run(posts, 4, progress=once(2))
    assert first.filled().count() == 20
    with pytest.raises(BF.NotReady, match="not finished"):
        first.activate()
    whole = spark.createDataFrame([("a", "1"), ("b", "2")], "code string, t string")
    changed = made(whole)
    with pytest.raises(ValueError, match="rule or its pool changed"):
        changed.run(posts, 4, resume=True)
    # a range that was written and not told of is written again, not doubled
    first.rule(posts.where("id > 20 and id <= 30"), pool).write.parquet(f"{tmp_path}/fill/pass-0/through=30")
    assert first.filled().count() == 20
    first.run(posts, 2, resume=True)
    assert sorted(r["id"] for r in first.filled().collect()) == list(range(1, 41))
    assert {r["code"]: (r["n"], r["unresolved"]) for r in first.audit("code").collect()} == {"a": (20, 0), "b": (20, 20)}
    with pytest.raises(BF.NotReady, match="20 rows are unresolved"):
        first.activate()
    with pytest.raises(BF.NotReady, match="another rule"):
        changed.activate()
    changed.run(posts, 3)
    changed.activate()
    assert changed.active().where("t is not null").count() == 40
    with pytest.raises(Interrupted):
        first.run(posts, 4, progress=once(1))
    assert changed.active().count() == 40  # a new pass does not touch the active one


def test_backfill_of_odd_rows(spark, posts, tmp_path):
    pool = spark.createDataFrame([("a", "1")], "code string, t string")
    fill = BF.Backfill(spark, f"{tmp_path}/fill", doubled, "v1", pool, "id", "t")
    with pytest.raises(ValueError, match="nothing has been filled"):
        fill.filled()
    fill.run(posts.limit(0), 4)
    assert fill.last()["status"] == "populated"
    with pytest.raises(ValueError, match="1 rows have no id"):
        fill.run(posts.unionByName(spark.createDataFrame([(None, "a")], posts.schema)), 2)


def test_vendor_is_replaced_only_by_a_complete_one(spark, tmp_path):
    plan = [
        ("full", "main", "1d", "ok", None, 2), ("full", "main", "30m", "ok", None, 1),
        ("cut", "main", "1d", "ok", None, 2), ("cut", "main", "30m", "ok", None, 2), ("cut", "main", "30m", "unavailable", "timeout", 0),
        ("none", "main", "1d", "ok", None, 2), ("none", "main", "30m", "unavailable", V.NO_DATA, 0), ("none", "spare", "1d", "ok", None, 1), ("none", "spare", "30m", "ok", None, 1),
        ("bare", "main", "1d", "ok", None, 0), ("bare", "main", "30m", "ok", None, 1),
        ("more", "main", "1d", "ok", None, 1), ("more", "main", "30m", "ok", None, 1), ("more", "main", "5m", "ok", None, 1),
        ("same", "main", "1d", "ok", None, 1), ("new", "main", "1d", "ok", None, 1),
    ]
    plan = spark.createDataFrame(plan, "code string, vendor string, interval string, status string, reason string, n long")
    active = spark.createDataFrame([(c, "old") for c in ("full", "cut", "none", "bare", "more")] + [("same", "main")], "code string, vendor string")
    choice = V.chosen(plan, active, ["main", "spare"], ["1d", "30m"], "30m")
    want = {"full": ("main", "replace"), "cut": ("main", "keep"), "none": ("spare", "replace"), "bare": ("main", "keep"), "more": ("main", "keep"), "same": ("main", "merge"), "new": ("main", "merge")}
    assert {r["code"]: (r["vendor"], r["action"]) for r in choice.collect()} == want

    schema, at = "code string, day int, close double, vendor string", f"{tmp_path}/bars"
    V.founded(at, spark.createDataFrame([(c, d, 1.0, "old") for c in ("full", "cut", "none") for d in (1, 2)] + [("same", 1, 1.0, "main"), ("same", 2, 1.0, "main")], schema))
    new = [("full", 9, 2.0, "main"), ("cut", 9, 2.0, "main"), ("none", 8, 2.0, "main"), ("none", 9, 2.0, "spare"), ("same", 2, 2.0, "main"), ("same", 3, 2.0, "main"), ("new", 1, 2.0, "main")]
    V.switched(spark, at, choice, spark.createDataFrame(new, schema), ["day"])
    got = sorted(tuple(r) for r in V.stored(spark, at, spark.createDataFrame([], schema)).collect())
    assert got == sorted([("full", 9, 2.0, "main"), ("cut", 1, 1.0, "old"), ("cut", 2, 1.0, "old"), ("none", 9, 2.0, "spare"), ("same", 1, 1.0, "main"), ("same", 2, 2.0, "main"), ("same", 3, 2.0, "main"), ("new", 1, 2.0, "main")])


def test_natural_order(spark):
    names = ["file10", "File2", "file2", "file02b", "file2b10", "file2b9", "", None, "file", "é1", "e2", "10", "9", "中10", "中9", "阿", "file99999999999999999999999999999999999999999", "file100000000000000000000000000000000000000000"]
    t = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    sorted_ = lambda **k: [r["name"] for r in t.orderBy(*S.natural_order("name", ["i"], **k)).collect()]
    up = ["9", "10", "阿", "中9", "中10", "é1", "e2", "file", "File2", "file2", "file02b", "file2b9", "file2b10", "file10", names[-2], names[-1], "", None]
    assert sorted_() == up
    down = sorted_(descending=True)
    assert down[-2:] == ["", None] and down[:4] == [names[-1], names[-2], "file10", "file2b10"] and down[-4:-2] == ["10", "9"]
    assert down.index("File2") < down.index("file2")  # ties ascend in both directions
