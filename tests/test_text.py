import pytest
from pyspark.sql import functions as F

from chatterscope.functions import text as X
from chatterscope.operators import folding
from chatterscope.sources import dump as D


@pytest.mark.parametrize("raw,ticker,code,mention", [("HK.03033", "03033.HK", "3033", "3033"), ("03033.hk", "03033.HK", "3033", "3033"), ("aapl.us", "AAPL.US", None, "us:AAPL"), ("XX.1", None, None, None), (None, None, None, None), ("00700.HK", "00700.HK", None, "700"), ("no", None, None, None)])
def test_tickers(spark, raw, ticker, code, mention):
    c = F.lit(raw).cast("string")
    r = spark.range(1).select(X.normalized_ticker(c).alias("t"), X.product_code(c).alias("c"), X.mention_code(c).alias("m")).first()
    assert (r.t, r.c, r.m) == (ticker, code, mention)


def test_cashtags_never_span_fields(spark):
    df = spark.createDataFrame([(1, "worth 3.1$", "$07226.HK$ and $Fund (07226.hk)$"), (2, None, "$not one$"), (3, None, None)], "id long, title string, body string")
    rows = X.cashtags(df, "id", ["title", "body"]).collect()
    assert [(r.id, r.ticker, r.raw_ticker, r.display_name, r.occurrences) for r in rows] == [(1, "07226.HK", "07226.HK", "Fund", 2)]


def test_prefilter(spark):
    df = spark.createDataFrame([(1, "a", 1, "ok then"), (2, "a", 1, "OK  then"), (3, None, 1, "ok then"), (4, "a", 1, " "), (5, "a", 1, None), (6, "a", 1, "$00700.HK$ 666"), (7, "a", 1, "[smile]??"), (8, "a", 2, "ok then")], "id long, author string, feed long, body string")
    got = {r.id: r.rule for r in X.prefilter(df, "id", "author", "feed", "body").collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: None, 4: "empty", 5: "empty", 6: "tag_only", 7: "sticker_only", 8: None}


def test_sentences_and_index(spark):
    assert X.sentence_spans("One. Two!  \nThree") == [(0, 4, "One."), (4, 9, "Two!"), (12, 17, "Three")] or [s[2] for s in X.sentence_spans("One. Two!  \nThree")] == ["One.", "Two!", "Three"]
    df = spark.createDataFrame([("One. Two. Three",)], "t string").select(X.sentences(F.col("t")).alias("s"))
    assert [df.select(X.sentence_index(F.col("s"), F.lit(i).cast("int"))).first()[0] for i in (0, 5, 99, None)] == [0, 1, 2, -1]


def test_folding(spark):
    a = "这只产品的费率比同类低不少，长期拿着没有问题"
    df = spark.createDataFrame([("k", 1, a), ("k", 2, a + "！"), ("k", 3, "完全不同的另外一句话，谈的是分红安排"), ("k", 4, ""), ("z", 5, a)], "k string, id long, t string")
    got = {r.id: (r.rep, r.distance) for r in folding.folded(df, ["k"], "id", "t").collect()}
    assert got == {1: (1, None), 2: (1, 0), 3: (3, None), 4: (4, None), 5: (5, None)}


def test_names_and_evidence():
    assert X.maximal_names("big fund and fund", {"fund": "a", "big fund": "b"}) == ["a", "b"]
    assert X.maximal_names("big fund only", {"fund": "a", "big fund": "b"}) == ["b"]
    assert X.locate("Ａ bc", "a BC") == (0, 4, "normalized")
    assert X.locate("abc", "bc") == (1, 3, "exact") and X.locate("abc", "x") == (None, None, None)


def test_dump(spark, tmp_path):
    p = tmp_path / "d.sql"
    p.write_text("-- note\nINSERT INTO `t` VALUES (1,'a\\'b, (x)',NULL),(2,'NULL','it''s');\nINSERT INTO `other` VALUES (9);\n")
    rows = D.read_dump(spark, str(p), "t", ["id", "a", "b"]).collect()
    assert [tuple(r) for r in rows] == [("1", "a'b, (x)", None), ("2", "NULL", "it's")]
    assert D.read_dump(spark, str(p), "t", ["id", "a", "b"], keep=lambda r: r["id"] == "2").count() == 1
    with pytest.raises(ValueError):
        list(D.tuples("INSERT INTO `t` VALUES (1,'open", 2))
    with pytest.raises(ValueError):
        list(D.tuples("INSERT INTO `t` VALUES (1,2,3);", 2))
