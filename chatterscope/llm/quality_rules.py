"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character-class histogram and common-word histogram are compared with a reference of its
language by Jensen-Shannon distance (base 2, square root). References are medians of the shares over all
documents of the language with at least ``min_words`` words, so a junk group of up to half the rows does not
move them. A document is rejected if both distances together are over ``max_js``. Documents shorter than ``min_words`` are never rejected by divergence (a few words say nothing).

Beside it stand four countable rules: words, symbols, repeated lines and words inside repeated 8-word windows.

Defined cases: a null text has no words; a null language is the language ``und``; languages without a fixed
list use the lists of all languages; repeated rows and repeated ids give one result row each; a table without
rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import BLANKS, Scratch

#: Function words by language.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are as with be by at this from or".split(),
    "fr": "de la le et les des en un une que est pour qui dans par sur au pas plus elle".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Character classes: all but the last by pattern, the last holds what is left.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "blank": r"\x20\x09-\x0D", "point": r".,;:!?'()\"-", "symbol": r"#*$%&|<>"}


def _counted(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def features(docs: DataFrame) -> DataFrame:
    """Per row: the countable rules' figures and both histograms."""
    lists = F.coalesce(*[F.when(F.col("_lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON_WORDS.items()], F.array(*map(F.lit, sorted({x for v in COMMON_WORDS.values() for x in v}))))
    t = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("_lang"), t.alias("_t"))
    df = df.withColumn("_w", F.filter(F.split("_t", BLANKS), lambda x: x != ""))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_win", F.when(F.size("_h") >= 8, F.transform(F.sequence(F.lit(1), F.size("_h") - 7), lambda i: F.xxhash64(F.slice("_h", i, 8)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    df = df.withColumn("_s", F.when(F.col("_twice"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get("_s", j)["h"] == F.get("_s", k)["h"]
    found = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    df = df.withColumn("_at", F.when(F.col("_twice"), F.array_sort(F.transform(found, lambda j: F.get("_s", j)["i"]))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + 8 - F.greatest(i, a["end"])).alias("n"), (i + 8).alias("end"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumn("_list", lists)
    df = df.withColumn("_common", F.filter("_w", lambda x: (F.length(x) <= 5) & F.array_contains("_list", x)))
    counts = F.transform("_list", lambda c: F.size(F.filter("_common", lambda x: x == c)).cast("double"))
    classes = [_counted(F.col("_t"), p).cast("double") for p in CLASSES.values()]
    return df.select(
        "doc_id", "_lang",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twice"), F.aggregate("_at", zero, step, lambda a: a["n"])).otherwise(0).cast("long").alias("n_repeat_words"),
        F.length("_t").cast("double").alias("_chars"), F.array(*classes).alias("_classes"), counts.alias("_counts"),
        F.size("_common").cast("double").alias("_n_common"),
    )


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: 0.5 * (part(a, b) + part(b, a))), F.lit(0.0), lambda s, x: s + x)))


def _shared(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def quality_rules(docs: DataFrame, min_words: int = 50, max_js: float = 0.44) -> DataFrame:
    """One row per input row: doc_id, the rules' figures, base_failed, kept, char_js, word_js."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = scratch.put(features(docs))
    n, chars = F.col("n_words").cast("double"), F.col("_chars")
    left = lambda a, total: F.concat(F.transform(a, lambda x: F.try_divide(x, total)), F.array(F.try_divide(total - F.aggregate(a, F.lit(0.0), lambda s, x: s + x), total)))
    rows = rows.withColumn("_p", left(F.col("_classes"), chars)).withColumn("_q", left(F.col("_counts"), n))
    wide = 1 + max(len(COMMON_WORDS["en"]), len({x for v in COMMON_WORDS.values() for x in v}))
    medians = [F.percentile_approx(F.get("_p", F.lit(i)), 0.5, 1000).alias(f"p{i}") for i in range(len(CLASSES) + 1)]
    medians += [F.percentile_approx(F.get("_q", F.lit(i)), 0.5, 1000).alias(f"q{i}") for i in range(wide)]
    ref = rows.where(F.col("n_words") >= min_words).groupBy("_lang").agg(*medians)
    ref = ref.select(
        "_lang", _shared(F.array(*[f"p{i}" for i in range(len(CLASSES) + 1)])).alias("_rp"),
        _shared(F.array(*[F.coalesce(f"q{i}", F.lit(0.0)) for i in range(wide)])).alias("_rq"),
    )
    rows = rows.join(scratch.put(ref), "_lang", "left")
    long = n >= min_words
    rows = rows.withColumn("char_js", F.when(long, _js(F.col("_p"), F.col("_rp"))))
    rows = rows.withColumn("word_js", F.when(long, _js(F.col("_q"), F.slice("_rq", 1, F.size("_q")))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = F.coalesce("char_js", F.lit(0.0)) + F.coalesce("word_js", F.lit(0.0)) <= max_js
    return rows.select(
        "doc_id", "n_words", "word_chars", F.get("_classes", F.lit(5)).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & fine).alias("kept"), "char_js", "word_js",
    )
