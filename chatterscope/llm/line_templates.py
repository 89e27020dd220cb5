"""Line dedup by a log-template tree, in DataFrame functions only.

A line is parsed down a tree of fixed depth: its token count, then its first ``depth`` tokens, fields with digits
or @ generalised to ``<*>`` where they are not most of the line. In a leaf, a token that fewer than ``min_docs`` documents hold at its position
is a variable field too, if at least ``min_constant`` of the line's tokens stay constant; what is left is the
line's template. In lines of over ``long_tokens`` tokens two documents take the place of ``min_docs``: a passage that
long does not recur by chance. A template found in so many documents of different text is recurring: its lines are dropped
from every document but the one of smallest id, so the corpus keeps one copy. Copies of a whole text count
once, since they are not boilerplate but duplicates, which another operator treats.

Defined cases: a null text stays null and has no lines; a null doc_id is a document like others and sorts before all
ids; rows equal in id and text share their fate; a document all of whose lines recur and are kept by others
is left without words (``emptied`` tells which those are; n_dropped counts its lines), never null; lines without words, and lines under ``min_tokens`` tokens, are
never dropped; a table without rows gives no rows; further columns are
passed through, but for columns named n_lines or n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import BLANKS, Scratch

FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*"


#: Bits of the map of leaves that may matter: 4 MB in all, whatever the input.
MAP_BITS = 1 << 25


def parsed(docs: DataFrame, depth: int, min_constant: float, min_tokens: int, long_tokens: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, leaf, line (generalised), lh (its hash), long: one row per line that may be dropped."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    plain = F.trim(F.when(F.col("raw").rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace("raw", BLANKS, " ")).otherwise(F.col("raw")))
    rows = rows.select("doc_id", "th", "pos", plain.alias("plain"))
    rows = rows.withColumn("n", F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    general = F.regexp_replace("plain", FIELD, "<*>")
    few = F.regexp_count(general, F.lit(r"<\*>")) <= (1 - min_constant) * F.col("n")
    rows = rows.withColumn("line", F.when(F.col("plain").rlike("[0-9@]") & few, general).otherwise(F.col("plain")))
    return rows.where((F.col("line") != "") & (F.col("n") >= min_tokens)).select("doc_id", "th", "pos", F.xxhash64("n", F.substring_index("line", " ", depth)).alias("leaf"), "line", F.xxhash64("line").alias("lh"), (F.col("n") > long_tokens).alias("long"))


def marked(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """The rows of these leaves, and of a few others: a bit map is broadcast, so that no line of another leaf is shuffled."""
    place = F.shiftrightunsigned("leaf", 64 - MAP_BITS.bit_length() + 1)
    maps = leaves.select(place.alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p)").alias("_part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p))").alias("_map"))
    rows = rows.withColumn("_p", place).withColumn("_part", F.expr("bitmap_bucket_number(_p)"))
    at = F.expr("bitmap_bit_position(_p)").cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(maps), "_part").where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1)
    return held.drop("_p", "_part", "_map")


def templates(lines: DataFrame, depth: int, min_constant: float, need: Column) -> DataFrame:
    """leaf, lh, template, for the lines of leaves with several. lines: leaf, lh, long, n_docs, line, each once.

    Tokens that too few documents hold at their place are variable. Tokens go by hash: what a line has fixed and variable is one number.
    """
    several = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leaf")
    tokens = lines.join(several, "leaf", "left_semi").select("leaf", "lh", "long", "n_docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    tokens = tokens.select("leaf", "lh", "long", "n_docs", "at", F.xxhash64("leaf", "at", "token").alias("place"), (F.col("token") == "<*>").alias("open"))
    support = tokens.groupBy("place").agg(F.sum("n_docs").alias("support"))
    fixed = ~F.col("open") & ((F.col("support") >= need) | (F.col("at") < depth))
    general = F.bit_xor(F.when(fixed, F.col("place")).otherwise(F.xxhash64("leaf", "at", F.lit("<*>"))))
    told = tokens.join(support, "place").groupBy("leaf", "lh").agg(general.alias("general"), F.avg(fixed.cast("int")).alias("share"))
    return told.select("leaf", "lh", F.when(F.col("share") >= min_constant, F.xxhash64("leaf", "general")).otherwise(F.xxhash64("leaf", "lh")).alias("template"))


def dropped_lines(docs: DataFrame, depth: int, min_docs: int, min_constant: float, min_tokens: int, long_tokens: int) -> DataFrame:
    """doc_id, th, drop: positions of the lines to drop, for the documents that have some."""
    scratch = Scratch(docs.sparkSession, "line-templates")
    rows = scratch.put(parsed(docs, depth, min_constant, min_tokens, long_tokens), compression="zstd")
    need = F.when(F.col("long"), 2).otherwise(min_docs)  # the token count is part of the leaf, so a leaf is long or not
    leaves = scratch.put(rows.select("leaf", "long", "th").distinct().groupBy("leaf", "long").count().where(F.col("count") >= need).select("leaf"))
    hot = scratch.put(marked(rows, leaves), compression="zstd")
    scratch.drop(rows)
    lines = hot.groupBy("leaf", "lh", "long", "th").agg(F.first("line").alias("line")).groupBy("leaf", "lh", "long").agg(F.count(F.lit(1)).alias("n_docs"), F.first("line").alias("line"))
    lines = scratch.put(lines.join(leaves, "leaf", "left_semi"), compression="zstd")
    found = hot.select("doc_id", "th", "pos", "leaf", "lh", "long").join(templates(lines, depth, min_constant, need), ["leaf", "lh"], "left")
    found = scratch.put(found.select("doc_id", "th", "pos", F.coalesce("template", F.xxhash64("leaf", "lh")).alias("template"), "long"))
    scratch.drop(hot, lines, leaves)
    each = found.groupBy("template", "long", "th").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    recurring = each.groupBy("template", "long").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("unnamed").alias("unnamed")).where(F.col("n") >= need).drop("long")
    first = F.when(F.col("unnamed"), F.col("doc_id").isNull()).otherwise(F.col("doc_id").eqNullSafe(F.col("first")))
    drops = found.join(recurring, "template").where(~first)
    return scratch.put(drops.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")))


def emptied(out: DataFrame) -> Column:
    """Of the rows of ``drop_recurring_lines``: the text lost lines and has no word left."""
    return (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")


def drop_recurring_lines(docs: DataFrame, depth: int = 3, min_docs: int = 8, min_constant: float = 0.5, min_tokens: int = 1, long_tokens: int = 20) -> DataFrame:
    """All columns of docs with the text's recurring lines dropped (n_chars follows), and n_lines, n_dropped."""
    drops = dropped_lines(docs, depth, min_docs, min_constant, min_tokens, long_tokens).withColumnsRenamed({"doc_id": "__lt_id", "th": "__lt_th", "drop": "__lt_drop"})
    key = F.col("doc_id").eqNullSafe(F.col("__lt_id")) & (F.xxhash64("text") == F.col("__lt_th"))
    out = docs.join(drops.hint("shuffle_hash"), key, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__lt_drop", i)), "\n")
    out = out.drop("n_lines", "n_dropped").withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_dropped": F.coalesce(F.size("__lt_drop"), F.lit(0)).cast("long"), "text": F.when(F.col("__lt_drop").isNull(), F.col("text")).otherwise(kept)})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__lt_drop").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
