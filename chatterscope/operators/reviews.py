"""Where a corrected annotation comes from: chains of review corrections walked to the run that first said it.

A correction's row names its decision as its run, ``review:<id>``. A hop goes from it to the row it corrects, and holds
only if all of it can be proved: the row is settled by a human, the decision exists, says ``correct``, names the very row that is
superseded and the very value, and the row before is of the same target, subject, kind and input. A chain that
breaks anywhere, or comes back to itself, has no origin.

Chains are walked by doubling: after each round a row points twice as far, so twenty hops take five rounds and a
million take twenty, and only rows that are still on their way take part. Whoever is on the way after more steps than
there are corrections is on a circle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.operators.facts import HUMAN
from chatterscope.sources.shared import written

#: What a correction and the row before it have in common.
SAME = ("target_type", "target_id", "subject_code", "kind", "input_hash")


def same_json(a: Column, b: Column) -> Column:
    """Both are JSON and say the same, whatever the order of keys and the blanks; text that is no JSON says nothing."""
    plain = lambda c: F.to_json(F.try_parse_json(c))
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def decision_of(run_id: Column) -> Column:
    """The decision's number in ``review:<id>``, written without signs or zeros before it; null for other runs and other forms."""
    return F.regexp_extract(run_id, r"^review:([1-9][0-9]{0,17})$", 1).try_cast("long")


def hops(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """annotation_id, run_id, review (its run is a review), before (the row it corrects; null where the hop does not hold).

    log: annotation_id, target_type, target_id, subject_code, kind, value_json, review_state, run_id, input_hash,
    supersedes_id. decisions: decision_id, annotation_id, decision, corrected_value_json.
    """
    review = F.coalesce(F.col("run_id").startswith("review:"), F.lit(False))
    rows = log.select("annotation_id", "run_id", review.alias("review"), "review_state", "supersedes_id", "value_json", F.struct(*SAME).alias("same"))
    asked = rows.where("review").withColumn("decision_id", decision_of(F.col("run_id"))).where(F.col("review_state").isin(*HUMAN) & F.col("decision_id").isNotNull() & F.col("supersedes_id").isNotNull())
    made = decisions.where("decision = 'correct' and corrected_value_json is not null").select("decision_id", F.col("annotation_id").alias("corrects"), "corrected_value_json")
    told = asked.join(made, "decision_id").where((F.col("supersedes_id") == F.col("corrects")) & same_json(F.col("corrected_value_json"), F.col("value_json")))
    earlier = log.select(F.col("annotation_id").alias("corrects"), F.struct(*SAME).alias("earlier"), F.try_parse_json("value_json").isNotNull().alias("sound"))
    agree = reduce(lambda x, y: x & y, [F.col(f"same.{c}").eqNullSafe(F.col(f"earlier.{c}")) for c in SAME])
    held = told.join(earlier, "corrects").where(agree & F.col("sound")).select("annotation_id", F.col("corrects").alias("before"))
    return rows.select("annotation_id", "run_id", "review").join(held, "annotation_id", "left")


def origins(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """annotation_id, origin_id, origin_run, hops of every row; all three null for rows whose chain does not hold. Ids are unique."""
    one = hops(log, decisions)
    going = F.col("before").isNotNull()
    reviews = written(one.where("review").select("annotation_id", F.col("before").alias("at"), F.lit(1).cast("long").alias("hops"), going.alias("going")), "reviews")
    reach, most = 1, reviews.count()
    while not reviews.where("going").isEmpty():
        if reach > most:  # more steps than corrections: what is left goes round
            reviews = reviews.withColumns({"at": F.when(~F.col("going"), F.col("at")), "going": F.lit(False)})
            break
        # a row that is no review is an end: it points to itself
        onward = reviews.select(F.col("annotation_id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("going").alias("further"), F.lit(True).alias("known"))
        far = reviews.where("going").join(onward, "at", "left")
        far = far.select("annotation_id", F.when(F.col("known"), F.col("next")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("further", F.lit(False)).alias("going"))
        reviews, reach = written(far.unionByName(reviews.where("not going")), "reviews"), 2 * reach
    first = one.where("not review").select("annotation_id", F.col("annotation_id").alias("at"), F.lit(0).cast("long").alias("hops"))
    ends = reviews.select("annotation_id", "at", "hops").unionByName(first).select("annotation_id", F.col("at").alias("origin_id"), F.when(F.col("at").isNotNull(), F.col("hops")).alias("hops"))
    runs = log.select(F.col("annotation_id").alias("origin_id"), F.col("run_id").alias("origin_run"))
    return ends.join(runs, "origin_id", "left").select("annotation_id", "origin_id", "origin_run", "hops")


def released(current: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """Current rows whose origin is an allowed run. runs: run_id, each once."""
    ends = found.select("annotation_id", "origin_id", F.col("origin_run").alias("_run"), "hops")
    allowed = runs.select(F.col("run_id").alias("_run"))
    return current.join(ends, "annotation_id").join(allowed, "_run", "left_semi").drop("_run")
