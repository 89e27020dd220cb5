"""The audit report of the annotation work, as one tall table: section, name, measure, value.

Unknown is never zero: a rate without a denominator is null, runs that tell no usage are counted as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.operators import facts

USAGE = ("input_count", "success_count", "error_count")
TOKENS = ("token_input", "token_output", "token_reasoning")


def tall(rows: DataFrame, section: str, name: Column, measures: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
    return rows.select(F.lit(section).alias("section"), name.cast("string").alias("name"), each.alias("_m")).select("section", "name", "_m.*")


def counted(rows: DataFrame, section: str, name: Column, measure: Column) -> DataFrame:
    """One row a (name, measure) with its count."""
    return rows.groupBy(name.cast("string").alias("name"), measure.cast("string").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "measure", "value")


def queue(jobs: DataFrame, errors: int) -> list[DataFrame]:
    """Jobs a task and status, the completion, the most frequent last errors of dead jobs."""
    done = jobs.groupBy("task").agg(F.bround(F.count_if(F.col("status") == "done") / F.count(F.lit(1)), 4).alias("completion"))
    dead = jobs.where("status = 'dead'").groupBy(F.substring(F.coalesce("last_error", F.lit("")), 1, 120).alias("error")).agg(F.count(F.lit(1)).alias("jobs"))
    return [counted(jobs, "queue", F.col("task"), F.col("status")), tall(done, "queue", F.col("task"), ["completion"]), tall(dead.orderBy(F.desc("jobs"), "error").limit(errors), "dead letters", F.col("error"), ["jobs"])]


def usage(runs: DataFrame, last: int) -> DataFrame:
    """The last runs by task. A run that is no rule's and tells no tokens is of unknown usage, and none of its tokens count."""
    unknown = F.col("token_input").isNull() & ~F.col("provider").eqNullSafe("rule")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in USAGE] + [F.sum(F.when(unknown, 0).otherwise(F.coalesce(c, F.lit(0)))).alias(c) for c in TOKENS]
    each = runs.orderBy(F.desc_nulls_last("started_at"), F.desc("run_id")).limit(last).groupBy("task").agg(F.count(F.lit(1)).alias("runs"), F.count_if(unknown).alias("unknown_usage_runs"), *sums)
    return tall(each, "usage", F.col("task"), ["runs", "unknown_usage_runs", *USAGE, *TOKENS])


def quality(log: DataFrame, evidence: DataFrame) -> list[DataFrame]:
    """Annotations by state and kind, the share that waits for review, rule rows, rules of the prefilter, the share of relevant rows with evidence."""
    all_ = log.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("provider") == "rule").alias("rule_rows"),
        F.bround(F.count_if(F.col("review_state") == "needs_review") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("needs_review_rate"),
    )
    relevant = log.where("kind = 'relevance' and value = 'relevant'").select("annotation_id")
    found = relevant.join(evidence.select("annotation_id").distinct().withColumn("_e", F.lit(1)), "annotation_id", "left")
    located = found.agg(F.bround(F.try_divide(F.count("_e").cast("double"), F.count(F.lit(1)).cast("double")), 4).alias("evidence_located_rate"))
    fixed = F.lit("all")
    return [
        tall(all_, "annotations", fixed, ["rows", "rule_rows", "needs_review_rate"]), counted(log, "annotations", F.lit("review_state"), F.col("review_state")), counted(log, "annotations", F.lit("kind"), F.col("kind")),
        counted(log.where("kind = 'text_quality'"), "prefilter", F.lit("rule"), F.coalesce("value", F.lit("unknown"))), tall(located, "annotations", fixed, ["evidence_located_rate"]),
    ]


def conclusions(current: DataFrame, keys: list[str], product: str, products: int) -> list[DataFrame]:
    """Attitudes of relevant units by product, for the products with most of them, and what is irrelevant or lacks context there; tags of units that were scanned."""
    of = lambda kind: current.where(F.col("kind") == kind)
    relevance = of("relevance").select(*keys, F.col("value").alias("_r"))
    attitudes = of("attitude").join(relevance.where("_r = 'relevant'"), keys).groupBy(product, F.col("value").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    top = attitudes.groupBy(product).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), product).limit(products).select(product)
    others = relevance.groupBy(product).agg(*[F.count_if(F.col("_r") == r).alias(r) for r in ("irrelevant", "needs_context")]).join(top, product)
    shown = attitudes.join(top, product).select(F.lit("attitudes").alias("section"), F.col(product).cast("string").alias("name"), F.col("measure").cast("string").alias("measure"), F.col("n").cast("double").alias("value"))
    scanned = of("compliance")
    tags = scanned.select(F.explode("tags").alias("tag"))
    return [shown, tall(others, "attitudes", F.col(product), ["irrelevant", "needs_context"]), tall(scanned.agg(F.count(F.lit(1)).alias("scanned_units")), "compliance", F.lit("all"), ["scanned_units"]), counted(tags, "compliance", F.lit("tags"), F.col("tag"))]


def report(jobs: DataFrame, runs: DataFrame, log: DataFrame, evidence: DataFrame, keys: list[str], product: str, scope: DataFrame | None = None, errors: int = 5, last: int = 50, products: int = 40) -> DataFrame:
    """The whole report, or that of a scope of units.

    jobs: keys, task, status, last_error. runs: run_id, task, provider, started_at, counts and tokens. log: annotation_id, keys,
    kind, value, tags, review_state, created_at, supersedes_id, provider, run_id. evidence: annotation_id. scope: keys.
    What counts now is resolved over the whole log before a scope is cut out of it; runs of a scope are those with rows in it, uncut.
    """
    current = facts.current(log, [*keys, "kind"])
    if scope is not None:
        units = scope.select(*keys).distinct()
        jobs, log, current = (df.join(units, keys, "left_semi") for df in (jobs, log, current))
        runs = runs.join(log.select("run_id").distinct(), "run_id", "left_semi")
    parts = [*queue(jobs, errors), usage(runs, last), *quality(log, evidence), *conclusions(current, keys, product, products)]
    return reduce(DataFrame.unionByName, parts)
