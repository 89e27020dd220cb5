"""Choosing rows and products: checked selection, readiness, membership, fixed orders and limits, deduplication in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_products(products: DataFrame, chosen: dict[str, Sequence[str] | None]) -> DataFrame:
    """Products in all of the chosen values; an unknown value and an empty result are errors.

    chosen: column -> values, or None for all. The products are a dimension: what is checked on the driver is one row.
    """
    checks, kept = [], F.lit(True)
    for column, values in chosen.items():
        if values is None:
            continue
        wanted = sorted({v.strip() for v in values if v.strip()})
        if not wanted:
            raise ValueError(f"no value for {column}")
        checks.append(F.array_except(F.array(*map(F.lit, wanted)), F.collect_set(F.when(F.col(column).isin(wanted), F.col(column)))).alias(column))
        kept = kept & F.col(column).isin(wanted)
    told = products.agg(F.count_if(kept).alias("_n"), *checks).first()
    unknown = {c: told[c] for c in told.asDict() if c != "_n" and told[c]}
    if unknown:
        raise ValueError(f"unknown values: {unknown}")
    if not told["_n"]:
        raise ValueError("no product has all of the chosen values")
    return products.where(kept)


def ready(metadata: DataFrame, expected: dict[str, str], key: str = "k", value: str = "v") -> DataFrame:
    """One row, ready: every expected pair is there. A missing key and a null value close the gate."""
    fits = F.coalesce(*[F.when(F.col(key) == k, F.col(value) == v) for k, v in expected.items()])
    held = metadata.where(F.col(key).isin(list(expected))).where(F.coalesce(fits, F.lit(False)))
    return held.agg((F.count_distinct(key) == len(expected)).alias("ready"))


def has_route(comments: DataFrame, routes: DataFrame, version: str) -> DataFrame:
    """Comments with a route of this version to their subject."""
    return comments.join(routes.where(F.col("rule_version") == version), ["comment_id", "subject_code"], "left_semi")


def with_target_post(jobs: DataFrame, comments: DataFrame, feeds: DataFrame) -> DataFrame:
    """jobs and their post: a comment's by its feed_id, a post's own. Two equi joins, since a join on either condition would be nested loops."""
    post = F.when(F.col("target_type") == "feed", F.col("target_id"))
    of_comment = comments.select(F.col("comment_id").alias("target_id"), F.col("feed_id").alias("_feed"))
    by_comment = jobs.where("target_type = 'comment'").join(of_comment, "target_id", "left")
    others = jobs.where("target_type <> 'comment' or target_type is null").withColumn("_feed", post)
    return by_comment.unionByName(others).join(feeds.withColumnRenamed("feed_id", "_feed"), "_feed", "left").withColumnRenamed("_feed", "feed_id")


def in_scope(jobs: DataFrame, bridge: DataFrame, scope: int) -> DataFrame:
    """Jobs that name the scope themselves or stand in the bridge table under it, each once."""
    own = F.coalesce(F.col("scope_id") == scope, F.lit(False))
    other = jobs.where(~own).join(bridge.where(F.col("scope_id") == scope), "job_id", "left_semi")
    return jobs.where(own).unionByName(other)


def clamped(n: int | None, low: int, high: int, default: int) -> int:
    """A limit inside its bounds; none gives the default."""
    return default if n is None else max(low, min(high, n))


def unknown_last(column: str, *, descending: bool) -> list[Column]:
    """Sort keys with which a missing value is last in both directions."""
    return [F.col(column).isNull(), F.col(column).desc() if descending else F.col(column).asc()]


def numeric_first(column: str) -> list[Column]:
    """Text in numeric order where it begins with a number, others by their letters behind them."""
    head = F.regexp_extract(column, r"^\s*(\d+)", 1)
    return [F.when(head != "", head.cast("decimal(38,0)")).asc_nulls_last(), F.lower(column).asc_nulls_last()]


def natural_key(text: Column, collation: str = "zh_CI_AI") -> Column:
    """Text under a locale's collation in which every run of digits counts as a number.

    A run goes without its leading zeros behind its length in six digits, so that collating digit by digit is comparing numbers.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    numbered = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(r)).cast("string"), 6, "0"), digits(r))).otherwise(r))
    return F.collate(F.array_join(numbered, ""), collation)


def natural_order(column: str, ties: list[str], *, descending: bool = False, collation: str = "zh_CI_AI") -> list[Column]:
    """A total order for tables: missing and empty texts last in both directions, then natural order, then the ties ascending."""
    missing = F.coalesce(F.col(column) == "", F.lit(True))
    present = F.when(~missing, natural_key(F.col(column), collation))
    return [missing.asc(), present.desc() if descending else present.asc(), *[F.col(t).asc_nulls_last() for t in ties]]


def first_wins(values: Column) -> Column:
    """An array's values, each at its first place."""
    return F.array_distinct(values)


def layer_states(generations: DataFrame, anchor: str) -> DataFrame:
    """generations: generation (published|fingerprint), dirty, and state: missing without both parts or from after the anchor, fresh at the anchor unless dirty, else stale."""
    published = F.substring_index("generation", "|", 1)
    told = F.col("generation").isNotNull() & F.contains("generation", F.lit("|")) & (F.substring_index("generation", "|", -1) != "") & (published != "") & (published <= anchor)
    fresh = (published == anchor) & ~F.coalesce("dirty", F.lit(False))
    return generations.withColumn("state", F.when(~F.coalesce(told, F.lit(False)), "missing").when(fresh, "fresh").otherwise("stale"))


def dry_run(old: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """What a merge would do: rows by added, removed, changed and same. Nothing is written."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("_old"))
    b = merged.select(key, F.struct(*columns).alias("_new"))
    what = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return a.join(b, key, "full").groupBy(what.alias("change")).agg(F.count(F.lit(1)).alias("n"))
