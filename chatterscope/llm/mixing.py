"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree (domain, language, source). A total of tokens is passed down by weight; what a child cannot
use, at ``max_epochs`` passes over its documents, goes to its siblings by weight, and only when all of them are
full does the node itself count as short, to be made up among its own siblings. Each leaf takes the first tokens
of a stream of epochs, every epoch being all its documents in the order of a seeded hash: whole epochs, then a
prefix that ends inside one document. In hash order a prefix is a threshold, so no leaf is ever sorted: token sums
of 4,096 hash ranges a leaf find the range that holds the end, and only its rows are ordered. The tree is a table like
any other, a row a node: budgets are windows over siblings, and nothing of it comes to the driver.

Defined cases: a null text has no tokens and is taken with the rest of its leaf; a null level is the node ``""``; a
child without a weight gets ``default_weight``; rows equal in id and text share their place in the order, and where a
prefix ends among them, as many are taken as it needs and the last of them in part; a table without rows gives no rows; further columns are passed through,
but for columns named n_tokens, epoch or take_tokens, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.llm.common import Scratch

RANGE_BITS = 12


def water_fill(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes and _got: shares of the parent's _amount by _weight, none above its _room; what one cannot hold goes to its siblings by weight.

    In the order of room by weight those that are full come first: a node is full if its share of what all before it leave is at least its room.
    """
    takes = (F.col("_room") > 0) & (F.col("_weight") > 0)
    order = W.partitionBy(*parent).orderBy(F.col("_room") / F.col("_weight"), child)
    before = F.coalesce(F.sum("_room").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    df = nodes.where(takes).withColumns({"_before": before, "_rest": rest})
    df = df.withColumn("_full", (F.col("_amount") - F.col("_before")) * F.col("_weight") / F.col("_rest") >= F.col("_room"))
    all_ = W.partitionBy(*parent)
    held = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_room"))).over(all_), F.lit(0))
    open_ = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(all_)
    df = df.withColumn("_exact", F.when(F.col("_full"), F.col("_room").cast("double")).otherwise((F.col("_amount") - held) * F.col("_weight") / open_))
    df = df.withColumn("_whole", F.floor("_exact")).withColumn("_short", F.col("_amount") - F.sum("_whole").over(all_))
    #: The tokens that rounding down leaves go to the largest fractions.
    turn = F.row_number().over(W.partitionBy(*parent).orderBy("_full", F.col("_whole") - F.col("_exact"), child))
    got = F.col("_whole") + F.when(~F.col("_full") & (turn <= F.col("_short")), 1).otherwise(0)
    return nodes.drop("_got").join(df.select(*parent, child, got.cast("long").alias("_got")), [*parent, child], "left").withColumn("_got", F.coalesce("_got", F.lit(0).cast("long")))


def budgets(sizes: DataFrame, names: list[str], total: int | float, weights: dict[tuple[str, ...], float], default_weight: float, max_epochs: int) -> DataFrame:
    """names, _size, _got: the tokens each leaf gives. sizes: names and n; weights: by path from the root, of any depth.

    total: a number, or a share of all tokens if it is a float.
    """
    spark, scratch = sizes.sparkSession, Scratch(sizes.sparkSession, "mixing-budgets")
    sizes = scratch.put(sizes)
    level = sizes.groupBy(F.lit(0).alias("_root")).agg(F.sum("n").alias("_all"))
    wanted = F.floor(F.col("_all") * F.lit(total)) if isinstance(total, float) else F.lit(total)
    level = level.select("_root", F.least(wanted, F.col("_all") * max_epochs).cast("long").alias("_amount"))
    own = sizes.withColumn("_root", F.lit(0))
    for depth, name in enumerate(names):
        parent = ["_root", *names[:depth]]
        nodes = own.groupBy(*parent, name).agg(F.sum("n").alias("_size")).withColumn("_room", F.col("_size") * max_epochs)
        told = [(*p, float(w)) for p, w in weights.items() if len(p) == depth + 1]
        given = spark.createDataFrame(told, ", ".join([*[f"`{n}` string" for n in names[: depth + 1]], "_weight double"]))
        nodes = nodes.join(given, names[: depth + 1], "left").withColumn("_weight", F.coalesce("_weight", F.lit(float(default_weight))))
        level = water_fill(scratch.put(nodes.join(level.select(*parent, "_amount"), parent)), parent, name).drop("_amount").withColumnRenamed("_got", "_amount")
        level = scratch.put(level)  # a row a node: each level's plan stays short
    return level.select(*names, "_size", F.col("_amount").alias("_got"))


def place(seed: int, epoch: int) -> Column:
    """A row's place in an epoch: 63 bits by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(epoch), "doc_id", F.xxhash64("text")), 1)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], float], total_tokens: int | float, max_epochs: int = 2, default_weight: float = 1.0, seed: int = 17, whole_only: bool = False) -> DataFrame:
    """All columns of docs and epoch, n_tokens, take_tokens: one row for each time a document is taken.

    total_tokens: a number, or a share of the corpus's tokens if it is a float. whole_only leaves out the document
    in which a leaf's prefix ends.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    names = [f"__mix_{i}" for i in range(len(levels))]
    docs = docs.drop("n_tokens", "epoch", "take_tokens")
    marked = docs.select("*", *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)])
    meta = scratch.put(marked.select(*names, tokens.alias("n_tokens"), *[place(seed, e).alias(f"_p{e}") for e in range(max_epochs)]))
    given = budgets(meta.groupBy(*names).agg(F.sum("n_tokens").alias("n")), names, total_tokens, weights, default_weight, max_epochs)
    full = F.when(F.col("_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("_got") / F.col("_size")))).otherwise(1).cast("int")
    leaves = scratch.put(given.withColumn("__mix_full", full).withColumn("__mix_rest", F.when(F.col("_size") > 0, F.col("_got") - F.col("__mix_full") * F.col("_size")).otherwise(0)).select(*names, "__mix_full", "__mix_rest"))
    at = F.coalesce(*[F.when(F.col("__mix_full") == e, F.col(f"_p{e}")) for e in range(max_epochs)])
    partial = meta.join(leaves, names).where("__mix_rest > 0").withColumn("_at", at)
    piece = F.shiftrightunsigned("_at", 63 - RANGE_BITS)
    sums = partial.groupBy(*names, "__mix_rest", piece.alias("_b")).agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*names).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    ends = sums.withColumn("_upto", upto).where("_upto >= __mix_rest").groupBy(*names).agg(F.min_by(F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_before")), "_b").alias("_e"))
    ends = scratch.put(ends)
    inside = partial.join(ends, names).where(piece == F.col("_e._b")).groupBy(*names, "__mix_rest", "_e", "_at").agg(F.sum("n_tokens").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    run = F.col("_e._before") + F.sum("_n").over(W.partitionBy(*names).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    left = (F.col("__mix_rest") - F.col("_run") + F.col("_n")).alias("__mix_left")
    cut = inside.withColumn("_run", run).where("_run >= __mix_rest").groupBy(*names).agg(F.min_by(F.struct(F.col("_at").alias("__mix_cut"), left, F.col("_rows").alias("__mix_rows")), "_at").alias("_c"))
    cut = cut.select(*names, "_c.*")
    plan = scratch.put(leaves.join(cut, names, "left").fillna({"__mix_cut": -1, "__mix_left": 0, "__mix_rows": 1}))
    told = marked.join(plan, names).withColumn("n_tokens", tokens)
    partly = lambda e: F.lit(e) == F.col("__mix_full")
    taken = F.array(*[
        F.when(F.lit(e) < F.col("__mix_full"), F.struct(F.lit(e).alias("epoch"), F.col("n_tokens").alias("take_tokens")))
        .when(partly(e) & (place(seed, e) < F.col("__mix_cut")), F.struct(F.lit(e).alias("epoch"), F.col("n_tokens").alias("take_tokens")))
        .when(partly(e) & (place(seed, e) == F.col("__mix_cut")) & (F.col("__mix_rows") == 1), F.struct(F.lit(e).alias("epoch"), F.col("__mix_left").alias("take_tokens")))
        for e in range(max_epochs)
    ])
    out = told.select(*docs.columns, "n_tokens", F.inline(F.filter(taken, lambda x: x.isNotNull())))
    if not plan.where("__mix_rows > 1").isEmpty():
        at_cut = F.coalesce(*[F.when(partly(e) & (place(seed, e) == F.col("__mix_cut")), F.lit(e)) for e in range(max_epochs)])
        ties = told.where("__mix_rows > 1").withColumn("epoch", at_cut).where("epoch is not null")
        out = out.unionByName(tied(scratch.put(ties.withColumn("__mix_row", F.monotonically_increasing_id())), names).select(*out.columns))
    return out.where("take_tokens = n_tokens") if whole_only else out


def tied(ties: DataFrame, names: list[str]) -> DataFrame:
    """Rows of one place, a leaf each: the first take all of their tokens until __mix_left is given, the next the rest.

    Rows are numbered within the parts they were written in, so a group of any size has no task of its own.
    """
    part = F.shiftright("__mix_row", 33)
    ties = ties.withColumn("__mix_part", part)
    sizes = ties.groupBy(*names, "__mix_part").agg(F.count(F.lit(1)).alias("__mix_n"))
    before = F.coalesce(F.sum("__mix_n").over(W.partitionBy(*names).orderBy("__mix_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("__mix_rank", F.row_number().over(W.partitionBy(*names, "__mix_part").orderBy("__mix_row")) - 1)
    ranked = ranked.join(sizes.withColumn("__mix_before", before), [*names, "__mix_part"])
    take = F.least(F.col("n_tokens"), F.col("__mix_left") - (F.col("__mix_before") + F.col("__mix_rank")) * F.col("n_tokens"))
    return ranked.withColumn("take_tokens", take).where("take_tokens > 0")
