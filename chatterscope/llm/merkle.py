"""Merkle manifest of a dataset: a tree a group (language), a tree over the groups' roots, and a proof for every row.

A row's leaf is the digest of its fields, each ``-`` if null and else its UTF-8 length, ``:`` and the value. Leaves of
a group ascend by id; runs of ``arity`` neighbours give their parent, the last run of a level may be shorter.

The forest is an associative monoid. A fragment holds the nodes of consecutive leaves that are not resolved yet, by
tree, level and index; since the number of leaves of each tree is known, so is the size of every sibling run, and
merging two fragments resolves each run that is now complete. A partition's fragment has at most a run at either end
of a level, whatever its rows. Fragments are reduced as a tree, ``FAN`` neighbours a task, each round a written table:
neither the driver nor a task ever holds more. A group's finished root is a leaf of the last tree (``TOP``), so
any number of groups goes the same way.

A proof's siblings are nodes of the row's own partition, computed there again, or among those that fragments left open
or merges made: a join brings each partition the few it lacks.

Defined cases: null ids come first and are leaves like others; rows equal in id are ordered by leaf; equal rows are
leaves each; the null group is the first; a group's lone leaf is its root, a lone group's root the whole's; a row without
siblings has the digest of nothing as proof; no rows give no rows; further columns take no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chatterscope.llm.common import Scratch, ranged

#: The tree whose leaves are the groups' roots.
TOP = -1
#: Neighbouring fragments that one task merges.
FAN = 64
FRAGMENT = "part long, kind string, tree long, n long, level int, idx long, hash string"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of these fields (strings, or integers as decimal text)."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def level_sizes(n: int, arity: int) -> list[int]:
    """The number of nodes of each level, leaves first."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Forest:
    """Nodes by tree, level and index; the monoid's element."""

    def __init__(self, arity: int, n_groups: int):
        self.arity, self.sizes, self.levels = arity, {TOP: level_sizes(n_groups, arity)}, {}
        self.made: list[tuple[int, int, int, str]] = []

    def put(self, tree: int, n: int, level: int, start: int, hashes: list[str]) -> None:
        if tree not in self.sizes:
            self.sizes[tree] = level_sizes(n, self.arity)
        self.levels.setdefault(tree, {}).setdefault(level, {}).update(zip(range(start, start + len(hashes)), hashes, strict=True))

    def settle(self) -> None:
        """Resolve every complete run, from the leaves up; groups before the tree over them."""
        for tree in sorted(self.levels):
            if tree != TOP:
                self._settle(tree)
        if TOP in self.levels:
            self._settle(TOP)

    def _settle(self, tree: int) -> None:
        sizes, levels, a = self.sizes[tree], self.levels[tree], self.arity
        for level in range(len(sizes) - 1):
            here = levels.get(level)
            if not here:
                continue
            above = levels.setdefault(level + 1, {})
            for run in sorted({i // a for i in here}):
                if run in above:
                    continue
                members = range(run * a, min(run * a + a, sizes[level]))
                if all(i in here for i in members):
                    h = digest([here[i] for i in members])
                    above[run] = h
                    self.made.append((tree, level + 1, run, h))
        last = levels.get(len(sizes) - 1)
        if tree != TOP and last:
            top = self.levels.setdefault(TOP, {}).setdefault(0, {})
            if tree not in top:
                top[tree] = last[0]
                self.made.append((TOP, 0, tree, last[0]))

    def known(self, tree: int, level: int, i: int) -> str | None:
        return self.levels.get(tree, {}).get(level, {}).get(i)

    def open(self) -> list[tuple[int, int, int, str]]:
        """(tree, level, index, digest) of the nodes that are not resolved: without a parent, and not a group's root that went to the last tree."""
        out = []
        for tree, levels in self.levels.items():
            end = len(self.sizes[tree]) - 1
            for level, nodes in levels.items():
                above = levels.get(level + 1, {})
                if level < end or tree == TOP:
                    out += [(tree, level, i, h) for i, h in nodes.items() if i // self.arity not in above]
        return out


def _of_part(pdf: pd.DataFrame, arity: int, n_groups: int) -> tuple[Forest, pd.DataFrame]:
    """A partition's leaves in order, with their places, and the forest over them."""
    pdf = pdf.sort_values(["tree", "named", "doc_id", "leaf"], kind="stable").reset_index(drop=True)
    pdf["place"] = pdf["start"] + pdf.groupby("tree", sort=False).cumcount()
    forest = Forest(arity, n_groups)
    for tree, own in pdf.groupby("tree", sort=False):
        forest.put(int(tree), int(own["n"].iloc[0]), 0, int(own["start"].iloc[0]), own["leaf"].tolist())
    forest.settle()
    return forest, pdf


def _lacking(forest: Forest, pdf: pd.DataFrame) -> list[tuple[int, int, int, int]]:
    """(tree, its leaves, level, index) of the siblings on this partition's paths, and of the roots, that it cannot compute itself."""
    a, out = forest.arity, []
    spans = [(int(t), int(x.min()), int(x.max())) for t, x in pdf.groupby("tree", sort=False)["place"]]
    spans.append((TOP, spans[0][0], spans[-1][0]))
    for tree, low, high in spans:
        sizes = forest.sizes[tree]
        for level, n in enumerate(sizes):
            ends = {i for run in {low // a, high // a} for i in range(run * a, min(run * a + a, n))}
            out += [(tree, sizes[0], level, i) for i in sorted(ends) if forest.known(tree, level, i) is None]
            low, high = low // a, high // a
    return out


def _parent(run: list[str], at: int, own: str) -> str:
    return digest([*run[:at], own, *run[at + 1 :]])


def manifest(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, arity: int = 2, rows_a_part: int = 250_000) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each of docs.

    tampered: values that stand for a field when a row is verified (all others keep theirs): the leaf is taken anew from
    them and folded with the original siblings; ``verified`` tells whether that gives the root. proof_sha256 is the digest of the siblings.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    own = [F.col(c) for c in fields]
    leaf = leaf_of(own)
    other = leaf_of([(tampered or {}).get(c, F.col(c)) for c in fields])
    same = F.lit(True)
    for c, v in (tampered or {}).items():
        same = same & v.cast("string").eqNullSafe(F.col(c).cast("string"))
    # a group's name with "=" before it, so that null sorts first and joins
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = scratch.put(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), name.alias("name"), leaf.alias("leaf"), F.when(~same, other).alias("other")))
    total = leaves.count()
    if not total:
        return spark.createDataFrame([], PROVED)
    parts = max(-(-total // rows_a_part), min(2 * spark.sparkContext.defaultParallelism, -(-total // 2_000)))
    rows = scratch.put(ranged(leaves, parts, ["name", "named", "doc_id", "leaf"]))
    counts = rows.groupBy("name", "part").agg(F.count(F.lit(1)).alias("here"))
    groups = counts.groupBy("name").agg(F.sum("here").alias("n"))
    groups = scratch.put(groups.withColumn("tree", (F.row_number().over(W.orderBy("name")) - 1).cast("long")))  # a row a group
    n_groups = groups.count()
    before = F.coalesce(F.sum("here").over(W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.put(counts.withColumn("start", before).join(groups, "name").select("name", "part", "tree", "n", "start"))
    placed = rows.join(starts, ["name", "part"]).select("part", "tree", "n", "start", "named", "doc_id", "leaf", "other")
    last = int(starts.agg(F.max("part")).first()[0])

    def said(forest: Forest, part: int, more: list[tuple]) -> pd.DataFrame:
        rows = [(part, "open", t, forest.sizes[t][0], level, i, h) for t, level, i, h in forest.open()]
        return pd.DataFrame(rows + more, columns=[x.split()[0] for x in FRAGMENT.split(", ")])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        forest, pdf = _of_part(pdf, arity, n_groups)
        return said(forest, part, [(part, "lacking", t, n, level, i, None) for t, n, level, i in _lacking(forest, pdf)])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(arity, n_groups)
        for r in pdf.itertuples(index=False):
            forest.put(r.tree, r.n, r.level, r.idx, [r.hash])
        forest.settle()
        part = int(pdf["part"].iloc[0]) // FAN
        return said(forest, part, [(part, "made", t, forest.sizes[t][0], level, i, h) for t, level, i, h in forest.made])

    fragments = scratch.put(placed.groupBy("part").applyInPandas(fold, FRAGMENT))
    lacking, nodes = fragments.where("kind = 'lacking'"), [fragments.where("kind = 'open'")]
    open_ = nodes[0]
    while last:
        merged = scratch.put(open_.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(merge, FRAGMENT))
        nodes.append(merged.where("kind = 'made'"))
        open_, last = merged.where("kind = 'open'"), last // FAN
    all_nodes = nodes[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    key = ["tree", "level", "idx"]
    brought = lacking.select("part", *key).join(all_nodes.select(*key, "hash"), key)

    def prove(leaves: pd.DataFrame, brought: pd.DataFrame) -> pd.DataFrame:
        forest, pdf = _of_part(leaves, arity, n_groups)
        for r in brought.itertuples(index=False):
            forest.put(r.tree, 0, r.level, r.idx, [r.hash])
        top = forest.sizes[TOP]
        root = forest.known(TOP, len(top) - 1, 0)
        paths = {}  # of the groups: their roots' siblings on the way up

        def climb(tree: int, i: int) -> list[tuple[list[str], int]]:
            sizes, levels, out = forest.sizes[tree], forest.levels[tree], []
            for level in range(len(sizes) - 1):
                run = i - i % arity
                nodes = levels[level]
                out.append(([nodes[j] if j != i else "" for j in range(run, min(run + arity, sizes[level]))], i - run))
                i //= arity
            return out

        found = []
        for doc, named, tree, place, leaf, other in zip(*(pdf[c].tolist() for c in ("doc_id", "named", "tree", "place", "leaf", "other")), strict=True):
            if tree not in paths:
                paths[tree] = climb(TOP, tree)
            path = climb(tree, place) + paths[tree]
            h = leaf if other is None else other
            for run, at in path:
                h = _parent(run, at, h)
            proof = digest([x for run, at in path for x in run[:at] + run[at + 1 :]])
            found.append((doc if named else None, leaf, forest.known(TOP, 0, tree), root, proof, h, h == root))
        out = pd.DataFrame(found, columns=[x.split()[0] for x in PROVED.split(", ")], dtype=object)
        return out.astype({"doc_id": "Int64"})

    return placed.groupBy("part").cogroup(brought.groupBy("part")).applyInPandas(prove, PROVED)

