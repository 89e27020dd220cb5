"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned for candidate credentials. Each candidate's value is hashed; per hash the distinct
repositories and owners that hold it are counted over the whole corpus. A value seen in ``example_repos``
repositories or more, or with ``example_owners`` owners or more, is a widely copied example; the others belong
to one owner and look live. Candidates of the base kinds are always reported; those of the wider kinds (upper-case
hexadecimal, private keys, prefixed tokens) become spans only where the frequency says they are owner-specific.

Defined cases: a null text has no candidates; a null repository or owner counts as one unnamed value; repeated
rows are reported each; a table without rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterscope.llm.common import Scratch

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WIDER = {
    "upper_hex": re.compile(r"(?<![0-9A-Fa-f])[0-9A-F]{32,}(?![0-9A-Fa-f])"),
    "key_block": re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----", re.ASCII),
    "prefixed": re.compile(r"\b(?:ghp_|gho_|xox[bpars]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}", re.ASCII),
}
KINDS = ["assign", "access", "hex", *WIDER]
#: A text without any of these words (lower case) holds no assignment.
WORDS = ("passw", "secret", "token", "api")
#: The most rows that are broadcast of the values that are found most.
WIDE = 10_000
SPAN = "array<struct<start:long,rank:int,kind:string,end:long,hash:string>>"


def same_value(v: str) -> str:
    """Hexadecimal values are the same in either case; in others case counts."""
    return v.lower() if re.fullmatch("[0-9A-Fa-f]+", v) else v


def candidates(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, rank of kind, kind, end, hash of the value), by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS) or not text.isascii():
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    found += [(m.start(), 3, m.end(), m[0]) for m in WIDER["upper_hex"].finditer(text)]
    if "PRIVATE KEY" in text:
        found += [(m.start(), 4, m.end(), m[0]) for m in WIDER["key_block"].finditer(text)]
    if "_" in text or "-" in text:
        found += [(m.start(), 5, m.end(), m[0]) for m in WIDER["prefixed"].finditer(text)]
    return [(s, k, KINDS[k], e, hashlib.sha256(same_value(v).encode("utf-8", "surrogatepass")).hexdigest()) for s, k, e, v in sorted(found)]


def spans_text(found: list) -> str:
    return ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in found)


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        found = [candidates(t) if t else [] for t in pdf["text"].where(pdf["text"].notna(), None)]
        base = [[x for x in f if x[1] < 3] for f in found]
        yield pd.DataFrame({
            "row_key": [uuid.uuid4().hex for _ in found],
            "doc_id": pdf["doc_id"], "repo": pdf["repo"], "owner": pdf["owner"],
            **{f"n_{k}": [sum(x[1] == i for x in f) for f in base] for i, k in enumerate(KINDS[:3])},
            "base_sha256": [hashlib.sha256(spans_text(f).encode()).hexdigest() for f in base],
            "found": [[dict(zip(("start", "rank", "kind", "end", "hash"), x, strict=True)) for x in f] for f in found],
        })


def secret_scan(docs: DataFrame, repo: Column, owner: Column, example_repos: int = 3, example_owners: int = 3, wide: int = WIDE) -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, base_sha256, found (spans with n_repos, n_owners, live)."""
    scratch = Scratch(docs.sparkSession, "secret-scan")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"))
    schema = f"row_key string, doc_id {kind}, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {SPAN}"
    rows = scratch.put(rows.mapInPandas(_scan, schema))
    each = rows.select("row_key", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.inline("found"))
    held = each.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_found"))
    held = scratch.put(held.withColumn("live", (F.col("n_repos") < example_repos) & (F.col("n_owners") < example_owners)))
    #: Values with more than 1 / wide of all finds are fewer than wide: they are broadcast, so no hot value meets in one task.
    often = held.crossJoin(F.broadcast(held.agg(F.sum("n_found").alias("_all")))).where(F.col("n_found") * wide > F.col("_all")).select("hash", "n_repos", "n_owners", "live")
    each = each.join(F.broadcast(often), "hash", "left")
    rest = each.where("live is null").drop("n_repos", "n_owners", "live").join(held.select("hash", "n_repos", "n_owners", "live"), "hash")
    told = each.where("live is not null").unionByName(rest).where((F.col("rank") < 3) | F.col("live"))
    told = told.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "hash", "n_repos", "n_owners", "live"))).alias("told"))
    return rows.join(told, "row_key", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("told", F.array().cast(told.schema["told"].dataType)).alias("found")
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of op2: spans as text and how many of them look live."""
    say = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    live = F.size(F.filter("found", lambda x: x["live"])).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", say.alias("spans"), live.alias("n_live"), (F.size("found") - live).cast("long").alias("n_examples"))
