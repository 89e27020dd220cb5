"""The pipeline over documents, stage by stage; counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's
result as a table in the shared folder and reads it for the next. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterscope.llm import line_templates, mixing, near_dup, ordinal_quality, packing
from chatterscope.llm.common import Scratch, table
from chatterscope.llm.registry import LEVELS, WEIGHTS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go; a rating of its own outranks nothing."""
    model = ordinal_quality.train(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.classify(docs, model).where("accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring templates' lines go from every document but their first; a document that has no words left, all its lines being kept elsewhere, goes."""
    out = line_templates.drop_recurring_lines(docs)
    return out.where(~line_templates.emptied(out)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group stays with all its texts; of its rows equal in text the least one stays."""
    kept = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__nd_kept")).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col("__nd_kept"), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    each = named.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__nd"), *rest)).alias("__nd_row"))
    once = each.select("doc_id", "text", *[F.col("__nd_row")[c].alias(c) for c in rest])
    return once.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens by the mixture's weights, as whole documents, each at most once."""
    out = mixing.mix(docs, {k: f() for k, f in LEVELS.items()}, WEIGHTS, total_tokens=0.9, max_epochs=1, whole_only=True)
    return out.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, capacity=1024, end_id=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixture", mixture),
    ("best-fit packing", best_fit_packing),
]
#: SQL has no fit of a classifier and no byte-pair encoding; stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
