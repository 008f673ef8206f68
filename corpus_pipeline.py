"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept. All but the last return the columns of documents; the last adds where each
document goes. A stage's output is written as Parquet and read again by the next.

Defined cases: quality_rules drops null, empty and short texts (fewer than 50 words); repeated rows are one
document to ngram_jaccard_join, and rows without a doc_id go only if another of their component stays; documents
without a source are a source of their own in source_mixing, whose repeats of a document are rows of their own;
each stage gives an empty table for an empty one; columns beyond those of documents stay as they are, whatever
their names. doc_id is a number. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontaminate, line_quality, mixing, ngram_join, sharding
from twinframe.llm.common import OWN, read, release, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate lines go."""
    return line_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents stays: the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark spans are cut out of the others."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights: the parts of documents that its blocks take, some of them twice."""
    return mixing.mixed_documents(docs)


def shard_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there; `__tf_` goes before a name that docs has already."""
    got = sharding.shard(docs)
    taken = {c.lower() for c in docs.columns}
    return got.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.col(OWN + c).alias(OWN + c if c in taken else c) for c in ("size", "shard", "slot")))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("shard_packing", shard_packing),
]

#: Mixing draws at random and the line field decodes a sequence: SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
