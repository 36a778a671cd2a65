"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what
it decides takes effect in the rows it returns. All but the last return the columns of
`documents`; the last returns the shard manifest (the texts stay in the mixing stage's
table, which it refers to by doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drumlin.llm.common import materialize, table
from drumlin.llm.decontaminate import drop_contaminated
from drumlin.llm.mixing import sample_to_targets
from drumlin.llm.quality import quality_filter
from drumlin.llm.sharding import shard_documents
from drumlin.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_to_targets(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_to_target_weights", mixing),
    ("sharding", sharding),
]

#: SQL has no XXH64 fingerprints, walks or differencing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
