"""The registered queries of the training-data operators: op1..op10, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drumlin.llm import oracles
from drumlin.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.mixing import mixing_report

    return mixing_report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.chat import digests, events_of, format_conversations, with_probe

    return digests(format_conversations(events_of(with_probe(table(spark, sf_dir, "conversations")))))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False).drop("lang")
    # Rounded for comparison with other engines; kept goes by the figures as they are.
    return out.withColumns({c: F.round(c, 6) for c in ("char_divergence", "word_divergence")})


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from drumlin.llm.linededup import line_dedup_report

    return line_dedup_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op2_secret_scan": op2_secret_scan,
    "op8_warc": op8_warc,
    "op1_mixing": op1_mixing,
    "op7_decontamination": op7_decontamination,
    "op3_karmarkar_karp": op3_karmarkar_karp,
    "op4_chat_formatting": op4_chat_formatting,
    "op6_simhash_components": op6_simhash_components,
    "op5_quality_rules": op5_quality_rules,
}
ORACLES: dict[str, str] = {"op4_chat_formatting": oracles.CHAT, "op5_quality_rules": oracles.quality(), "op8_warc": oracles.WARC}
