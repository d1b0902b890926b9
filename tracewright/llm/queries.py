"""Registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import chat, chroma, codes, graphs, hamming, html, mixing, near, periods, phrases, pieces, quality, secrets
from tracewright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_forgery(table(spark, sf_dir, "conversations")))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.report(table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.report(table(spark, sf_dir, "documents"))


def op9_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.report(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.report(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_mix_sources, op2_quality, op3_secrets, op4_chat, op5_chroma, op6_main_text, op7_token_file, op8_ngram_join, op9_hamming_topk, op10_sentencepiece, op11_collocations, op12_neighbours, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op1_mix_sources": mixing.ORACLE, "op4_chat": chat.ORACLE, "op9_hamming_topk": hamming.ORACLE, "op11_collocations": phrases.ORACLE}
