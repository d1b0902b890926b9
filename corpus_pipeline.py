"""A corpus pipeline of five operators.

quality     documents that the classifier rejects go
near        one document of each class of near copies stays
secrets     spans of secrets are masked in the texts
mix         documents are repeated or left out so that sources meet their targets
pieces      texts become SentencePiece ids, with seeded merge-dropout; the copies of a
            document that the mix repeats get segmentations of their own

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents. Rows are those the stage before kept; the last returns a row for each of its
documents with ids and their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import common, mixing, near, pieces, quality, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(docs.select("doc_id", "text", "lang", "source"), keep_text=False, vary_copies=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_good), ("near", keep_one), ("secrets", mask_secrets), ("mix", mix_sources), ("pieces", to_pieces)]

#: A trained classifier decides which rows there are; SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
