"""A corpus pipeline over ``documents``: quality rules, near duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame with the columns of docs (the
last one: with token ids beside). ``run`` writes every stage as Parquet to the session's shared folder and rereads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcomm.llm import bpe, mixing, near_duplicates, quality, secrets
from sparkcomm.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id. Documents without words or id stay."""
    return near_duplicates.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the name of their kind in brackets; n_chars counts the new text."""
    found = secrets.scan(docs, carry=True)
    text = secrets.redact(F.col("row.text"), F.col("spans"))
    columns = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[columns[c].alias(c) if c in columns else F.col(f"row.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding gives the text back."""
    return bpe.with_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("secret scan", secret_scan), ("mixing", mix), ("byte-level BPE", encode)]

#: Near duplicates and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
