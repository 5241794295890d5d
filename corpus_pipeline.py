"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and hands what it reads back to the next stage. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.line_dedup import drop_recurring_lines
from tidemark.llm.mixing import take_mix
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import keep_good


#: Documents of this similarity or more are near-duplicates in the pipeline; op2_near_dedup asks for more.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines. A document whose lines all recur stays, with an empty text."""
    cleaned = drop_recurring_lines(docs).select(docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cleaned


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return keep_one(docs, percent=NEAR_PERCENT)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in the training sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: MinHash, templates and tokens are beyond SQL; tests/llm/test_pipeline.py tests each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
