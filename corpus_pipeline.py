"""documents -> training sequences: quality rules, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame;
all but the last return the columns of documents. Dedup and mixing decide per row, by a written row key of their own.

Defined cases: rows that share a doc_id or have none are rows of their own: one row of each group of copies stays, and a
row stands in the mix by its own share; null and empty texts fail the quality rules; very long texts pass through whole and
are cut by packing only; among copies the longest text, then the smallest doc_id stays (null last); a null source is a
source of its own; an empty table gives an empty result; other columns, whatever their names, are kept until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm.cluster import cut
from lexgrove.llm.exact_dedup import without_copies
from lexgrove.llm.mixing import mixed_documents
from lexgrove.llm.near_dedup import without_near_copies
from lexgrove.llm.packing import packed
from lexgrove.llm.quality import clean


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules."""
    return clean(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return without_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents and its place in a sequence."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Near dedup and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written once in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
