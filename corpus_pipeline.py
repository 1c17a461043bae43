"""The corpus pipeline: five text operators over documents, one after the other.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and other columns, as its docstring says; columns that a stage
doesn't read come out as they went in. A null doc_id is an id like any other, but
for near_dedup, which keeps a row without id only where its group has none with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rallypoint.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from rallypoint.llm.common import materialise, ready, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose host passes.

    A null or blank text fails; a document without source has no host to fail;
    repeated rows are judged one by one; no documents give none.
    """
    ready(spark)
    return quality_rules.filter_hosts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id, one without id last.

    Null, empty and blank texts are one group; of repeated rows one stays, and
    ties between equal ids go to the first row as read; no documents give none.
    """
    ready(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Texts without words leak nothing and stay, as do documents with a null id;
    repeated rows stay or go together; an empty benchmark lets all stay.
    """
    ready(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew where a text changed.

    A null text stays null; overlapping secrets become one mark; repeated rows
    are masked one by one; no documents give none.
    """
    ready(spark)
    return secret_scan.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences.

    A null or empty text is the end id alone; repeated rows are packed each for
    itself; only documents longer than a sequence are cut; no documents give none.
    """
    ready(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packed", packed)]

#: SQL has no XXH64 for the fingerprints and no tokenizer for the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet and read again by the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
