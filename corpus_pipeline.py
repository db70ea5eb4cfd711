"""A corpus, from documents to packed windows, as stages that each read what the one before wrote.

Defined results: a null text is judged like an empty one, stays in the stages after toxicity and is packed as the end id alone; rows without an id are judged by their texts like others. Copies and repeated rows are one row after
the near copies. Very long texts are taken whole. Ties are as each operator says. Empty tables go through and give no row. Further columns of the documents, whatever their names, are
kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import leakage, nearcopies, packing, secrets, toxicity
from eventloom.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The model is learnt from labelled documents of the corpus."""
    return toxicity.without_toxic(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least id."""
    return nearcopies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return leakage.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs, secrets.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with the window it is in."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("secrets", redact_secrets), ("packing", pack)]

#: Compression, the random field and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
