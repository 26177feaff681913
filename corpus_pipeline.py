"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the documents of the next. All but the
last return the columns of ``documents``; an empty table goes through all
stages and gives no rows. Texts that a stage empties stay documents. The third
stage writes its result itself, in small batches, which bounds the memory of an
executor, and deletes the tables that led to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import batches_of, saved, table
from cellweave.llm.packing import pack_documents
from cellweave.llm.quality import keep_quality, train_quality
from cellweave.llm.repeats import remove_repeats
from cellweave.llm.secrets import redact
from cellweave.llm.simhash import keep_one
from cellweave.plans.storage import scratch

#: Bytes of the shortest stretch that counts as a repeated passage: the passages
#: looked for have over 50 words, which are 300 bytes at the least.
PASSAGE = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on the labelled ones, does not reject."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id."""
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeated stretches of ``PASSAGE`` bytes cover."""
    with batches_of(spark), scratch(spark) as kept:
        return kept(remove_repeats(docs, PASSAGE), "cut")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The classifier and the packing plan are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents`` of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
