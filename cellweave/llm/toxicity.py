"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import LOWER_WORDS, Ftrl, Model, fit, score

PER_CLASS = 4000
THRESHOLD = 0.7


def _third(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def train_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, usable=lambda d: F.lit(True)) -> Model:
    """A model of ``labels.toxic``, from at most ``per_class`` rows of each class.

    L1 leaves few weights, so the model is small enough to broadcast whatever
    the size of the corpus. With no labelled rows every score is 0.5.
    """
    return fit(docs, labels, "toxic", usable, LOWER_WORDS, "skipgrams", per_class, Ftrl())


def score_toxicity(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text; a null text is an empty one."""
    return score(docs, model, out)


def op1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Rows of remainder 1 are held out of training. A null doc_id is scored and
    not held out. Repeated rows are scored alike; other columns are not read.
    """
    held = _third(F.col("doc_id")) == 1
    model = train_toxicity(documents, labels, usable=lambda d: _third(d) != 1)
    scored = score_toxicity(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
