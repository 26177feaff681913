"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import WORDS_AND_SYMBOLS, Ftrl, Model, fit, score

PER_CLASS = 4000
THRESHOLD = 0.3


def _fifth(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, usable=lambda d: F.lit(True)) -> Model:
    """A model of ``labels.quality``, from at most ``per_class`` rows of each class.

    Tokens are words and runs of symbols; a word equal to the one before it is
    read as one special token. With no labelled rows every score is 0.5.
    """
    return fit(docs, labels, "quality", usable, WORDS_AND_SYMBOLS, "ngrams", per_class, Ftrl())


def score_quality(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score of every whole text; a null text is an empty one."""
    return score(docs, model, out)


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with their own columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score_quality(docs, model, name).filter(F.col(name) >= threshold).select(*docs.columns)


def op10(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Rows of remainder 0 are held out of training. A null doc_id is scored and
    not held out. Repeated rows are scored alike; other columns are not read.
    """
    held = _fifth(F.col("doc_id")) == 0
    model = train_quality(documents, labels, usable=lambda d: _fifth(d) != 0)
    scored = score_quality(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
