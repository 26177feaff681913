"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunks import op4
from .common import table
from .embeddings import op9
from .fingerprint import op6
from .packing import op5
from .pieces import op2
from .quality import op10
from .repeats import op3
from .secrets import op8
from .simhash import op7
from .toxicity import op1


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8(table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(table(spark, sf_dir, "embeddings"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _op1,
    "op2_sentencepiece": _op2,
    "op3_repeats": _op3,
    "op4_chunks": _op4,
    "op5_packing": _op5,
    "op6_fingerprint": _op6,
    "op7_simhash": _op7,
    "op8_secrets": _op8,
    "op9_embeddings": _op9,
    "op10_quality": _op10,
}

#: The others hash, train, encode or pack in ways that SQL does not have, or not
#: over whole tables; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op9_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
        r(id, u) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.u),
        c AS (SELECT id, min(u) AS component_id FROM r GROUP BY id)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """,
}
