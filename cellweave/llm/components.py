"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import fixpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``links``: the smallest node reachable.

    The library's components with nothing left to one task: links may repeat,
    point at themselves or hold nulls (passed over), and a hub with a large
    share of the links is one side of a plain join, which adaptive execution
    splits.
    """
    return fixpoint.components(links, a, b, small=0).selectExpr("id AS node", "root AS component")
