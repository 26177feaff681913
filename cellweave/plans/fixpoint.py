"""Iteration: a fixed number of steps, or steps until nothing changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved


class NotStable(RuntimeError):
    """The step limit was met before a state repeated itself."""


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, every: int = 2) -> DataFrame:
    """``n`` steps; lineage is cut after every ``every``, so plans stay small."""
    for i in range(n):
        state = step(state)
        if (i + 1) % every == 0 and i + 1 < n:
            state = saved(state)
    return state


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Column, limit: int = 1000) -> DataFrame:
    """Steps until ``changed`` (over the columns that ``step`` returns) is true of no row.

    One job a step: the new state is written once, and its flag is read from it.
    """
    state = saved(state)
    for _ in range(limit):
        state = saved(step(state))
        if state.filter(changed).isEmpty():
            return state
    raise NotStable(f"not stable after {limit} steps")


#: Lists of at most so many links are closed in one task.
SMALL = 200_000


def _close(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable), by hooking and jumping on whole arrays."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _close_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        ids, root = _close(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], ["id", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(id, root): the smallest id reachable from each id of ``links``.

    Nodes hook to the smallest of their closed neighbourhood, look one hook
    further, and the links are contracted; rounds grow with the logarithm of the
    longest path, not with its length. Once at most ``small`` links are left, one
    task closes them; ``small`` of 0 leaves nothing to one task. Links may
    repeat, point at themselves or hold nulls (passed over). Rounds end in
    written tables, so a lost executor costs the work of one.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = saved(links.filter(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "links")
    found: DataFrame | None = None

    def moved(by: DataFrame) -> DataFrame:
        """Roots so far, taken on by (id, root) of ``by``."""
        if found is None:
            return by
        step = by.select(F.col("id").alias("root"), F.col("root").alias("to"))
        return found.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root"))

    while (n := edges.count()) > small:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        hook = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "hook")
        hook = saved(hook.join(hook.selectExpr("u AS to", "to AS far"), "to").selectExpr("u", "far AS to"), "jump")
        found = saved(moved(hook.selectExpr("u AS id", "to AS root")), "found")
        between = edges.join(hook.selectExpr("u", "to AS p"), "u").join(hook.selectExpr("u AS v", "to AS q"), "v").filter("p != q")
        edges = saved(between.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "links")
    if n:
        return saved(moved(saved(edges.repartition(1).mapInArrow(_close_task, "id long, root long"), "closed")), "found")
    return edges.selectExpr("u AS id", "v AS root") if found is None else found


def roots(pointers: DataFrame, key: str = "id", to: str = "parent", limit: int = 64) -> DataFrame:
    """(key, root) by pointer doubling; a pointer to itself, or to nowhere, ends a chain. Chains must not be cycles."""
    state = saved(pointers.select(F.col(key).alias("id"), F.col(to).alias("root"), F.lit(True).alias("moved")), "pointers")
    for _ in range(limit):
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("far"))
        state = state.join(ahead, "root", "left").select("id", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("root")).alias("moved"))
        state = saved(state, "pointers")
        if state.filter("moved").isEmpty():
            return state.select(F.col("id").alias(key), "root")
    raise NotStable("pointers run in a cycle")
