"""Reductions, scans and statistics of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..plans.storage import saved


def stats(grid: Grid, column: str = "v") -> DataFrame:
    """Extents, least, most, mean and sum of a value column, a row for each grid of the frame."""
    aggs = [(F.max(a) + 1).cast("int").alias(f"n{a}") for a in grid.axes]
    c = F.col(column)
    out = grid.df.groupBy(*grid.keys) if grid.keys else grid.df
    return out.agg(*aggs, F.count("*").alias("cells"), F.min(c).alias("least"), F.max(c).alias("most"), F.sum(c).alias("total"), F.avg(c).alias("mean"))


def fold(values: DataFrame, column: str, zero: Column, op: Callable[[Column, Column], Column], group: int = 1 << 16) -> DataFrame:
    """Reduce a column by any associative and commutative ``op`` with neutral ``zero``; one row, column ``v``.

    Values are folded in groups of ``group`` rows at most, whatever the values,
    then the results of groups, until one is left.
    """
    n = values.count()
    left = values.select(F.col(column).alias("v"))
    while n > group:
        row = F.monotonically_increasing_id()  # rows of a partition stand together
        left = saved(left.groupBy(F.floor(row / group).alias("g")).agg(F.aggregate(F.collect_list("v"), zero, op).alias("v")).select("v"), "fold")
        n, before = left.count(), n
        if n * 2 > before:  # partitions of few rows each
            left = left.coalesce(max(1, n // group))
    return left.agg(F.aggregate(F.collect_list("v"), zero, op).alias("v"))


def sum_differences(a: Grid, b: Grid, column: str = "v") -> DataFrame:
    """Sum of absolute differences of two grids, one row, column ``v``."""
    both = a.zip(b.map(_o=F.col(column)))
    return both.df.agg(F.sum(F.abs(F.col(column) - F.col("_o"))).alias("v"))


def mask_difference(a: Grid, b: Grid, column: str = "v", value: int = 255) -> DataFrame:
    """Cells where two masks differ, and cells of the first with ``value``."""
    both = a.zip(b.map(_o=F.col(column)))
    return both.df.agg(F.count_if(F.col(column) != F.col("_o")).alias("different"), F.count_if(F.col(column) == value).alias("marked"))


def scan(grid: Grid, column: str, axis: str = "x", op: Callable[[Column], Column] = F.sum, out: str = "scan") -> Grid:
    """Inclusive prefix of ``op`` (sum, min, max …) along an axis."""
    w = Window.partitionBy(*(a for a in grid.coords if a != axis)).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return grid.add(**{out: op(F.col(column)).over(w)})


def integral(grid: Grid, column: str, out: str = "integral") -> Grid:
    """Sum over the box from the origin to each cell: a scan along every axis."""
    g, name = grid, column
    for a in grid.axes:
        g, name = scan(g, name, a, out=out), out
    return g


def _ahead(sums: DataFrame, chunk: int) -> DataFrame:
    """_c, _b: for each chunk number the sum of _s over all smaller ones, in chunks of chunks, so that no task holds them all."""
    sums = saved(sums, "sums")
    to_here = F.coalesce(F.sum("_s").over(Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if sums.count() <= chunk:
        return sums.withColumn("_g", F.lit(0)).select("_c", to_here.alias("_b"))
    groups = sums.withColumn("_g", F.floor(F.col("_c") / chunk))
    over = _ahead(groups.groupBy(F.col("_g").alias("_c")).agg(F.sum("_s").alias("_s")), chunk)
    within = groups.select("_c", "_g", to_here.alias("_w"))
    return within.join(over.select(F.col("_c").alias("_g"), "_b"), "_g").select("_c", (F.col("_w") + F.col("_b")).alias("_b"))


def scan_long(df: DataFrame, order: str, column: str, out: str = "scan", chunk: int = 1 << 16) -> DataFrame:
    """Inclusive prefix sum over one row of any length, by chunks of ``order`` (whole numbers from 0).

    Sums of chunks are scanned, again by chunks where there are many, and each
    chunk is scanned on its own with what comes before it, so no task holds more
    than a chunk.
    """
    with_chunk = df.withColumn("_c", F.floor(F.col(order) / chunk))
    ahead = _ahead(with_chunk.groupBy("_c").agg(F.sum(column).alias("_s")), chunk)
    w = Window.partitionBy("_c").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return with_chunk.withColumn(out, F.sum(column).over(w)).join(ahead, "_c").withColumn(out, F.col(out) + F.col("_b")).drop("_c", "_b")


def dense_labels(labels: DataFrame, column: str = "label", start: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """Labels renumbered without gaps from ``start``, in their order.

    Only distinct labels are numbered, in chunks of the label range, so the
    numbering is not one task's work either.
    """
    distinct = saved(labels.select(column).distinct().withColumn("_c", F.floor(F.col(column) / chunk)), "distinct")
    ahead = _ahead(distinct.groupBy("_c").agg(F.count("*").alias("_s")), chunk)
    rank = F.row_number().over(Window.partitionBy("_c").orderBy(column))
    table = saved(distinct.withColumn("_r", rank).join(ahead, "_c").select(column, (F.col("_r") + F.col("_b") + (start - 1)).alias("_new")), "labels")
    return labels.join(table, column).withColumn(column, F.col("_new")).drop("_new")


def masked_labels(labels: Grid, mask: Grid, label: str = "label", m: str = "m", value: int = 255) -> DataFrame:
    """Distinct labels under cells of the mask with ``value``."""
    return labels.zip(mask).df.filter(F.col(m) == value).select(label).distinct()


def markers(labels: Grid, mask: Grid, label: str = "label", m: str = "m") -> DataFrame:
    """(kind, label): f for labels under 255, b for labels under 128; a label may be both."""
    kind = F.when(F.col(m) == 255, "f").when(F.col(m) == 128, "b")
    return labels.zip(mask).df.select(kind.alias("kind"), label).filter("kind IS NOT NULL").distinct()


def region_nodes(grid: Grid, label: str = "label", column: str = "v") -> DataFrame:
    """label, n, s, ss: cells, sum and sum of squares of each region."""
    v = F.col(column)
    return grid.df.groupBy(label).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def region_edges(grid: Grid, label: str = "label", column: str = "v", literal: bool = False) -> DataFrame:
    """l1 < l2, n, s: adjacent pairs of regions, the number of touching sides and their weight.

    The weight of a side is (1 / (1 + larger value))². literal: pass over all
    sides of cells on any far face.
    """
    v1, v2, l1, l2 = F.col(column), F.col("_v2"), F.col(label), F.col("_l2")
    out = None
    inner = F.lit(True)
    for a in grid.axes:
        inner = inner & (F.col(a) < grid.extent(a) - 1)
    for axis in grid.axes:
        w = Window.partitionBy(*(a for a in grid.coords if a != axis)).orderBy(axis)
        one = grid.df.select("*", F.lead(label).over(w).alias("_l2"), F.lead(column).over(w).alias("_v2"))
        one = one.filter(inner if literal else F.lit(True)).filter(l1 != l2)
        weight = F.pow(1.0 / (1.0 + F.greatest(v1, v2)), F.lit(2.0))
        one = one.select(F.least(l1, l2).alias("l1"), F.greatest(l1, l2).alias("l2"), weight.alias("w"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("l1", "l2").agg(F.count("*").alias("n"), F.sum("w").alias("s"))


def timer_report(events: DataFrame, timer: str, ident: str, duration: str) -> DataFrame:
    """For each timer: count, sum, mean, and the longest and shortest with their ids (smallest id of equals)."""
    d, i = F.col(duration), F.col(ident)
    longest = F.max(F.struct(d, (-i).alias("i")))
    shortest = F.min(F.struct(d, i.alias("i")))
    return events.groupBy(timer).agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"), F.max(d).alias("longest"), (-longest["i"]).alias("longest_id"), F.min(d).alias("shortest"), shortest["i"].alias("shortest_id"))
