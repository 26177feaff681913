"""Embedding near-duplicates by random-hyperplane sign hashing.

Each of several tables hashes a vector to the signs of its products with random
hyperplanes. Vectors that share a bucket of a table are compared by exact
cosine in double precision; a pair is counted only in the first table in which
it meets, so links are counted once. The number of signs follows the number of
vectors, and the number of tables follows from the recall asked for at the
threshold.

Equal vectors are one vector with a count. A bucket is cut into blocks, and
pairs of blocks are the unit of work, so a bucket of any size is spread over
tasks; a pair of blocks returns counts, and a spanning forest of its links in
place of all of them. Small buckets are compared many at a time, as one stack
of products. Vectors travel in the type they come in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import saved, thrifty
from .components import components

THRESHOLD = 0.95
RECALL = 0.999
BLOCK = 1024
SEED = 7
#: Buckets of at most so many vectors are compared in stacks.
STACK = 64


def layout(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs a table, tables): buckets of about 16 vectors, and ``recall`` of pairs at the threshold found."""
    signs = int(min(62, max(6, math.ceil(math.log2(max(n, 1) / 16 + 1)))))
    met = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - met))


def hyperplanes(dims: int, signs: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, signs * tables))


def usable(column: str):
    """True for vectors that can link: no nulls, all components finite, not all zero."""
    v = F.col(column)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & good & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pairs(unit: np.ndarray, bounds: np.ndarray, left: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) at ``threshold`` or more of each unit of work: all pairs of a block, or those between two.

    bounds: first row of each unit, and the number of rows. left: rows of the
    lower block of their unit, true for all rows of a unit of one block.
    """
    sizes = np.diff(bounds)
    sides = np.add.reduceat(left, bounds[:-1], dtype=np.int64) if len(left) else sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stacked = (sides == sizes) & (sizes <= STACK)
    padded = np.concatenate((unit, np.zeros((1, unit.shape[1]))))  # the row that fills a stack is near to nothing
    for width in (1 << k for k in range(1, STACK.bit_length())):
        own = np.flatnonzero(stacked & (sizes > width // 2) & (sizes <= width) & (sizes > 1))
        step = max(1, (1 << 21) // (width * unit.shape[1]))
        for k in range(0, len(own), step):
            at = bounds[own[k : k + step]][:, None] + np.arange(width)
            at = np.where(np.arange(width) < sizes[own[k : k + step]][:, None], at, len(unit))
            v = padded[at]
            g, i, j = np.nonzero(v @ v.transpose(0, 2, 1) >= threshold)
            keep = i < j
            found.append((at[g[keep], i[keep]], at[g[keep], j[keep]]))
    for u in np.flatnonzero(~stacked):
        rows = np.arange(bounds[u], bounds[u + 1])
        one = sides[u] == sizes[u]
        a, b = (rows, rows) if one else (rows[left[rows]], rows[~left[rows]])
        for k in range(0, len(a), 256):
            i, j = np.nonzero(unit[a[k : k + 256]] @ unit[b].T >= threshold)
            p, q = a[k + i], b[j]
            keep = p < q if one else slice(None)
            found.append((p[keep], q[keep]))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def _first_met(codes: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """True for pairs that share no code in a table before ``t``."""
    out = np.ones(len(a), dtype=bool)
    for k in range(0, len(a), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s] = ~((codes[a[s]] == codes[b[s]]) & (np.arange(codes.shape[1]) < t[s, None])).any(axis=1)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the smallest row of its component over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``key``, n_links, component_id, kept for every row of ``vectors``.

    Vectors that are null or zero or hold null or non-finite components link
    with nothing, and vectors of different lengths do not link. Rows that repeat
    a key are vectors of their own; a null key may link and is its own
    component_id only if no linked row has a key. An empty table gives no rows.
    Cosines are of doubles, whatever the type of the components.
    """
    known = vectors.schema[column].dataType
    kind = "float" if isinstance(known, ArrayType) and isinstance(known.elementType, FloatType) else "double"
    rows = vectors.select(F.col(key).alias("_key"), F.col(column).cast(f"array<{kind}>").alias("v"))
    good = rows.filter(usable("v"))
    groups = saved(good.groupBy("v").agg(F.count("*").alias("n"), F.min("_key").alias("least")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    signs, tables = layout(groups.count(), threshold, recall)
    planes: dict[int, np.ndarray] = {}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            codes = np.zeros((len(b), tables), dtype=np.int64)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = hyperplanes(int(d), signs, tables)
                own = np.flatnonzero(sizes == d)
                for k in range(0, len(own), 1024):
                    some = own[k : k + 1024]
                    bits = _unit(flat[at[some][:, None] + np.arange(d)].astype(np.float64)) @ planes[d] >= 0
                    codes[some] = bits.reshape(len(some), tables, signs) @ (1 << np.arange(signs, dtype=np.int64))
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), lists, pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], ["id", "n", "v", "codes"])

    signed = saved(groups.select("id", "n", "v").mapInArrow(thrifty(sign), f"id long, n long, v array<{kind}>, codes array<long>"), "signed")
    spots = signed.select("id", F.size("v").alias("dims"), F.posexplode("codes").alias("t", "code"))
    bucket = ["dims", "t", "code"]  # vectors of different lengths never share one
    sizes = spots.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1")
    sizes = saved(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "buckets")
    # which block of its bucket a vector is in: by hash, so without ordering a bucket
    placed = spots.join(sizes.select(*bucket, "blocks"), bucket)
    mine = F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int")
    pairs = placed.select("id", *bucket, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x, y = F.least("mine", "other"), F.greatest("mine", "other")
    unit = ["dims", "t", "code", "x", "y"]
    units = pairs.select("id", *bucket, x.alias("x"), y.alias("y"), (F.col("mine") == x).alias("left"))
    work = units.join(signed, "id").select(*unit, "left", "id", "n", "v", "codes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(b: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
            dims = b.column("dims").to_numpy()
            t = b.column("t").to_numpy()
            ids, weight = b.column("id").to_numpy(), b.column("n").to_numpy()
            left = b.column("left").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for d in np.unique(dims):  # rows of one length stand together
                s, e = np.searchsorted(dims, [d, d + 1])
                own = b.slice(s, e - s)
                v = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                codes = own.column("codes").flatten().to_numpy().reshape(-1, tables)
                bounds = np.append(first[(first >= s) & (first < e)], e) - s
                p, q = _pairs(_unit(v), bounds, left[s:e], threshold)
                new = _first_met(codes, p, q, t[s:e][p])
                p, q = p[new], q[new]
                count = np.bincount(p, weight[s:e][q], e - s) + np.bincount(q, weight[s:e][p], e - s)
                root = forest(p, q, e - s)
                hit = np.flatnonzero(count)
                out.append((ids[s:e][hit], count[hit].astype(np.int64), ids[s:e][root[hit]]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "root"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else b
            keys = np.stack([whole.column(c).to_numpy() for c in unit])
            first = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            if len(first) > 1:  # the last unit may go on in the next batch
                yield solve(whole.slice(0, first[-1]), first[:-1])
            held = [whole.slice(first[-1])]
        if held and len(held[0]):
            yield solve(held[0], np.zeros(1, dtype=np.int64))

    spread = work.repartition(*unit).sortWithinPartitions(*unit)
    found = saved(spread.mapInArrow(thrifty(compare), "id long, links long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    with_root = groups.join(comps.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    with_root = saved(with_root.select("v", "n", "least", F.coalesce("component", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "rooted")
    least = saved(with_root.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = saved(with_root.join(least, "root").select("v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    linked = good.join(named, "v").select("_key", "n_links", "component_id")
    alone = rows.filter(~usable("v")).select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    out = linked.unionByName(alone)
    kept = F.coalesce(F.col("_key") == F.col("component_id"), F.col("_key").eqNullSafe(F.col("component_id")))
    return out.select(F.col("_key").alias(key), "n_links", "component_id", kept.alias("kept"))


def op9(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings``."""
    return near_duplicates(embeddings)
