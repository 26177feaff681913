"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints at
two or fewer differing bits have a segment that differs in at most one bit, so
each fingerprint looks up, for each segment, the Hamming ball of radius one
around its own value in the table of that segment, and what is fetched is
verified on all 64 bits. Only one of two partners has to find the other: the
second segment is looked up exactly, and in the first only bits that are 0 are
flipped.

A segment value that more than ``crowd`` distinct fingerprints share is not
fetched. The fingerprints of such values and those that look them up are
compared in full space instead: each stands under the 65 values within one bit
of it, and two fingerprints meet there if and only if they differ in at most
two bits. A value has 65 such fingerprints at most, so no group is unbounded
and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, pieces_of, saved, thrifty, utf8
from .components import components

SEED = 42
SHINGLE = 3
CROWD = 64
_FOLD = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a whole text, unsigned; 0 if it has no word."""
    words = text.translate(_FOLD).split()  # bytes.split cuts at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :][:n] - 1
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):  # whole texts, in blocks of bounded size
        h = np.fromiter(
            (digest(joined[s:e], seed) for s, e in zip(starts[k : k + 65536].tolist(), last[k : k + 65536].tolist(), strict=False)),
            dtype=">u8",
        )
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, out: str = "fp") -> DataFrame:
    """``docs`` (with a column text) without its text, with the signed fingerprint ``out``."""
    names = [n for n in docs.columns if n not in ("text", out)]
    schema = docs.select(*names).schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole, "text", 4 << 20):
                fps = np.array([simhash(t) for t in utf8(b.column("text"))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps)], [*names, out])

    return docs.mapInArrow(thrifty(run), schema)


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints at two or fewer differing bits.

    fps: one column fp, distinct. Every such pair is linked, directly or through
    others that are linked with both.
    """
    both = fps.selectExpr("fp", "shiftrightunsigned(fp, 32) AS one", "fp & 4294967295L AS two")
    index = both.selectExpr("fp", "stack(2, 1, one, 2, two) AS (seg, key)")
    flipped = "filter(transform(sequence(0, 31), i -> one | shiftleft(1L, i)), k -> k != one)"
    probes = both.selectExpr("fp", "2 AS seg", "two AS key").unionByName(
        both.selectExpr("fp", "1 AS seg", f"explode(concat(array(one), {flipped})) AS key")
    )
    sizes = saved(index.groupBy("seg", "key").agg(F.count("*").alias("n")), "sizes")
    known = probes.join(sizes, ["seg", "key"])
    near = (
        known.filter(F.col("n") <= crowd)
        .drop("n")
        .join(index.withColumnRenamed("fp", "other"), ["seg", "key"])
        .filter((F.col("fp") != F.col("other")) & (_distance(F.col("fp"), F.col("other")) <= 2))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    full = sizes.filter(F.col("n") > crowd).select("seg", "key")
    within = probes.join(full, ["seg", "key"]).select("fp").unionByName(index.join(full, ["seg", "key"]).select("fp")).distinct()
    met = within.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) AS at")
    first = met.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).filter("b < last").drop("last")
    crowded = met.join(first, "at").filter("fp != b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(crowded)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text), fp (signed), component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints at two or
    fewer differing bits. Equal fingerprints are one node, so a group of copies
    of any size is one row in the search. A null text is an empty one; empty
    texts have fingerprint 0. A null doc_id gets its group's component_id, null
    if no row of the group has a doc_id. Repeated rows get equal rows.
    """
    with batches_of(docs.sparkSession):
        of = saved(fingerprints(docs.select("doc_id", F.xxhash64("text").alias("th"), "text")), "fingerprints")
    groups = saved(of.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = saved(links(groups.select("fp"), crowd), "pairs")
    joined = components(linked).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = saved(groups.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = saved(rooted.join(least, "root").select("fp", "component_id"), "named")
    return of.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each group of near-duplicates of ``docs``: the one of smallest doc_id.

    Rows are told apart by doc_id and text, so unlike texts of one doc_id go or
    stay each with its own group. Rows of a group that share its smallest doc_id
    stay, and so do rows without a doc_id.
    """
    gone = near_duplicates(docs, crowd).filter("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_th")).distinct()
    d = docs.alias("d")
    return d.join(gone, (F.col("d.doc_id") == F.col("_gone")) & (F.xxhash64("d.text") == F.col("_th")), "left_anti").select(*(F.col(f"d.`{c}`") for c in docs.columns))


def op7(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``documents``."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(documents).select("doc_id", hexed.alias("fingerprint"), "component_id")
