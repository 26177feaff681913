"""Threshold-scaled document fingerprints, in DataFrame operations only.

A sketch keeps every distinct shingle hash below a fraction of the hash range,
the threshold. It is ``2**-SHIFT`` for all texts of ``LEAST * 2**SHIFT`` distinct
shingles or more; for shorter texts it is scaled up with the number of their
shingles, by powers of two, so that about ``LEAST`` hashes stay. Below the
smaller of two thresholds both sketches hold every hash, whatever the lengths of
the texts: there they merge by union (``union``), and the share of the hashes of
one that the other holds estimates containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
SHIFT = 3
LEAST = 32
_TOP = (1 << 63) - 1


def sketch(df: DataFrame, text: str, hashes: str, bound: str, words: int = WORDS, shift: int = SHIFT, least: int = LEAST) -> DataFrame:
    """``df`` with ``hashes`` (sorted distinct 63-bit hashes) and ``bound`` (the threshold) of the column ``text``.

    Words are what stands between white space, lower-cased. A text of fewer
    words than a shingle has one shingle, of all its words; one without words,
    or null, has an empty sketch. A text of n distinct shingles has the threshold
    2**-k, k the largest up to ``shift`` for which n >= least * 2**k, or 0.
    """
    keep = [F.col(c) for c in df.columns]
    of_words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    step1 = df.select(*keep, F.transform(of_words, lambda w: F.xxhash64(w)).alias("_w"))
    shingle = ", ".join(f"_w[i + {k}]" for k in range(words))
    every = F.expr(
        f"CASE WHEN size(_w) >= {words} THEN transform(sequence(0, size(_w) - {words}), i -> xxhash64({shingle}) & {_TOP}L) "
        f"WHEN size(_w) > 0 THEN array(xxhash64(_w) & {_TOP}L) ELSE CAST(array() AS array<bigint>) END"
    )
    step2 = step1.select(*keep, F.array_distinct(every).alias("_all"))
    scale = F.lit(_TOP)
    for k in range(1, shift + 1):
        scale = F.when(F.size("_all") >= least << k, F.lit(_TOP >> k)).otherwise(scale)
    step3 = step2.select(*keep, "_all", scale.alias(bound))
    return step3.select(*keep, F.sort_array(F.filter("_all", lambda h: h <= F.col(bound))).alias(hashes), bound)


def union(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """(hashes, bound) of both texts together, from (hashes, bound) of each: what is below the smaller bound."""
    bound = F.least(a[1], b[1])
    return F.sort_array(F.array_union(_below(a[0], bound), _below(b[0], bound))), bound


def _below(hashes: Column, bound: Column) -> Column:
    return F.filter(hashes, lambda h: h <= bound)


def likeness(df: DataFrame, a: tuple[str, str], b: tuple[str, str], out: str, contained: str) -> DataFrame:
    """``df`` with ``out``, the estimated resemblance of sketches a and b, and ``contained``, the share of a in b.

    Two empty sketches are alike (1); one empty sketch is like no other (0).
    """
    keep = [F.col(c) for c in df.columns]
    bound = F.least(F.col(a[1]), F.col(b[1]))
    cut = df.select(*keep, _below(F.col(a[0]), bound).alias("_a"), _below(F.col(b[0]), bound).alias("_b"))
    met = cut.select(*keep, F.size("_a").alias("_na"), F.size("_b").alias("_nb"), F.size(F.array_intersect("_a", "_b")).alias("_n"))
    both = F.col("_na") + F.col("_nb") - F.col("_n")
    same = F.when(F.col(a[0]) == F.col(b[0]), 1.0).otherwise(0.0)
    return met.select(*keep, F.when(both > 0, F.col("_n") / both).otherwise(same).alias(out), F.when(F.col("_na") > 0, F.col("_n") / F.col("_na")).otherwise(same).alias(contained))


def as_text(hashes: str, bound: str) -> Column:
    """The fingerprint string: the bound, a colon and the hashes, all in hexadecimal."""
    return F.concat_ws(":", F.lower(F.hex(bound)), F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ","))


def with_next(docs: DataFrame, per_bucket: int = 512, most_buckets: int = 65536) -> DataFrame:
    """doc_id, text and bucket of every row, plus one row a bucket that repeats the head of the next.

    Rows stand in descending order of doc_id, a whole number (nulls last; equal
    ids by text). A bucket is a stretch of this order between quantiles of
    doc_id, one for each bucket, so all are of a like size however the ids lie.
    The extra rows (tail = 1) let a window inside each bucket see the row after
    its last; the last bucket is followed by the first. There are at most
    ``most_buckets`` buckets, so what the driver holds is bounded; from 3e7 rows
    on they grow, and a window sorts and spills more, but holds two rows.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = ids.count()
    many = max(1, min(most_buckets, n // per_bucket))
    fan = math.isqrt(many - 1) + 1  # bounds are looked up among every fan-th of them first
    shares = F.split(F.lit(",".join(repr(k / many) for k in range(many + 1))), ",").cast("array<double>")  # folded to a constant
    found = ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10000, 4 * many))).alias("q")).first()["q"]  # one number a bucket
    bounds = sorted(set(found or []), reverse=True)
    if bounds:
        flat, heads = (F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") for v in (bounds, bounds[::fan]))

        def above(values: Column) -> Column:
            return F.size(F.filter(values, lambda q: q > F.col("doc_id")))

        row = F.greatest(above(heads), F.lit(1)) - 1
        bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(row * fan + above(F.slice(flat, row * fan + 1, F.lit(fan))))
    else:
        bucket = F.lit(1)
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), bucket.cast("int").alias("bucket"))
    heads_of = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # one id for each of a bounded number of buckets
    order = sorted(r["bucket"] for r in heads_of)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    if not heads_of:
        return placed.withColumn("tail", F.lit(0))
    small = spark.createDataFrame([(r["bucket"], r["doc_id"], before[r["bucket"]]) for r in heads_of], "b int, head long, prior int")
    at_head = placed.join(F.broadcast(small), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = at_head.groupBy("prior", "head").agg(F.min("text").alias("text"))
    copies = first.select(F.col("head").alias("doc_id"), "text", F.col("prior").alias("bucket"), F.lit(1).alias("tail"))
    return placed.withColumn("tail", F.lit(0)).unionByName(copies)


def op6(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text.

    A null text is an empty one. doc_id is a whole number; a null one comes after
    all others, rows of one doc_id are ordered by text, and a table of one row is
    its own next.
    """
    rows = with_next(documents.select("doc_id", "text"))
    own = sketch(rows, "text", "h", "b")
    w = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").desc_nulls_last(), "text")
    led = own.select("doc_id", "text", "tail", "h", "b", F.lead("text").over(w).alias("nt"), F.lead("h").over(w).alias("nh"), F.lead("b").over(w).alias("nb")).filter("tail = 0")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.col("nt"), F.lit(1), cut))
    made = led.select("doc_id", n.cast("long").alias("n_chars"), "h", "b", "nh", "nb", edited.alias("e"))
    made = sketch(made, "e", "eh", "eb")
    made = likeness(made, ("h", "b"), ("eh", "eb"), "near_edited", "contained_edited")
    made = likeness(made, ("h", "b"), ("nh", "nb"), "near_next", "contained_next")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("e", 256).alias("edited_sha256"),
        as_text("h", "b").alias("fingerprint"),
        as_text("eh", "eb").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "contained_edited",
        "contained_next",
    )
