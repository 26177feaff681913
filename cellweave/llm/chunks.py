"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; a chunk ends where the hash meets a
mask, so boundaries follow content and come back into step after an insertion.
Chunks are known by digest; of equal chunks the first keeps its bytes, in the
order of doc_id and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, hot_join, pieces_of, saved, thrifty, utf8
from .repeats import cut, merged

#: A chunk has LEAST bytes at least, unless it is a whole text, and MOST at most
#: (the last one LEAST more); after LEAST bytes every place is a boundary with a
#: chance of one in 2**MASK_BITS.
LEAST = 32
MOST = 1024
MASK_BITS = 5
WINDOW = 16
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of gear[byte] << age over the last WINDOW bytes."""
    h, span = _GEAR[data], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length; none for an empty text."""
    if not text:
        return []
    h = gear(np.frombuffer(text, dtype=np.uint8))
    # the bits that the oldest byte of the window still reaches
    hits = (np.flatnonzero((h >> np.uint32(WINDOW - 1)) & np.uint32((1 << MASK_BITS) - 1) == 0) + 1).tolist()
    ends, start, n = [], 0, len(text)
    for e in hits:
        while e - start > MOST:
            start += MOST
            ends.append(start)
        if e - start >= LEAST:
            ends.append(e)
            start = e
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        # a short rest joins the chunk before it: alone it would be equal by chance
        if ends and n - start < LEAST:
            ends.pop()
        ends.append(n)
    return ends


def chunks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, th (hash of the text), start, size, d1, d2 (digest) of every chunk of every text."""
    schema = docs.select(F.col(key)).schema.add("th", "long").add("start", "integer").add("size", "integer").add("d1", "long").add("d2", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for whole in batches:
            for b in pieces_of(whole, "text", 2 << 20):
                of, start, size, found = [], [], [], []
                for i, t in enumerate(utf8(b.column("text"))):
                    at = 0
                    for e in boundaries(t):
                        of.append(i)
                        start.append(at)
                        size.append(e - at)
                        found.append(digest(t[at:e]))
                        at = e
                h = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
                rows = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(key).take(rows), b.column("th").take(rows), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], schema.names)

    return docs.select(key, F.xxhash64("text").alias("th"), "text").mapInArrow(thrifty(run), schema)


def duplicate_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, th, repeated, repeated_bytes, spans: for each text with chunks that occur elsewhere, how many, their bytes, and (start, end) of those that are not the first.

    Rows that repeat doc_id and text are one place.
    """
    with batches_of(docs.sparkSession):
        every = saved(chunks(docs), "chunks")
    place = F.xxhash64("doc_id", "th", "start")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th", "start")).alias("first")
    again = every.groupBy("d1", "d2").agg(F.count("*").alias("rows"), F.min(place).alias("low"), F.max(place).alias("high"), first)
    again = saved(again.filter("low < high").select("d1", "d2", "rows", "first"), "repeated")
    met = hot_join(every, again, ["d1", "d2"], "rows", every.count())
    keeps = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")) & (F.col("first.start") == F.col("start"))
    each = met.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "size", keeps.alias("keeps"))).alias("c"))
    spans = F.transform(F.filter("c", lambda x: ~x["keeps"]), lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["size"]).alias("end")))
    return each.select("doc_id", "th", F.size("c").alias("repeated"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("repeated_bytes"), spans.alias("spans"))


def op4(documents: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_repeated and n_removed (bytes), kept_sha256.

    n_repeated counts bytes of chunks that also occur elsewhere, n_removed those
    of chunks that occur earlier; kept_sha256 is of what is left. A null text is
    an empty one and has no chunks. Rows that repeat doc_id and text are one
    place and keep the same bytes. Null doc_ids come last.
    """
    found = saved(duplicate_chunks(documents.select("doc_id", "text")), "duplicates")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64("text").alias("th"))
    d = found.select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), "repeated_bytes", "spans")
    both = rows.join(d, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")), "left")
    schema = documents.select("doc_id").schema.add("n_bytes", "long").add("n_repeated", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            kept = [cut(t, merged(s)) for t, s in zip(texts, b.column("spans").to_pylist(), strict=True)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            gone = pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, b.column("repeated_bytes"), gone, pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], schema.names)

    return both.select("doc_id", "text", F.coalesce("repeated_bytes", F.lit(0).cast("long")).alias("repeated_bytes"), "spans").mapInArrow(thrifty(run), schema)
