"""Removal of repeated stretches of bytes by run-length indexes.

Every window of ``size`` bytes has an anchor gram that content alone chooses
(``anchors``), so windows can only be equal if their anchors are. A stretch is
what the windows of one place with one anchor cover; all stretches of an anchor
that occurs twice are brought together, and for each bounded batch of anchors a
run-compressed Burrows-Wheeler transform of them is built, with samples at the
ends of its runs. The longest match of each position with any other is streamed
from the samples: between two of them it only loses a byte a step. Windows whose
match has ``size`` bytes or more are repeated; nothing else decides that.

Stretches that are equal byte by byte enter an index twice at most, however
often they occur, which changes no match: so copies of whole texts cost two
strings a stretch, and these fall into the same runs.

An anchor with more than ``CROWD`` distinct stretches does not fit a bounded
batch. Its stretches are cut into blocks of windows, lined up by the anchor, and
the bytes that all windows of a block share take the place of the anchor: equal
windows still meet. Groups that are still too large are cut finer, down to
single windows, of which all are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import batches_of, hot_join, pieces_of, saved, thrifty, utf8

SIZE = 400
CROWD = 256
#: Windows in a block of a crowded anchor, from one round to the next.
STEPS = (64, 8, 1)
#: Bytes of a batch: its arrays stay in the cache of a core.
BATCH = 1 << 16
_MARKS = "array<struct<first:int,last:int>>"
_SPANS = "array<struct<start:int,end:int>>"


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of a byte text, sampled at run ends.

    Byte 0xFF does not occur in UTF-8; codes are ranks of the bytes that occur,
    and 0 ends each string. ``heads`` and ``tails`` are text positions of the
    first and last row of each run, ``runs`` the first row and code of each run.
    The ends of strings differ, in the order of the strings. Suffixes are sorted by their first codes, then by twice as many with each
    round; ``ranks`` keeps the order by so many codes.
    """

    def __init__(self, strings: list[bytes]):
        raw = np.frombuffer(b"\xff".join(strings) + b"\xff", dtype=np.uint8)
        met = np.zeros(256, dtype=bool)
        met[raw] = True
        met[255] = False
        code = np.cumsum(met, dtype=np.uint8)
        code[255] = 0
        self.text = text = code[raw]
        n = len(text)
        sizes = np.array([len(s) + 1 for s in strings])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # codes of each suffix up to the end of its string
        place, width = n.bit_length(), max(int(code[254]).bit_length(), 1)
        self.first = depth = max(min((64 - place) // width, n), 1)
        key = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate((text, np.zeros(depth, np.uint8)))
        for j in range(depth):
            key <<= np.uint64(width)
            key |= padded[j : j + n]
        after = (np.maximum(depth - left, 0) * width).astype(np.uint64)
        key = (key >> after) << after  # nothing of the next string
        self.ranks: dict[int, np.ndarray] = {}
        while True:
            order, rank = self._sorted(key, place, left <= depth)
            self.ranks[depth] = rank
            if int(rank[order[-1]]) == n:
                break
            key = rank.astype(np.uint64)
            key <<= np.uint64(place)
            key[: max(n - depth, 0)] |= rank[depth:]
            depth *= 2
        last = text[order - 1].astype(np.int16)  # the code before each suffix
        last[order == 0] = 0
        new = np.concatenate(([True], (last[1:] != last[:-1]) | (last[1:] == 0)))  # ends of strings differ: each is a run of its own
        first = np.flatnonzero(new)
        end = np.concatenate((first[1:], [n])) - 1
        self.runs = (first, last[first])
        self.heads, self.tails = order[first], order[end]
        # longest common prefixes at the borders between runs, the irreducible ones
        self.border = self._common(self.heads[1:], self.tails[:-1])

    @staticmethod
    def _sorted(key: np.ndarray, place: int, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of ``key``, and the rank from 1 of each position, equal for equal keys.

        Positions whose string has ``ended`` within the key differ by where they
        stand: the ends of strings are codes of their own, in this order.
        """
        n = len(key)
        if int(key.max()).bit_length() + place <= 64:  # key and position in one word: sorting words is fast
            key <<= np.uint64(place)
            key |= np.arange(n, dtype=np.uint64)
            key.sort()
            mask = np.uint64((1 << place) - 1)
            new = (key[1:] ^ key[:-1]) > mask
            key &= mask
            order = key.view(np.int64)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = ordered[1:] != ordered[:-1]
        count = np.empty(n, dtype=np.uint32)
        count[0] = 1
        count[1:] = new | ended[order[1:]]
        np.cumsum(count, out=count)
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = count
        return order, rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        n = len(self.text)
        total = np.zeros(len(a), dtype=np.int64)
        for depth in sorted(self.ranks, reverse=True):
            rank = self.ranks[depth]
            inside = (a < n) & (b < n)
            step = np.where(inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]), depth, 0)
            total += step
            a += step
            b += step
        for _ in range(self.first - 1):
            inside = (a < n) & (b < n)
            same = inside & (self.text[np.minimum(a, n - 1)] == self.text[np.minimum(b, n - 1)])
            total += same
            a += same
            b += same
        return total

    def _stream(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Match lengths of all positions from those sampled: one less for each byte after a sample."""
        n = len(self.text)
        reach = np.zeros(n, dtype=np.int64)
        reach[at] = value + at
        where = np.zeros(n, dtype=np.int64)
        where[at] = at
        return np.maximum(reach[np.maximum.accumulate(where)] - np.arange(n), 0)

    def matches(self) -> np.ndarray:
        """For every position, the length of its longest match with another position."""
        before = self._stream(self.heads, np.concatenate(([0], self.border)))
        after = self._stream(self.tails, np.concatenate((self.border, [0])))
        return np.maximum(before, after)


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def repeated_windows(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of the runs of window starts that also occur elsewhere in ``strings``, in order."""
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    whole = np.arange(ends[-1]) + size < np.repeat(ends, sizes)  # a window that ends with its string
    first, last = ranges((RunIndex(strings).matches() >= size) & whole)
    of = np.searchsorted(ends, first, side="right")
    start = (ends - sizes)[of]
    return of, first - start, last - start


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _stretches(docs: DataFrame, size: int) -> DataFrame:
    """t1, t2, k, los, n, w, off, anchor, digest: distinct stretches of windows with one anchor, of every text.

    A stretch has w windows from each of the n bytes los of its text, and its
    anchor off bytes further. Text that repeats itself at short range thus costs
    a row a text, not a row a period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64 = xxhash.xxh3_64_intdigest
        for whole in batches:
            for b in pieces_of(whole, "text", 1 << 20):
                texts = utf8(b.column("text"))
                t, lo, hi, at, anchor = anchors(texts, size)
                off = at - lo
                digest = np.array([h64(texts[i][s:e], o) for i, s, e, o in zip(t.tolist(), lo.tolist(), (hi + size).tolist(), off.tolist(), strict=True)], dtype=np.uint64)
                # equal stretches of one text are one row
                order = np.lexsort((lo, digest, t))
                new = np.concatenate(([True], (digest[order[1:]] != digest[order[:-1]]) | (t[order[1:]] != t[order[:-1]])))[: len(order)]
                first = order[new]
                cuts = np.append(np.flatnonzero(new), len(order))
                rows = pa.array(t[first])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(lo[order], pa.int32()))
                made = (np.diff(cuts), (hi - lo + 1)[first], off[first])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(rows) for c in ("t1", "t2", "k")), lists, *(pa.array(c, pa.int32()) for c in made), pa.array(anchor[first].view(np.int64)), pa.array(digest[first].view(np.int64))],
                    ["t1", "t2", "k", "los", "n", "w", "off", "anchor", "digest"],
                )

    return docs.select("t1", "t2", "k", "text").mapInArrow(thrifty(run), "t1 long, t2 long, k long, los array<int>, n int, w int, off int, anchor long, digest long")


def _strings(candidates: DataFrame, size: int) -> DataFrame:
    """g, d, n, many, off, bytes: the stretches that ``reps`` of each row names. Rows that repeat one text give them once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        names = ["g", "d", "n", "many", "off", "bytes"]
        for b in (b for whole in batches for b in pieces_of(whole, "text", 1 << 20)):
            found: list[list] = [[] for _ in names]
            for key, x, reps in zip(zip(b.column("t1").to_pylist(), b.column("t2").to_pylist(), strict=True), utf8(b.column("text")), b.column("reps").to_pylist(), strict=True):
                if key in done:
                    continue
                done.add(key)
                for r in reps:
                    for c, v in zip(found, (*(r[c] for c in names[:-1]), x[r["lo"] : r["lo"] + r["w"] - 1 + size]), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names)

    return candidates.filter(F.size("reps") > 0).select("t1", "t2", "text", "reps").mapInArrow(thrifty(run), "g long, d long, n int, many long, off int, bytes binary")


def _indexed(strings: DataFrame, size: int) -> DataFrame:
    """g, d, marks: runs (first, last) of repeated windows of each string that has any, by run-length indexes.

    strings: g, d, n, bytes; those of one g are together. One that occurs twice
    (n) stands in its index twice.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        copies = np.array([min(r[2], 2) for r in rows])
        of, first, last = repeated_windows([r[3] for r in rows for _ in range(min(r[2], 2))], size)
        at = np.cumsum(copies) - copies  # the first copy of each row
        row = np.searchsorted(at, of, side="right") - 1
        own = at[row] == of
        hit, begin = np.unique(row[own], return_index=True)
        pairs = pa.StructArray.from_arrays([pa.array(first[own], pa.int32()), pa.array(last[own], pa.int32())], ["first", "last"])
        marks = pa.ListArray.from_arrays(pa.array(np.append(begin, own.sum()), pa.int32()), pairs)
        return pa.RecordBatch.from_arrays([*(pa.array([rows[i][c] for i in hit], pa.int64()) for c in (0, 1)), marks], ["g", "d", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "d", "n", "bytes")), strict=True):
                if held and row[:2] == held[-1][:2]:
                    continue  # the same string, from another task
                if held and row[0] != held[-1][0] and total > BATCH:
                    yield solve(held)
                    held, total = [], 0
                held.append(row)
                total += len(row[3]) * min(row[2], 2)
        if held:
            yield solve(held)

    ordered = strings.select("g", "d", "n", "bytes").repartition("g").sortWithinPartitions("g", "d")
    return ordered.mapInArrow(thrifty(run), f"g long, d long, marks {_MARKS}")


def _blocks(step: int, size: int):
    """Blocks of ``step`` windows of each string: of which string, its first window in it, and what it is as a string."""
    far = 1 << 20  # keeps places relative to the anchor positive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h64, mask = xxhash.xxh3_64_intdigest, (1 << 64) - 1
        for b in batches:
            out: list[tuple] = []
            keys: tuple[list[int], list[int]] = ([], [])
            for g, d, n, off, x in zip(*(b.column(c).to_pylist() for c in ("g", "d", "n", "off", "bytes")), strict=True):
                w, base = len(x) - size + 1, far - off
                for k in range(base // step, (base + w - 1) // step + 1):
                    low = k * step - base
                    first, last = max(low, 0), min(low + step - 1, w - 1)
                    part = x[first : last + size]
                    keys[0].append(h64(x[low + step - 1 : low + size], (g * 31 + k) & mask))
                    keys[1].append(h64(part, first - low))
                    out.append((g, d, min(n, 2), first, off - first, part))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *map(_signed, keys)], ["pg", "pd", "n", "start", "off", "bytes", "g", "d"])

    return run


def _decided(strings: DataFrame, size: int, crowd: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """As ``_indexed``, for groups g of any number of strings.

    strings: a saved table of g, d, n, many (distinct strings of the group), off,
    bytes. Groups of more than ``crowd`` strings are cut into blocks of windows,
    which are strings of groups of their own.
    """
    found = _indexed(strings.filter(F.col("many") <= crowd) if steps else strings, size)
    full = strings.filter(F.col("many") > crowd)
    if not steps or full.isEmpty():
        return found
    schema = "pg long, pd long, n int, start int, off int, bytes binary, g long, d long"
    rows = saved(full.dropDuplicates(["g", "d"]).mapInArrow(thrifty(_blocks(steps[0], size)), schema), "blocks")
    kinds = rows.groupBy("g", "d").agg(F.sum("n").cast("int").alias("n"), F.count("*").alias("parents"), F.min("off").alias("off"), F.min("bytes").alias("bytes"))
    kinds = saved(kinds, "kinds")
    many = saved(kinds.groupBy("g").agg(F.count("*").alias("many"), F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all"), "many")
    inner = saved(kinds.join(many, "g"), "inner")
    marks = saved(_decided(inner.drop("parents"), size, crowd, steps[1:]).join(inner.select("g", "d", "parents"), ["g", "d"]), "marks")
    up = hot_join(rows.select("pg", "pd", "g", "d", "start"), marks, ["g", "d"], "parents", rows.count())
    moved = F.transform("marks", lambda m: F.struct((m["first"] + F.col("start")).alias("first"), (m["last"] + F.col("start")).alias("last")))
    whole = up.select("pg", "pd", moved.alias("m")).groupBy(F.col("pg").alias("g"), F.col("pd").alias("d")).agg(F.flatten(F.collect_list("m")).alias("marks"))
    return found.unionByName(whole)


def with_spans(docs: DataFrame, keep: dict[str, Column], size: int = SIZE, text_of_all: bool = False, crowd: int = CROWD) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, its text as bytes, ``spans``: what of it is repeated, and ``shared``.

    spans: array of (start, end) in bytes, unordered and overlapping, null where
    there is none. shared: how many anchors of its windows also occur elsewhere.
    Text is null for rows without such anchors unless ``text_of_all``. Rows of
    equal text are equal places: each row counts, and all get the same spans.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(*(c.alias(f"_{n}") for n, c in keep.items()), *_two_hashes(text), F.xxhash64("doc_id").alias("k"), text.alias("text"))
    with batches_of(spark):
        occ = saved(_stretches(rows, size), "stretches")
    total = occ.count()
    often = saved(occ.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1").select("anchor", "rows"), "anchors")
    again = saved(hot_join(occ, often, ["anchor"], "rows", total).drop("rows"), "again")
    place = F.struct("t1", "t2", "k", F.col("los")[0].alias("lo"), "w", "off")
    kinds = saved(again.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(place).alias("at")), "kinds")
    many = saved(kinds.groupBy("anchor").agg(F.count("*").alias("many")), "many")
    rep = F.struct(F.col("anchor").alias("g"), F.col("digest").alias("d"), F.least("n", F.lit(2)).cast("int").alias("n"), "many", "at.lo", "at.w", "at.off")
    reps = kinds.join(many, "anchor").groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(F.min("at.k").alias("rk"), F.collect_list(rep).alias("reps"))
    shared = again.groupBy("t1", "t2", "anchor").agg(F.lit(1).alias("one")).groupBy("t1", "t2").agg(F.count("*").alias("shared"))
    joined = rows.join(shared.join(reps, ["t1", "t2"], "left"), ["t1", "t2"], "left").withColumn("reps", F.when(F.col("k") == F.col("rk"), F.col("reps"))).drop("k", "rk")
    if not text_of_all:
        joined = joined.withColumn("text", F.when(F.col("shared").isNotNull(), F.col("text")))
    joined = saved(joined, "candidates")
    with batches_of(spark):
        strings = saved(_strings(joined, size), "strings")
        marks = saved(_decided(strings, size, crowd), "marks")
    marks = marks.select(F.col("g").alias("anchor"), F.col("d").alias("digest"), "marks")
    told = saved(marks.join(kinds.select("anchor", "digest", "rows"), ["anchor", "digest"]), "told")
    hit = hot_join(again.select("t1", "t2", "anchor", "digest", "los"), told, ["anchor", "digest"], "rows", again.count())
    each = F.flatten(F.transform("los", lambda lo: F.transform("marks", lambda m: F.struct((lo + m["first"]).alias("start"), (lo + m["last"] + size).alias("end")))))
    spans = saved(hit.select("t1", "t2", each.alias("s")).groupBy("t1", "t2").agg(F.flatten(F.collect_set("s")).cast(_SPANS).alias("spans")), "spans")
    names = [F.col(f"_{n}").alias(n) for n in keep]
    some = joined.filter("shared IS NOT NULL").join(spans, ["t1", "t2"], "left").select(*names, "text", "spans", "shared")
    return some.unionByName(joined.filter("shared IS NULL").select(*names, "text", F.lit(None).cast(_SPANS).alias("spans"), F.lit(0).cast("long").alias("shared")))


def _two_hashes(text: Column) -> list[Column]:
    """t1, t2: what stands for a text, 128 bits of two hashes."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by ``spans``."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without ``runs``."""
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    return b"".join((*kept, text[at:]))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with repeated stretches taken out of their texts; texts that lose all stay, empty.

    What is left of a character cut in two is dropped; n_chars, where there is
    one, is counted again. Null texts stay null.
    """
    rest = [n for n in docs.columns if n != "text"]
    row = F.struct(F.col("text").isNull().alias("null"), *(F.col(n).alias(f"c{i}") for i, n in enumerate(rest)))
    found = with_spans(docs, {"row": row}, size, text_of_all=True)  # a struct: no name of ``docs`` meets one of ours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in pieces_of(whole, "text", 4 << 20)):
            texts = [cut(t, merged(s)).decode("utf-8", "ignore") for t, s in zip(utf8(b.column("text")), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([True] * len(texts))], ["row", "text", "changed"])

    plain = found.filter("spans IS NULL").select("row", F.col("text").cast("string").alias("text"), F.lit(False).alias("changed"))
    cut_ = found.filter("spans IS NOT NULL").select("row", "text", "spans").mapInArrow(thrifty(run), plain.schema)
    both = plain.unionByName(cut_)
    columns = {n: F.col(f"row.c{i}") for i, n in enumerate(rest)} | {"text": F.when(~F.col("row.null"), F.col("text"))}
    if "n_chars" in rest:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("changed"), count).otherwise(columns["n_chars"])
    return both.select(*(columns[n].alias(n) for n in docs.columns))


def op3(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared for every row of ``documents``.

    A null text is empty. Rows that are repeated as they stand count as two
    places. Texts shorter than 400 bytes hold nothing repeated. n_shared takes
    part in no other column: it counts the anchors of the text, strings of 64
    bytes that its own windows choose, that also occur elsewhere, so it also
    tells of shared passages that are shorter than 400 bytes.
    """
    text = F.coalesce("text", F.lit(""))
    keep = {"doc_id": F.col("doc_id"), "n_bytes": F.octet_length(text).cast("long"), "sha": F.sha2(text, 256)}
    found = with_spans(documents.select("doc_id", "text"), keep, crowd=crowd)
    schema = documents.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("n_shared", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in batches for b in pieces_of(whole, "text", 4 << 20)):
            runs = [merged(s) for s in b.column("spans").to_pylist()]
            kept = [hashlib.sha256(cut(t, r)).hexdigest() for t, r in zip(utf8(b.column("text")), runs, strict=True)]
            gone = pa.array([sum(e - s for s, e in r) for r in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), gone, pa.array([len(r) for r in runs], pa.int64()), pa.array(kept, pa.string()), b.column("shared")], schema.names)

    changed = found.filter("spans IS NOT NULL").select("doc_id", "n_bytes", "text", "spans", "shared").mapInArrow(thrifty(run), schema)
    zero = F.lit(0).cast("long")
    plain = found.filter("spans IS NULL").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), F.col("shared").alias("n_shared"))
    return plain.unionByName(changed)
