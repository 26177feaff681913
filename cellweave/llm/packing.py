"""Packing of tokenised documents into sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the multiset of all lengths is
one count a length: a table of bounded size, whatever the corpus. The plan is
made on these counts. Large lengths are sorted, cut into groups of equal
cardinality and rounded up to the largest of their group; a linear programme
over configurations of the few rounded sizes says how often each configuration
is used; actual lengths take the places of their group; what the rounding down
of the programme leaves, and all small lengths, go by best fit, largest first.
Bins of equal contents are kept as one entry with a multiplicity, so the plan
too has a bounded number of rows. Documents then take the places of their
length by rank, which windows over (length, bucket) count in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, pieces_of, saved, thrifty

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0


class WordEncoder:
    """Token ids of whole texts, each distinct word encoded once.

    The tokenizer drops white space, lower-cases, and starts a new unit where
    punctuation follows a letter, so the ids of a text are those of its words,
    one after another. Texts with ``<|`` may hold strings of special tokens,
    which do not keep to words; they are encoded whole.
    """

    KEPT = 200_000
    AT_ONCE = 16_384

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.joined = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    def keep(self, words: list[str]) -> None:
        """Encode ``words`` and append their ids to what is known."""
        plain = [w for w in words if w.isalpha() and w.islower() and max(w) < "\u0250"]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)], add_special_tokens=False)]
        many = np.fromiter(chain.from_iterable(lists), np.uint32)
        # a word of Latin letters alone is one unit, whose last id is the only one that ends a word
        sizes = np.diff(np.flatnonzero(self.last[many]), prepend=-1)
        rest = [w for w in words if not (w.isalpha() and w.islower() and max(w) < "\u0250")]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        words = plain + rest
        n, first = len(self.known), int(self.starts[len(self.known)])
        ends = first + np.cumsum(np.concatenate((sizes, [len(x) for x in encoded])).astype(np.int64))
        while len(self.joined) < ends[-1]:
            self.joined = np.concatenate((self.joined, np.zeros_like(self.joined)))
        while len(self.starts) < n + len(words) + 1:
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.joined[first : ends[-1]] = np.concatenate((many, np.fromiter(chain.from_iterable(encoded), np.uint32)))
        self.starts[n + 1 : n + len(words) + 1] = ends
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        # a copy: some kernels misread an array that is a slice of a larger one
        texts = pa.array([x or "" for x in texts.to_pylist()], pa.large_string())
        odd = set(np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist())
        plain = pc.if_else(pc.match_substring(texts, "<|"), "", texts) if odd else texts
        spaced = pc.replace_substring_regex(pc.ascii_lower(plain), r"(\pL)([.,;:!?%$#&*|])", r"\1 \2")
        words = pc.ascii_split_whitespace(spaced)
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > self.KEPT:
            self.clear()
        fresh = [w for w in names if w and w not in self.known]
        for k in range(0, len(fresh), self.AT_ONCE):  # encodings are many times larger than their ids
            self.keep(fresh[k : k + self.AT_ONCE])
        lookup = np.array([self.known.get(w, -1) for w in names], dtype=np.int64)
        at = lookup[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        size = np.where(at >= 0, self.starts[at + 1] - self.starts[at], 0) if len(at) else at
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.starts[at] - (ends - size), size) + np.arange(total) if total else np.zeros(0, np.int64)
        flat = self.joined[source] if total else np.zeros(0, np.uint32)
        edge = np.concatenate(([0], ends))[offsets - offsets[0]]
        found = [flat[edge[i] : edge[i + 1]] for i in range(len(texts))]
        for i, ids in zip(sorted(odd), self.whole([texts[i].as_py() for i in sorted(odd)]), strict=True):
            found[i] = ids
        return found


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every document.

    A document is the ids of its whole text (null: empty) and one end id; it is
    cut only where it is longer than ``capacity``.
    """
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in pieces_of(whole, "text", 4 << 20):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, x in enumerate(enc.encode(b.column("text"))):
                    x = np.append(x, np.uint32(END)).astype("<u4")
                    for k, s in enumerate(range(0, len(x), capacity)):
                        part = x[s : s + capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int32))
                made = [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(made, schema.names)

    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)


@dataclass
class Bins:
    """``n`` bins of equal contents; a run (length, first rank, copies a bin) for each length in them."""

    n: int
    runs: list[tuple[int, int, int]]
    room: int

    def split(self, n: int) -> tuple[Bins, Bins]:
        head = Bins(n, list(self.runs), self.room)
        tail = Bins(self.n - n, [(size, rank + n * q, q) for size, rank, q in self.runs], self.room)
        return head, tail


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of ``sizes`` and how often to use each, from a linear programme rounded down.

    Column generation: the duals of the current basis price the sizes, a
    knapsack over them finds the configuration to bring in, until none pays.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        used = inverse @ demand
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        picks = []
        for _ in range(most):
            options = np.full((k, capacity + 1), -1.0)
            for g, s in enumerate(sizes):
                options[g, s:] = best[: capacity + 1 - s] + price[g]
            pick = options.argmax(axis=0)
            value = options[pick, np.arange(capacity + 1)]
            pick[value <= best + 1e-12] = -1
            picks.append(pick)
            best = np.maximum(best, value)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= sizes[pick[c]]
        along = inverse @ column
        ratio = np.where(along > 1e-9, np.maximum(used, 0) / np.where(along > 1e-9, along, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    used = np.linalg.inv(basis) @ demand
    return [(basis[:, p].astype(np.int64), int(np.floor(used[p] + 1e-6))) for p in range(k)]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 24, small: int | None = None) -> list[Bins]:
    """Bins for ``counts[length]`` items of each length from 1 to ``capacity``.

    groups: rounded sizes of the linear programme. small: lengths up to this
    are left to best fit (an eighth of the capacity).
    """
    small = capacity // 8 if small is None else small
    left = counts.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, dtype=np.int64)
    bins: list[Bins] = []
    if left[capacity]:
        bins.append(Bins(int(left[capacity]), [(capacity, 0, 1)], 0))
        left[capacity] = 0
    large = [(size, int(left[size])) for size in range(capacity - 1, small, -1) if left[size]]
    total = sum(n for _, n in large)
    if total:
        share = -(-total // groups)
        members: list[list[list[int]]] = [[]]
        room = share
        for size, n in large:
            while n:
                if not room:
                    members.append([])
                    room = share
                take = min(n, room)
                members[-1].append([size, take])
                n, room = n - take, room - take
        # groups that round to one size are one group
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged), dtype=np.int64)
        queues = [list(m) for m in merged.values()]
        demand = np.array([sum(n for _, n in m) for m in queues], dtype=np.int64)
        for counts_of, n in configurations(sizes, demand.astype(float), capacity):
            for g in np.flatnonzero(counts_of):
                n = min(n, int(demand[g] // counts_of[g]))
            if n <= 0:
                continue
            slots: list[list[list[int]]] = []
            for g in np.flatnonzero(counts_of):
                demand[g] -= n * counts_of[g]
                for _ in range(int(counts_of[g])):
                    slot, need = [], n
                    while need:
                        head = queues[g][0]
                        take = min(need, head[1])
                        slot.append([head[0], take])
                        head[1] -= take
                        need -= take
                        if not head[1]:
                            queues[g].pop(0)
                    slots.append(slot)
            while slots[0]:
                m = min(s[0][1] for s in slots)
                held: dict[int, int] = {}
                for s in slots:
                    held[s[0][0]] = held.get(s[0][0], 0) + 1
                    s[0][1] -= m
                    if not s[0][1]:
                        s.pop(0)
                runs = []
                for size, q in held.items():
                    runs.append((size, int(rank[size]), q))
                    rank[size] += m * q
                    left[size] -= m * q
                bins.append(Bins(m, runs, capacity - sum(size * q for size, q in held.items())))
    rooms: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        rooms[b.room].append(b)
    open_ = np.array([bool(r) for r in rooms])

    def put(b: Bins, size: int, q: int) -> None:
        b.runs.append((size, int(rank[size]), q))
        rank[size] += b.n * q
        left[size] -= b.n * q
        b.room -= size * q
        rooms[b.room].append(b)
        open_[b.room] = True

    for size in range(capacity - 1, 0, -1):
        while left[size]:
            fits = np.flatnonzero(open_[size:])
            if len(fits):
                room = size + int(fits[0])
                b = rooms[room].pop()
                open_[room] = bool(rooms[room])
            else:
                b = Bins(-(-int(left[size]) // (capacity // size)), [], capacity)
            q = min(b.room // size, int(left[size]))
            n = min(b.n, int(left[size]) // q)
            head, tail = b.split(n)
            if tail.n and b.runs:
                rooms[b.room].append(tail)
                open_[b.room] = True
            elif tail.n:  # bins just opened: the last one takes what is left
                put(head, size, q)
                put(Bins(1, [], capacity), size, int(left[size]))
                continue
            put(head, size, q)
    return [b for r in rooms for b in r]


def places(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first sequence, copies a bin, offset of the first copy)."""
    rows, base = [], 0
    for b in bins:
        at = 0
        for size, first, q in b.runs:
            rows.append((size, first, b.n * q, base, q, at))
            at += size * q
        base += b.n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a saved table with doc_id, piece, length, ids_crc32) with sequence_id and offset.

    Each sequence holds ``capacity`` tokens at most, from offset 0 without
    gaps. Repeated rows are separate pieces.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    rows = places(plan(counts, capacity))
    slots = spark.createDataFrame(rows, "length long, first long, items long, base long, copies long, at long")
    buckets = int(min(1 << 16, max(1, counts.sum() // 256)))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ahead = saved(sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")), "ranks")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("_k", F.row_number().over(order) - 1).join(ahead, ["length", "_bucket"])
    rank = F.col("_before") + F.col("_k")
    ranked = ranked.withColumn("_rank", rank).drop("_before", "_k", "_bucket").alias("p")
    s = F.broadcast(slots).alias("s")  # rows are bounded by the capacity, not by the corpus
    on = (F.col("p.length") == F.col("s.length")) & (F.col("_rank") >= F.col("s.first")) & (F.col("_rank") < F.col("s.first") + F.col("s.items"))
    within = F.col("_rank") - F.col("s.first")
    return ranked.join(s, on).select(
        *(F.col(f"p.{c}") for c in pieces.columns),
        (F.col("s.base") + F.expr("(_rank - s.first) div s.copies")).alias("sequence_id"),
        (F.col("s.at") + (within % F.col("s.copies")) * F.col("p.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    path: a tokenizer file that drivers and executors have. with_ids: carry the
    ids of the pieces too. A null or empty text is one piece of one end id; a
    null doc_id is a document like any other. An empty table gives no rows.
    """
    with batches_of(docs.sparkSession):
        made = saved(token_pieces(docs, path or tokenizer_path(), capacity, with_ids), "pieces")
    return pack(made, capacity)


def op5(documents: DataFrame) -> DataFrame:
    """The digest columns of packing ``documents`` into sequences of 2048 tokens."""
    return pack_documents(documents).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
