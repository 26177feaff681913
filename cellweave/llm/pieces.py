"""SentencePiece encoding and decoding by suffix-array matching.

Two neighbouring characters that stand side by side in no piece can never be
in one symbol, so a text is cut there into independent units, and each distinct
unit is encoded once. The units of a batch are concatenated and their suffixes sorted; every
piece is searched in the suffix array for the range of its occurrences; the
occurrences are edges (start, length, score), sorted by position. Relaxing
them in order of score gives the encoding: an edge joins two neighbouring
symbols when it covers exactly them, best score first, leftmost of equals.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces_of, thrifty

MODEL = "piece_bpe_32k.model"
MARK = "\u2581"
_FAR = np.int64(1) << 40


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class SuffixArray:
    """Suffixes of ``codes`` (0 ends a unit) in the order of their first ``depth`` codes."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.codes, self.depth = codes, depth
        rank, span = codes.astype(np.uint64), 1
        while True:
            ahead = np.zeros(len(codes), dtype=np.uint64)
            ahead[: max(len(codes) - span, 0)] = rank[span:]
            key = (rank << np.uint64(32)) | ahead
            self.order = np.argsort(key)
            span *= 2
            if span >= depth:
                break
            ordered = key[self.order]
            rank = np.zeros(len(codes), dtype=np.uint64)
            rank[self.order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1]))).astype(np.uint64)

    def search(self, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last row of the suffixes that start with each piece; pieces are rows of codes, 0 after their ends."""
        padded = np.concatenate((self.codes, np.zeros(self.depth, self.codes.dtype)))
        n, width = len(self.codes), pieces.shape[1]
        inside = np.arange(width)[None, :] < sizes[:, None]

        def bound(past: bool) -> np.ndarray:
            lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = self.order[np.minimum(mid, n - 1)]
                diff = np.where(inside, padded[at[:, None] + np.arange(width)].astype(np.int64) - pieces, 0)
                first = (diff != 0).argmax(axis=1)
                sign = np.sign(diff[np.arange(len(diff)), first])
                less = (sign < 0) | (past & (sign == 0))
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        return bound(False), bound(True)


class PieceModel:
    """The pieces of a model file, and the ids of units met so far."""

    KEPT = 250_000
    LONG = 400

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, np.uint32)
        names, ids, scores = [], [], []
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" \u2047 ".encode())
            else:
                self.bytes_of.append(name.replace(MARK, " ").encode())
                names.append(name)
                ids.append(i)
                scores.append(sp.get_score(i))
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted(set("".join(names))))}
        self.depth = max(map(len, names))
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.pieces = np.zeros((len(names), self.depth), np.int64)
        for k, x in enumerate(names):
            self.pieces[k, : len(x)] = [self.alphabet[c] for c in x]
        self.ids = np.array(ids, np.int64)
        # place of each piece in the order of scores, best first
        self.place = np.zeros(len(names), np.int64)
        self.place[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(names))
        self.id_at = np.zeros(len(names), np.int64)
        self.id_at[self.place] = self.ids
        self.code_of = np.zeros(0x110000, np.uint32)
        for c, k in self.alphabet.items():
            self.code_of[ord(c)] = k
        many = len(self.alphabet) + 1
        self.beside = np.zeros(many * many, bool)
        for x in names:
            for a, b in zip(x, x[1:], strict=False):
                self.beside[self.alphabet[a] * many + self.alphabet[b]] = True
        lens = np.array([len(x) for x in self.bytes_of], np.int64)
        self.text_starts = np.concatenate(([0], np.cumsum(lens)))
        self.text_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.joined = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys start * 64 + length of every occurrence of every piece, and its place in the order of scores."""
        sa = SuffixArray(codes, self.depth)
        lo, hi = sa.search(self.pieces, self.sizes)
        many = hi - lo
        which = np.repeat(np.arange(len(many)), many)
        row = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        key = sa.order[row] * 64 + self.sizes[which]
        order = np.argsort(key)
        return key[order], self.place[which[order]]

    def relax(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each unit)."""
        points = np.frombuffer("\0".join(units).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
        sizes = np.array([len(u) for u in units], np.int64)
        codes = self.code_of[points]
        ends = np.cumsum(sizes + 1)
        first = ends - sizes - 1
        inside = np.ones(len(points), bool)
        inside[ends - 1] = False
        codes = np.where(inside, codes + np.uint32(1), 0).astype(np.uint32)  # 1: in no piece
        keys, places = self.edges(np.where(codes > 1, codes - 1, np.where(codes == 1, np.uint32(len(self.alphabet) + 1), 0)))

        def look(start: np.ndarray, length: np.ndarray) -> np.ndarray:
            key = np.where(length <= self.depth, start * 64 + np.minimum(length, 63), -1)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            return np.where(keys[at] == key, places[at], _FAR) if len(keys) else np.full(len(key), _FAR)

        long = np.flatnonzero(sizes > self.LONG)
        head = inside.copy()  # True where a symbol starts
        for u in long:
            self._relax_one(int(first[u]), int(sizes[u]), head, look)
        unit = np.repeat(np.arange(len(units)), sizes)
        start = np.flatnonzero(inside)
        alive = sizes[unit] <= self.LONG
        unit, start = unit[alive], start[alive]
        stop = start + 1
        if len(start):
            pair = np.full(len(start), _FAR)
            same = np.flatnonzero(unit[1:] == unit[:-1])
            pair[same] = look(start[same], stop[same + 1] - start[same])
            while len(start):
                border = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
                best = np.minimum.reduceat(pair * (1 << 22) + np.arange(len(pair)), border)
                going = best >> 22 < _FAR
                if not going.any():
                    break
                at = best[going] & ((1 << 22) - 1)
                head[start[at + 1]] = False
                stop[at] = stop[at + 1]
                keep = np.repeat(going, np.diff(np.append(border, len(start))))
                keep[at + 1] = False
                moved = np.cumsum(keep) - 1
                unit, start, stop, pair = unit[keep], start[keep], stop[keep], pair[keep]
                at = moved[at]
                touched = np.concatenate((at, at[at > 0] - 1))
                touched = touched[touched + 1 < len(start)]
                own = unit[touched] == unit[touched + 1]
                pair[at] = _FAR
                touched = touched[own]
                pair[touched] = look(start[touched], stop[touched + 1] - start[touched])
        begin = np.flatnonzero(head)
        end = np.append(begin[1:], len(points))
        # a symbol ends where the next starts, or at its unit's end
        of = np.searchsorted(ends, begin, side="right")
        end = np.minimum(end, ends[of] - 1)
        found = look(begin, end - begin)
        known = found < _FAR
        width = np.ones(len(begin), np.int64)
        odd = np.flatnonzero(~known)
        raw = [chr(points[p]).encode() for p in begin[odd]]
        width[odd] = [len(x) for x in raw]
        out = np.zeros(int(width.sum()), np.uint32)
        to = np.cumsum(width) - width
        out[to[known]] = self.id_at[found[known]]
        for p, x in zip(to[odd].tolist(), raw, strict=True):
            out[p : p + len(x)] = self.byte_ids[list(x)]
        return out, np.bincount(of, weights=width, minlength=len(units)).astype(np.int64)

    @staticmethod
    def _relax_one(first: int, size: int, head: np.ndarray, look) -> None:
        """One long unit, by a queue of the edges that join two symbols."""
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        stop = list(range(1, size + 1))
        p = np.arange(first, first + size - 1)
        queue = [(int(r), i, i + 2) for i, r in enumerate(look(p, np.full(len(p), 2))) if r < _FAR]
        heapq.heapify(queue)
        gone = bytearray(size)
        while queue:
            _, i, e = heapq.heappop(queue)
            if gone[i] or right[i] >= size or stop[right[i]] != e:
                continue
            j = right[i]
            gone[j] = 1
            head[first + j] = False
            stop[i], right[i] = e, right[j]
            if right[i] < size:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < size:
                    z = stop[right[a]]
                    r = int(look(np.array([first + a]), np.array([z - a]))[0])
                    if r < _FAR:
                        heapq.heappush(queue, (r, a, z))

    def learn(self, units: list[str]) -> None:
        for k in range(0, len(units), 60_000):
            part = units[k : k + 60_000]
            while sum(map(len, part)) > 2_000_000 and len(part) > 1:  # places of symbols fit 22 bits
                self.learn(part[: len(part) // 2])
                part = part[len(part) // 2 :]
            flat, sizes = self.relax(part)
            n, at = len(self.known), int(self.starts[len(self.known)])
            ends = at + np.cumsum(sizes)
            while len(self.joined) < ends[-1]:
                self.joined = np.concatenate((self.joined, np.zeros_like(self.joined)))
            while len(self.starts) < n + len(part) + 1:
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            self.joined[at : ends[-1]] = flat
            self.starts[n + 1 : n + len(part) + 1] = ends
            self.known.update(zip(part, range(n, n + len(part)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every whole text."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(marked)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = self.code_of[points].astype(np.int64)
        edge = np.concatenate(([0], np.cumsum([len(t) for t in marked])))
        new = np.ones(len(points), bool)
        new[1:] = ~self.beside[codes[:-1] * (len(self.alphabet) + 1) + codes[1:]]
        new[edge[:-1][np.diff(edge) > 0]] = True
        first = np.flatnonzero(new)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        places = np.concatenate(([0], np.cumsum(width)))
        offsets = np.append(places[first], places[-1])
        units = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined.encode()))
        coded = units.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) + len(names) > self.KEPT:
            self.clear()
        fresh = [u for u in names if u not in self.known]
        if fresh:
            self.learn(fresh)
        at = np.array([self.known[u] for u in names], np.int64)[coded.indices.to_numpy()]
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        flat = self.joined[np.repeat(self.starts[at] - (ends - size), size) + np.arange(int(ends[-1]))]
        cut = np.concatenate(([0], ends))[np.searchsorted(first, edge)]
        return [flat[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        ids = ids.astype(np.int64)
        size = self.text_starts[ids + 1] - self.text_starts[ids]
        ends = np.cumsum(size)
        flat = self.text_flat[np.repeat(self.text_starts[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return flat.tobytes().decode("utf-8", "replace").removeprefix(" ")


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of this process for a file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of ids of the whole text) of every row; null and empty texts have none."""
    path = path or model_path()
    schema = docs.select(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole, "text", 4 << 20):
                ids = piece_model(path).encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, "text").mapInArrow(thrifty(run), f"{key} {schema.dtypes[0][1]}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every row of ids; null ids give an empty text."""
    path = path or model_path()
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [piece_model(path).decode(np.asarray(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(thrifty(run), f"{key} {kind}, text string")


def op2(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, round_trip for every row of ``documents``.

    Every whole text is encoded, and its ids are decoded again. A null text is
    an empty one, without ids. A text that holds the word mark itself reads as
    having a space there, and does not make the round trip.
    """
    path = path or model_path()
    schema = documents.select("doc_id").schema.add("n_ids", "long").add("ids_crc32", "long").add("decoded_sha256", "string").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for whole in batches:
            for b in pieces_of(whole, "text", 4 << 20):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = model.encode(texts)
                back = [model.decode(x) for x in ids]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([t == x for t, x in zip(texts, back, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], schema.names)

    return documents.select("doc_id", "text").mapInArrow(thrifty(run), schema)
