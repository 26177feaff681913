"""Hashed word n-grams of whole texts, and a logistic model trained by FTRL.

Hashing works on one byte buffer for many texts: word hashes are differences of
a running polynomial sum, so the cost is a few vector operations a byte and
there is no Python step for a word.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, pieces_of, thrifty, utf8

BITS = 24
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, modulo 2**64."""
    if len(_tables.get(base, ())) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        _tables[base] = np.cumprod(full)
    return _tables[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``codes[start:end]`` for every span."""
    n = len(codes)
    pw, back = powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


@dataclass(frozen=True)
class Words:
    """How a text is cut into tokens.

    kinds: for each byte 0 (separates), or the class of bytes that stay
    together in a token. fold: the byte that stands for each byte.
    again: a token equal to the one before it is read as one special token, so
    that repetition of any word is one feature.
    """

    kinds: np.ndarray
    fold: np.ndarray
    again: bool = False


def _kinds(symbols: bool) -> np.ndarray:
    kinds = np.zeros(256, dtype=np.int8)
    kinds[128:] = 1
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        kinds[lo:hi] = 1
    if symbols:
        for i in range(33, 127):
            if not kinds[i]:
                kinds[i] = 2
    return kinds


LOWER_WORDS = Words(_kinds(False), _fold())
WORDS_AND_SYMBOLS = Words(_kinds(True), np.arange(256, dtype=np.uint8), again=True)


def token_hashes(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every token, in order."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kinds = words.kinds[joined]
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(joined)]))
    keep = kinds[starts] > 0
    starts, ends = starts[keep], ends[keep]
    h = span_hashes(words.fold[joined], starts, ends)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    of = np.searchsorted(firsts, starts, side="right") - 1
    if words.again and len(h) > 1:
        # symbols between two words do not hide that the words are equal
        word = np.flatnonzero(kinds[starts] == 1)
        same = np.zeros(len(h), dtype=bool)
        same[word[1:]] = (h[word[1:]] == h[word[:-1]]) & (of[word[1:]] == of[word[:-1]])
        h = np.where(same, np.uint64(0xA6A1), h)
    return of, h


def features(texts: list[bytes], words: Words, shape: str) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, feature of BITS bits), each feature once a text.

    shape: "ngrams" for 1- to 3-grams; "skipgrams" for 1- and 2-grams and pairs
    with one word between.
    """
    of, h = token_hashes(texts, words)
    steps = [(0, None, None)]
    steps += [(1, 1, None), (2, 2, None)] if shape == "skipgrams" else [(1, 1, None), (3, 1, 2)]
    docs, ids = [], []
    for kind, one, two in steps:
        far = max(one or 0, two or 0)
        n = len(h) - far
        if n <= 0:
            continue
        x = h[:n] * np.uint64(2 * kind + 1)
        for k, step in enumerate((one, two)):
            if step:
                x = mix(x) + h[step : step + n] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * k)
        same = of[:n] == of[far : far + n]
        ids.append((mix(x + np.uint64(kind)) >> np.uint64(64 - BITS))[same])
        docs.append(of[:n][same])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(ids).astype(np.int64)


def once(docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted."""
    both = np.unique((docs.astype(np.int64) << BITS) | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Ftrl:
    """Parameters of FTRL-proximal: w = -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2)."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 10
    least_docs: int = 4


def train(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, feature ids (sorted) and weights that are not zero.

    Each coordinate has its own rate, from its own sum of squared gradients. A
    feature of fewer than ``least_docs`` texts is left out. The bias is a
    coordinate without L1.
    """
    if not rows:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, counts = np.unique(flat, return_counts=True)
    ids = ids[counts >= p.least_docs]
    compact = []
    for r in rows:
        at = np.searchsorted(ids, r)
        at[at == len(ids)] = 0
        compact.append((at[ids[at] == r] if len(ids) else at[:0]).astype(np.int32))
    z, n = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    bias = len(ids)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == bias, 0.0, p.l1)
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for epoch in range(p.epochs):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for i in order:
            at = np.append(compact[i], bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / p.alpha * w
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[:-1])
    return float(w[-1]), ids[kept].astype(np.int64), w[:-1][kept]


@dataclass
class Model:
    """A sparse linear model over hashed features; what executors receive."""

    words: Words
    shape: str
    bias: float = 0.0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    _known: np.ndarray | None = field(default=None, repr=False, compare=False)  # made once a worker

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for every whole text."""
        total = np.full(len(texts), self.bias)
        if len(self.ids):
            docs, ids = features(texts, self.words, self.shape)
            if self._known is None:
                self._known = np.zeros(1 << BITS, dtype=bool)
                self._known[self.ids] = True
            hit = self._known[ids]
            docs, ids = once(docs[hit], ids[hit])
            np.add.at(total, docs, self.weights[np.searchsorted(self.ids, ids)])
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable,
    words: Words,
    shape: str,
    per_class: int,
    params: Ftrl,
) -> Model:
    """Train on at most ``per_class`` labelled rows of each class.

    docs: doc_id, text. labels: doc_id and the 0/1 column ``label``; null labels
    are passed over and a document with several labels has their majority (a
    tie counts as 1). usable: predicate on doc_id of rows that may be learned
    from. The rows taken are those of smallest hash of doc_id; their features
    are made where the texts are, and one task trains on that bounded sample:
    it holds four bytes for each distinct feature of each text, about three
    times its words.
    """
    one = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .filter(usable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    key = (F.xxhash64("doc_id"), F.col("doc_id"))
    taken = one.filter("y = 0").orderBy(*key).limit(per_class).unionByName(one.filter("y = 1").orderBy(*key).limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("doc_id", "y", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole, "text", 1 << 20):
                texts = utf8(b.column("text"))
                of, ids = once(*features(texts, words, shape))
                cut = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), lists], ["doc_id", "y", "ids"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ys, lists = [], [], []
        for b in batches:
            keys += b.column("doc_id").to_pylist()
            ys += b.column("y").to_pylist()
            at, flat = b.column("ids").offsets.to_numpy(), b.column("ids").values.to_numpy()
            lists += [flat[s:e].copy() for s, e in itertools.pairwise(at)]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], len(lists[i]), zlib.crc32(lists[i])))
        bias, ids, w = train([lists[i] for i in order], np.array([ys[i] for i in order], dtype=float), params)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(w, bias))], ["id", "w"])

    made = rows.mapInArrow(thrifty(make), "doc_id long, y int, ids array<int>")
    with batches_of(docs.sparkSession):
        learned = made.repartition(1).mapInArrow(thrifty(learn), "id long, w double").toPandas().sort_values("id")
    if learned.empty:
        return Model(words, shape)
    bias = float(learned.w[learned.id < 0].iloc[0])
    own = learned[learned.id >= 0]
    return Model(words, shape, bias, own.id.to_numpy(np.int64), own.w.to_numpy(float))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` (with a column text) and a column ``out``: scores of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(out).schema.add(out, "double")
    names = [n for n in docs.columns if n != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces_of(whole, "text", 1 << 20):
                s = sent.value.scores(utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s)], [*names, out])

    return docs.select(*names).mapInArrow(thrifty(run), schema)
