"""Toxicity and quality: hashing, training, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from cellweave.llm import hashed, quality, toxicity


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        bad = i % 4 == 0
        if bad:
            for w in ("grumph", "snarkle", "blorg"):
                text.insert(rng.randint(0, len(text)), w)
        junk = i % 5 == 0
        if junk:
            text = [w + "%%%" for w in text] if i % 2 else [w for w in text for _ in range(4)]
        docs.append((i, " ".join(text), "en", "s", len(text)))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("op", "label", "share"), [(toxicity.op1, 2, 3), (quality.op10, 1, 5)])
def test_held_out(spark, op, label, share):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    rows = op(d, lab).collect()
    truth = {x[0]: x[label] for x in labels}
    assert len(rows) == len(docs)
    right = 1 if share == 3 else 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % share == right) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if share == 3 else 0.3)) for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a = {r.doc_id: r.score for r in toxicity.op1(*frames(spark, docs, labels)).collect()}
    b = {r.doc_id: r.score for r in toxicity.op1(*frames(spark, docs, flipped)).collect()}
    assert a == b


@pytest.mark.parametrize("op", [toxicity.op1, quality.op10])
def test_edges(spark, op):
    docs = [(1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "word " * 40000, "en", "s", 0), (3, "\x00é😀", "en", "s", 3)]
    d, lab = frames(spark, docs, [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)])
    rows = op(d.withColumnRenamed("lang", "score").withColumnRenamed("source", "predicted"), lab).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert op(d.limit(0), lab).isEmpty()
    assert {r.score for r in op(d, lab.limit(0)).collect()} == {0.5}


def test_features_match_a_plain_reading():
    texts = [b"The cat, the CAT sat", b"", b"cat sat", b"one"]
    of, h = hashed.token_hashes(texts, hashed.LOWER_WORDS)
    assert of.tolist() == [0] * 5 + [2, 2, 3]
    assert h[0] == h[2] and h[1] == h[3] == h[5] and h[4] == h[6] and len(set(h.tolist())) == 4
    docs, ids = hashed.features(texts, hashed.LOWER_WORDS, "skipgrams")
    assert np.bincount(docs, minlength=4).tolist() == [5 + 4 + 3, 0, 2 + 1, 1]
    a = {(d, i) for d, i in zip(docs, ids, strict=True)}
    alone = [{(n, i) for i in hashed.features([t], hashed.LOWER_WORDS, "skipgrams")[1]} for n, t in enumerate(texts)]
    assert a == set().union(*alone)  # batches do not matter
    of, h = hashed.token_hashes([b"er er er!! er"], hashed.WORDS_AND_SYMBOLS)
    assert h[1] == h[2] == h[4] != h[0]


def test_training_is_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(0, 5000, 50), [9000] if i % 2 else [])).astype(np.int64) for i in range(400)]
    bias, ids, w = hashed.train(rows, np.array([i % 2 for i in range(400)], float), hashed.Ftrl())
    assert 9000 in ids and w[ids.tolist().index(9000)] > 1 and len(ids) < 500
    assert hashed.train([], np.zeros(0), hashed.Ftrl())[0] == 0.0


def plain_ftrl(rows, labels, p):
    """Coordinate by coordinate, with dictionaries."""
    count = {}
    for r in rows:
        for f in r.tolist():
            count[f] = count.get(f, 0) + 1
    z, n = {}, {}

    def weight(f):
        l1 = 0.0 if f == "bias" else p.l1
        zi = z.get(f, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((p.beta + math.sqrt(n.get(f, 0.0))) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            own = [f for f in rows[i].tolist() if count[f] >= p.least_docs] + ["bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - labels[i]
            for f in own:
                before = n.get(f, 0.0)
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / p.alpha * w[f]
    return weight("bias"), {f: weight(f) for f in z if f != "bias" and weight(f)}


@pytest.mark.parametrize("p", [hashed.Ftrl(), hashed.Ftrl(alpha=0.3, beta=2.0, l1=0.5, l2=0.1, epochs=3, least_docs=2)])
def test_training_against_a_plain_loop(p):
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.zipf(1.4, rng.integers(1, 40)).clip(0, 4000)).astype(np.int64) for _ in range(150)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    bias, ids, w = hashed.train(rows, labels, p)
    exp_bias, exp = plain_ftrl(rows, labels, p)
    assert abs(bias - exp_bias) < 1e-9 and dict(zip(ids.tolist(), w.tolist(), strict=True)).keys() == exp.keys()
    assert all(abs(w[i] - exp[f]) < 1e-9 for i, f in enumerate(ids.tolist())) and exp
