"""Embeddings against brute force, the pipeline against its stages, and the registry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import components, embeddings, packing, queries, quality
from cellweave.llm.common import saved


def brute(ids, v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(near, root[None, :], max(ids) + 1).min(axis=1))
        if (new == root).all():
            return {i: (int(n), int(r), i == r) for i, n, r in zip(ids, near.sum(1), root, strict=True)}
        root = new


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 32))
    v = np.concatenate([rng.standard_normal((60, 32)), *(c + rng.standard_normal((25, 32)) * s for c, s in zip(centre, (0.05, 0.1, 0.2, 0.25, 0.3, 0.0), strict=True))])
    ids = rng.permutation(len(v)).tolist()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, recall=0.99999, block=block).collect()}
    assert got == brute(ids, v)


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.01]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.op9(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 7: (3, 1, False), None: (3, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 8, 9)}
    assert embeddings.op9(df.limit(0)).isEmpty()


def test_embeddings_of_very_different_lengths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k, dims in enumerate((10, 4106)):
        base = rng.standard_normal((10, dims))
        rows += [(20 * k + i, x.tolist()) for i, x in enumerate(np.concatenate([base, base * 3 + 0.01 * rng.standard_normal((10, dims))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(5) for c in ("id", "v", "n", "t", "code")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.op9(df).collect()}
    exp = {}
    for k in (0, 1):
        own = rows[20 * k : 20 * k + 20]
        exp |= brute([i for i, _ in own], np.array([x for _, x in own]))
    assert got == exp


def test_embeddings_of_repeated_keys(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.op9(df).collect())
    assert got == [(3, 1, 3, True)] * 3 + [(4, 1, 3, False), (9, 0, 9, True)]


@pytest.mark.parametrize("stack", [1, 8, 64])
def test_pairs_of_stacks_and_blocks(stack, monkeypatch):
    monkeypatch.setattr(embeddings, "STACK", stack)
    rng = np.random.default_rng(stack)
    sizes = rng.integers(1, 30, 40)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    unit = embeddings._unit(rng.standard_normal((bounds[-1], 4)))
    left = np.concatenate([np.ones(n, bool) if i % 3 else rng.random(n) < 0.5 for i, n in enumerate(sizes)])
    got = sorted(tuple(sorted(x)) for x in zip(*(v.tolist() for v in embeddings._pairs(unit, bounds, left, 0.9)), strict=True))
    exp = []
    for s, e in zip(bounds, bounds[1:], strict=False):
        whole = left[s:e].all()
        exp += [(i, j) for i in range(s, e) for j in range(i + 1, e) if unit[i] @ unit[j] >= 0.9 and (whole or left[i] != left[j])]
    assert got == sorted(exp)


def test_layout():
    for n in (10, 10**4, 10**9):
        signs, tables = embeddings.layout(n)
        met = (1 - np.arccos(0.95) / np.pi) ** signs
        assert 1 - (1 - met) ** tables >= 0.999 and n / 2**signs < 40


def test_components_of_a_chain_and_a_star(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1000, 1300)} == {7} and 5 not in got
    assert components.components(links.limit(0)).isEmpty()


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, states = docs.schema, [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(saved(stage(spark, states[-1], folder)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert states[-1].schema == schema
    first, second, third, fourth, last = states[1:]
    model = quality.train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_quality(docs, model).filter("score >= 0.3").collect()}
    assert {r.doc_id for r in first.collect()} == kept
    from cellweave.llm.simhash import op7

    assert {r.doc_id for r in second.collect()} == {r.component_id for r in op7(first).collect()}
    from .test_texts import brute_repeats

    lost = {d: n - g for d, n, g, *_ in brute_repeats([(r.doc_id, r.text) for r in second.collect()], corpus_pipeline.PASSAGE)}
    left = {r.doc_id: r.text for r in third.collect()}
    assert left.keys() == lost.keys() and all(lost[d] - 6 * 9 <= len(t.encode()) <= lost[d] for d, t in left.items())
    assert fourth.count() == third.count()
    from .test_texts import plain_secrets

    assert sum(len(plain_secrets(r.text)) for r in fourth.collect()) == 0
    exp = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.op5(fourth).collect()}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in last.collect()} == exp
    run = corpus_pipeline.run(spark, folder)
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in run.collect()} == exp


def test_pipeline_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, folder))
    assert docs.isEmpty()


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n))
    one, two, passage = word(300), word(300), word(60)
    rows = [(1, one), (1, one), (5, one), (5, two + " " + passage), (6, passage + " " + word(200)), (7, None), (8, ""), (None, word(50)), (9, "token=abcdef123 " + word(40))]
    docs = spark.createDataFrame([(d, t, "en", None if d == 6 else "s", len(t or ""), 4) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    states = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[1:]:
        states.append(saved(stage(spark, states[-1], str(tmp_path))))
    kept, cut, clean, last = ({(r.doc_id, r.text) for r in s.collect()} if "text" in s.columns else s.collect() for s in states[1:])
    assert (5, one) not in kept and (1, one) in kept and (5, rows[3][1]) in kept and (None, rows[7][1]) in kept and (7, None) in kept
    assert {d for d, _ in cut} == {d for d, _ in kept} and all(passage not in (t or "") for _, t in cut) and (7, None) in cut
    assert any("<assign>" in (t or "") for d, t in clean if d == 9) and states[3].columns == docs.columns
    assert {r.doc_id for r in last} == {d for d, _ in clean}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_registry():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11)) and queries.QUERIES.items() <= found.items()
    assert found["pipeline"] is corpus_pipeline.run and set(__spark_entry__.oracle_sql()) <= set(found)


def test_embeddings_against_sql(spark, folder):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = c.sql(queries.ORACLE_SQL["op9_embeddings"])
    got = queries.QUERIES["op9_embeddings"](spark, folder)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
