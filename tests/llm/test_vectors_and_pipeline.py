"""Operators on vectors against brute force, and the pipeline's stages."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from curatorium.llm import embedding_dedup, queries, topk
from tests.compare import duck_rows, rows_of
from tests.llm.tables import no_docs, odd_docs

SMALL = "/root/testdata/sf0.001"
ODD = [
    (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.99, 0.1, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 1.0]), (7, [float("inf"), 0.0, 1.0]), (8, [0.0, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]),
    (None, [1.0, 0.0, 0.0]), (100, [-1.0, -0.001, 0.0]), (101, [2e19, 0.0, 0.0]), (200, []),
]


def odd_vectors(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.selectExpr("*", "'x' AS id", "'x' AS x", "1 AS weight", "'x' AS cell") if extra else df


def valid(rows):
    return [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=np.float64)).all()]


def best(rows, k=10):
    """All of (query, rank, vec_id, score) by brute force."""
    ids = [i for i, _ in valid(rows)]
    x = np.array([np.floor(1024 * v) for _, v in valid(rows)]).astype(np.int64)
    out = set()
    for q in sorted({i for i in ids if i % 100 == 0}):
        scores = x @ x[ids.index(q)]
        order = sorted((-int(s), i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(order, 1)}
    return out


def test_topk_equals_brute_force(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op4_exact_topk(spark, data).collect()} == best(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    columns, rows = duck_rows(data, queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(columns, rows) and rows


def test_topk_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 101]
    got = Counter(tuple(r) for r in topk.top_k(odd_vectors(spark, rows)).collect())
    assert set(got) == best(rows) and max(got.values()) == 1
    assert topk.top_k(odd_vectors(spark, [], extra=False)).count() == 0
    r = np.random.default_rng(2)
    many = [(k, [float(v) for v in x]) for k, x in enumerate(np.round(r.normal(size=(600, 4)), 1))]  # ties
    assert {tuple(x) for x in topk.top_k(odd_vectors(spark, many), pivots=5, annuli=3).collect()} == best(many)


def test_topk_repeated_queries_and_large_components(spark):
    """A query id with several vectors asks with one of them whatever the order of the rows; scores beyond 64 bits end there."""
    r = np.random.default_rng(4)
    rows = [(k % 250, [float(v) for v in x]) for k, x in enumerate(r.normal(size=(500, 6)))]
    one, two = (Counter(tuple(x) for x in topk.top_k(odd_vectors(spark, part, extra=False).repartition(n)).collect()) for part, n in ((rows, 1), (rows[::-1], 7)))
    assert one == two and len({x[0] for x in one}) == 3
    large = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [3e6, 1e6]), (100, [3e3, 1e3])]
    got = {(x["query_id"], x["vec_id"]): x["score"] for x in topk.top_k(odd_vectors(spark, large, extra=False)).collect()}
    assert got[0, 1] == (1 << 63) - 1 and got[0, 2] == -(1 << 63) and got[100, 3] == 10**10 << 20


def links_of(rows, cosine=0.9):
    use = [(i, v / (np.abs(v).max())) for i, v in valid(rows) if np.abs(v).max() > 0]
    x = np.array([v / np.linalg.norm(v) for _, v in use])
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return [i for i, _ in use], near


def components_of(ids, near):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for k in range(len(ids)):
            low = min([label[k], *(label[j] for j in np.flatnonzero(near[k]))])
            changed |= low != label[k]
            label[k] = low
    return dict(zip(ids, label, strict=True))


def test_embedding_links(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    ids, near = links_of(rows)
    got = {r["vec_id"]: r for r in queries.op6_embedding_near_dedup(spark, data).collect()}
    assert len(got) == len(rows)
    true, found = near.sum(), sum(r["n_links"] for r in got.values())
    assert found <= true and found >= 0.99 * true
    if found == true:
        want = components_of(ids, near)
        assert all(got[i]["component_id"] == want[i] for i in ids)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_embedding_odd_rows(spark):
    rows = embedding_dedup.near_duplicates(odd_vectors(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["vec_id"]: r for r in rows}
    assert [by[k]["n_links"] for k in (0, 1, 2, 101, 3, 4, 5, 6, 7, 8)] == [3, 3, 3, 3, 0, 0, 0, 0, 0, 1]
    assert by[101]["component_id"] == 0 and not by[101]["kept"] and by[None]["component_id"] is None and by[None]["kept"]
    assert embedding_dedup.near_duplicates(odd_vectors(spark, [], extra=False)).count() == 0


def test_embedding_recall(spark):
    """Planted pairs of 64 components with cosines of 0.90 to 0.99 among unrelated vectors: at least 0.99 of the links are found, none that is not one."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        x, y = r.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = 0.9001 + 0.09 * k / 1500
        y = c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (3 * y).tolist())]
    rows += [(10_000 + k, v) for k, v in enumerate(r.normal(size=(2000, 64)).tolist())]
    ids, near = links_of(rows)
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(odd_vectors(spark, rows, extra=False)).collect()}
    true = dict(zip(ids, near.sum(axis=1), strict=True))
    assert sum(true.values()) >= 3000 and all(got[i]["n_links"] <= n for i, n in true.items())
    assert sum(x["n_links"] for x in got.values()) >= 0.99 * sum(true.values())


def test_embedding_clusters(spark):
    """Clusters of tens to hundreds of vectors that all link: each link is counted once, in whatever tables it is met."""
    r = np.random.default_rng(9)
    rows = []
    for size in (2, 3, 10, 60, 300):
        centre = r.normal(size=32)
        rows += [(len(rows) + k, (centre + 0.02 * r.normal(size=32)).tolist()) for k in range(size)]
    ids, near = links_of(rows)
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(odd_vectors(spark, rows)).collect()}
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, near.sum(axis=1).tolist(), strict=True))
    assert {i: got[i]["component_id"] for i in ids} == components_of(ids, near)


def test_embedding_blocks(spark, monkeypatch):
    """A bucket of several blocks gives every link once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(3)
    centre = r.normal(size=8)
    rows = [(k, [float(v) for v in centre + 0.15 * r.normal(size=8)]) for k in range(90)] + [(100 + k, [float(v) for v in r.normal(size=8)]) for k in range(30)]
    ids, near = links_of(rows)
    got = {x["vec_id"]: x["n_links"] for x in embedding_dedup.near_duplicates(odd_vectors(spark, rows)).collect()}
    assert sum(got.values()) <= near.sum() and sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= n for i, n in zip(ids, near.sum(axis=1), strict=True))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            rows = out.collect()
            assert 0 < len(rows) and (name == "source_mixing" or len(rows) <= n)
            n, docs = len(rows), spark.createDataFrame(rows, docs.schema)
    assert out.count() > 0
    tokens = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sum(r[1] != 4096 for r in tokens) <= 1
    assert math.isclose(max(r["sequence_id"] for r in tokens), len(tokens) - 1)


def test_stages_take_odd_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), SMALL).count() == 0, name
        assert stage(spark, odd_docs(spark), SMALL).count() >= 0, name
