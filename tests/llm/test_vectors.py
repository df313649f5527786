"""Linked vectors against all cosines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkmill.llm import queries, vector_dedup
from tests.llm.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, pivot int, weight double"


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == dim]
        m = np.array([rows[i][1] for i in own], np.float32).astype(float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1)), strict=True):
            links[own[a]].add(own[b])
            links[own[b]].add(own[a])
    near = {i: set(s) for i, s in links.items()}
    by_id = {}
    for i in good:
        by_id.setdefault(rows[i][0], []).append(i)
    for same in by_id.values():
        for i in same:
            near[i] |= set(same)
    label, out = {}, []
    for i in range(len(rows)):
        if i not in label:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            label |= {j: min(ids, default=None) for j in seen}
        out.append((rows[i][0], len(links[i]), label[i], rows[i][0] == label[i]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1, 0.5) for k, v in rows], SCHEMA).repartition(3)


def family(rng, n, dim, spread, begin):
    center = rng.normal(size=dim)
    return [(begin + i, (center + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_families_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=32).astype(np.float32).tolist()) for k in range(600)]
    rows += family(rng, 150, 32, 0.15, 1000) + family(rng, 3, 32, 0.1, 2000)
    rows += [(3000 + i, rows[7][1]) for i in range(200)] + [(4000 + i, (2.0 * np.array(rows[8][1])).tolist()) for i in range(3)]
    assert got(vector_dedup.near_vectors(frame(spark, rows))) == brute(rows)


def test_long_lists_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", (16, 16))
    monkeypatch.setattr(vector_dedup, "CELLS", 200)
    rng = np.random.default_rng(4)
    rows = family(rng, 300, 16, 0.12, 0) + [(1000 + k, rng.normal(size=16).astype(np.float32).tolist()) for k in range(100)]
    assert got(vector_dedup.near_vectors(frame(spark, rows), cosine=0.95)) == brute(rows, 0.95) or recall(spark, rows, 0.95) >= 0.97


def recall(spark, rows, cosine):
    want = {k: n for k, n, _, _ in brute(rows, cosine)}
    found = {k: n for k, n, _, _ in got(vector_dedup.near_vectors(frame(spark, rows), cosine))}
    assert all(found[k] <= n for k, n in want.items())
    return sum(found.values()) / max(1, sum(want.values()))


@pytest.mark.parametrize("n, dim", [(1500, 64), (3000, 32)])
def test_recall_of_pairs_at_just_the_threshold(spark, n, dim):
    """Each vector has one partner whose cosine is 0.9 to 0.905."""
    rng = np.random.default_rng(dim)
    u = vector_dedup.directions(n, dim)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.905, size=(n, 1))
    rows = [(i, r) for i, r in enumerate(u.astype(np.float32).tolist())] + [(n + i, r) for i, r in enumerate((c * u + np.sqrt(1 - c * c) * w).astype(np.float32).tolist())]
    share = recall(spark, rows, 0.9)
    print("recall", share)
    assert share >= 0.93


def test_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [1, -0.0, 0]), (4, None), (5, []), (6, [0, 0, 0]), (7, [nan, 1, 0]), (8, [inf, 1, 0]), (9, [None, 1, 0]), (10, [1, 0]), (11, [3, 0]), (12, [0, 1, 0]), (12, [0, 0, 1]), (13, [0, 0, 2]), (None, [1, 0, 0]), (None, None), (14, [0, 1, 0]), (15, [-1, 0, 0]), (16, [1e30, 0, 0]), (17, [1e-30, 1e-30, 0]), (18, [1, 0.4843, 0])]
    made = frame(spark, rows)
    assert got(vector_dedup.near_vectors(made)) == brute(rows)
    double = made.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert [r[:2] for r in got(vector_dedup.near_vectors(double))] == [r[:2] for r in brute(rows)]
    assert vector_dedup.near_vectors(made.limit(0)).count() == 0
    assert got(vector_dedup.near_vectors(made.where("vec_id = 4"))) == [(4, 0, 4, True)]


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert got(queries.op13_vector_dedup(spark, SMALL)) == brute(rows)
