"""Block-grid retrieval against plain cosines, with ties, zero vectors, several blocks, and no nested loop in its plan."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import retrieval


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1), 0)


@pytest.fixture
def vectors(monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    v = np.random.default_rng(2).normal(size=(120, 8))
    v[5] = v[9] = v[70]
    v[30] = 0
    return v


@pytest.mark.parametrize("shared", [0, 64 << 20])
def test_ranks_and_metrics(spark, vectors, monkeypatch, shared):
    monkeypatch.setattr(retrieval, "SHARED_BYTES", shared)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    passages = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame([(i, v, i + 1, rows[i + 1][1]) for i, v in rows[:-1] if i % 3 == 0], "id long, v array<double>, target long, t array<double>")
    found = retrieval.ranks(queries, passages, (8, 3))
    got = {(r["query"], r["dims"]): r for r in found.collect()}
    for d in (8, 3):
        u = unit(vectors[:, :d])
        s = np.round(u @ u.T, 9)
        kept = []
        for i in range(0, 119, 3):
            others = [j for j in range(120) if j not in (i, i + 1)]
            r = got[i, d]
            assert r["rank"] == 1 + sum(s[i, j] > s[i, i + 1] for j in others) and r["n"] == 118
            assert r["others"] == pytest.approx(s[i, others].sum(), abs=1e-6)
            kept.append((r["rank"], s[i, i + 1], s[i, others]))
        m = next(r for r in retrieval.metrics(found).collect() if r["dims"] == d)
        assert m["mrr"] == pytest.approx(np.mean([1 / k for k, _, _ in kept]))
        assert m["margin"] == pytest.approx(np.mean([h for _, h, _ in kept]) - np.mean([o for _, _, o in kept]), abs=1e-6)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("excluded", [True, False])
def test_nearest_with_ties(spark, vectors, excluded):
    passages = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")
    got: dict = {}
    for r in retrieval.nearest(passages.where("id % 5 = 0"), passages, 4, excluded).collect():
        got.setdefault(r["query"], []).append((r["place"], r["neighbour"]))
    u = unit(vectors)
    s = np.round(u @ u.T, 9)
    for i in range(0, 120, 5):
        order = sorted((j for j in range(120) if not (excluded and j == i)), key=lambda j: (-s[i, j], j))[:4]
        assert [j for _, j in sorted(got[i])] == order
    assert retrieval.nearest(passages.limit(0), passages, 4).count() == 0 == retrieval.nearest(passages, passages.limit(0), 4).count()
