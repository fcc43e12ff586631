"""Near-duplicate vectors against all cosines."""

import math

import numpy as np
import pytest

from kinetrace.llm import queries, vectors

from .conftest import SMALL


def brute(rows, cosine=0.95):
    """(links, component) by position, from all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if ok[i] and ok[j] and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [(k, links[i], min((x for x in least[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(rows)]


def found(spark, rows, kind="array<double>", **more):
    got = vectors.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding {kind}"), **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def groups(rng, sizes, noise, dims=24):
    out = []
    for size in sizes:
        base = rng.standard_normal(dims)
        out += [(base + noise * np.linalg.norm(base) / math.sqrt(dims) * rng.standard_normal(dims)).tolist() for _ in range(size)]
    return out


def test_groups_of_near_copies(spark):
    rng = np.random.default_rng(5)
    rows = list(enumerate(groups(rng, [1] * 150 + [2] * 40 + [7] * 8, 0.2)))
    assert found(spark, rows) == sorted(brute(rows), key=str)


def test_a_large_group_goes_by_balls_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CROWD", 12)
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(6)
    loose, tight = groups(rng, [170] + [1] * 60, 0.26), groups(rng, [60], 0.12)
    rows = list(enumerate(loose + tight))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # exact copies of one of them
    want = brute(rows)
    assert len({c for _, n, c in want if n}) >= 2 and len({n for _, n, _ in want}) > 20  # pairs on both sides of the threshold
    assert found(spark, rows) == sorted(want, key=str)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [1.0, 0.0]), (None, [3.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, []), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, None]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e300]), (13, [1e-300, 1e-300]), (14, [-1.0, -0.0]), (None, [0.0, -1.0]), (None, None)]
    got = found(spark, rows)
    want = [(1, 3, 1), (2, 3, 1), (2, 3, 1), (None, 3, 1), (12, 1, 12), (13, 1, 12), (None, 0, None), (None, 0, None)] + [(i, 0, i) for i in (5, 6, 7, 8, 9, 10, 11, 14)]
    assert got == sorted(want, key=str)
    assert found(spark, []) == []
    assert found(spark, [(3, [1.0, 2.0])], "array<float>") == [(3, 0, 3)]


def test_recall_is_calibrated():
    rng = np.random.default_rng(9)
    lines = vectors.Projections(4000, 0.95)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((600, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (ca, pa), (cb, pb) = lines.keys(a, lines.tables), lines.keys(b, lines.tables)
    met = ((ca == cb) & (abs(pa - pb) <= lines.half)).sum(axis=1)
    assert abs(met.mean() / lines.tables - lines.chance) < 0.02
    assert lines.recall(lines.least) >= vectors.RECALL > lines.recall(lines.least + 1)
    assert (met >= lines.least).mean() >= 0.99
    apart = np.roll(cb, 1, axis=0) == ca
    assert (apart.sum(axis=1) >= lines.least).mean() < 0.01


@pytest.mark.parametrize("name", ["embeddings"])
def test_whole_small_table(spark, name):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.op11_vector_duplicates(spark, SMALL).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
