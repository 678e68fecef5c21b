"""Centroid clustering against Python's integers, and the search against all distances."""

import hashlib
import math

import numpy as np
import pytest

from gradeloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string, distance string"


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(q) for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    return sorted((str(i), near(q)[1], near(q)[0]) for i, q in kept), at


def cases(size, n=160, seed=5):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.4, (5, size))
    rows = [(i, [float(x) for x in middles[i % 5] + rng.normal(0, 0.2, size)], 7, "q", "d") for i in range(n)]
    rows += [(200, None, 7, "q", "d"), (201, [], 7, "q", "d"), (202, [0.5] * (size - 1), 7, "q", "d"), (203, [None] + [0.1] * (size - 1), 7, "q", "d")]
    rows += [(204, [math.nan] * size, 7, "q", "d"), (205, [-math.inf] + [0.0] * (size - 1), 7, "q", "d"), (None, [0.25] * size, 7, "q", "d")]
    return rows + [rows[3]] * 30 + [(300 + i, [0.0] * size, 7, "q", "d") for i in range(9)]


def test_clusters_are_those_of_whole_numbers(spark):
    rows = cases(64)
    found, at = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(6), rounds=4)
    want, centres = plain(rows, 8, 4, 64)
    assert at == centres and sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want


def test_inertia_and_digests(spark):
    rows = cases(6, 40)
    found, at = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=3, rounds=10, size=6)
    got = centroids.with_inertia(found, at).collect()
    want, centres = plain(rows, 3, 10, 6)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == want
    for r in got:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors_and_equal_ones(spark):
    df = spark.createDataFrame(cases(64)[:3], SCHEMA)
    found, at = centroids.cluster(df)
    assert len(at) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0]
    none = centroids.with_inertia(*centroids.cluster(df.where("false")))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = spark.createDataFrame([(i, [0.5] * 64, 0, "", "") for i in range(12)], SCHEMA)
    found, at = centroids.cluster(same)  # all ties go to the first centroid
    assert {(r.cluster, r.distance) for r in found.collect()} == {(0, 0)} and len(at) == 8


@pytest.mark.parametrize("scale", [1, 1 << 29])
def test_search_abandons_but_never_errs(scale):
    rng = np.random.default_rng(1)
    base = rng.integers(-300, 300, (12, 64))
    x = (base[rng.integers(0, 12, 4000)] + rng.integers(-40, 40, (4000, 64))) * scale
    x[:50] = base[:10].repeat(5, axis=0) * scale
    base[5] = base[2]  # a tie
    at = base * scale
    x, at = (x, at) if scale == 1 else (x.astype(object), at.astype(object))
    cluster, distance, spent = centroids.nearest(x, at, np.argsort(-x.astype(float).var(axis=0)))
    every = np.array([((x - c) ** 2).sum(axis=1) for c in at])
    assert (cluster == every.argmin(axis=0)).all() and (distance == every.min(axis=0)).all()
    assert spent < 0.5 * x.size * len(at)


def test_numbers_without_exact_integers_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0, "", "")], SCHEMA)
    with pytest.raises(Exception, match="below 2"):
        centroids.cluster(df)
