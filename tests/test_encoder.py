"""Sketched TF-IDF directions against an exact decomposition of the same matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.plans import features


def texts(n=240, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        topic = (i % 6) * 40
        out.append(" ".join(vocabulary[topic + int(k)] if rng.random() < 0.7 else vocabulary[int(rng.integers(0, 300))] for k in rng.integers(0, 40, 50)))
    return out


def test_directions_keep_what_an_exact_decomposition_keeps(spark):
    df = spark.createDataFrame(list(enumerate([*texts(), "", None])), "id long, text string").repartition(5)
    buckets, k = 1 << 12, 8
    got = {}
    for parts in (1, 5):
        encode = features.tfidf_encoder(k, buckets)(df.repartition(parts), "text")
        got[parts] = {r.id: np.array(r.v) for r in encode(df, "text", "v").collect()}
    assert all(got[1][i] @ got[1][j] == pytest.approx(got[5][i] @ got[5][j], abs=1e-6) for i in range(0, 240, 7) for j in range(0, 240, 11))
    assert not got[1][240].any() and not got[1][241].any() and len(got[1][0]) == k
    ids = {r.id: r.b for r in df.select("id", F.transform(features.char_grams(F.col("text")), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")).alias("b")).where("id < 240").collect()}
    counts = np.array([np.bincount(ids[i], minlength=buckets) for i in range(240)], float)
    n = 242
    a = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * (np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    x = u[:, :k] * s[:k]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = np.array([got[5][i] for i in range(240)])
    assert np.abs(x @ x.T - v @ v.T).mean() < 0.1
    q = np.linalg.qr(v)[0]  # the space that the embedding spans holds nearly all that the best one of its size holds
    assert np.linalg.norm(q.T @ a) ** 2 > 0.93 * (s[:k] ** 2).sum()
    same = [v[i] @ v[j] for i in range(60) for j in range(60) if i < j and i % 6 == j % 6]
    other = [v[i] @ v[j] for i in range(60) for j in range(60) if i % 6 != j % 6]
    assert np.mean(same) > np.mean(other) + 0.4


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert features.tfidf_encoder(4, 64, 16)(df, "text")(df, "text", "v").count() == 0
