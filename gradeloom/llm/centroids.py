"""Centroid clustering with partial-distance search (operator 12).

Vectors are turned into integers once and written. A round is one pass over them: each task assigns its rows and adds
them up by cluster and component, those sums (clusters times components of them) are added by Spark, and the driver gets
as many numbers as the centroids have. So nothing depends on how rows are dealt out, and no row moves.

Assignment adds squared differences block by block, the components of highest variance first: a row leaves a centroid
once its part is strictly above the best distance so far; what survives finishes all components. The order decides only
how early rows leave. Distances and means are exact; components beyond 2**27 are computed with Python's integers.

Defined cases: a row without a vector, of another length, or with a null or non-finite component is left out; fewer
vectors than centroids give as many centroids as vectors; repeated rows are vectors of their own; a null id is last
among the first centroids; no vectors, no rows; other columns are ignored. A component of 2**53 or more is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Clusters, rounds, seed of the first centroids, components, and factor of the integers.
CLUSTERS, ROUNDS, SEED, SIZE, SCALE = 8, 10, 3, 64, 1024
#: Components a step of the search adds.
BLOCK = 8
#: Up to here differences squared and summed fit 64 bits; from there on no integer of a double is exact.
FAST, MOST = 1 << 27, 1 << 53


def integers(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x; null unless there are size components, all of them finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when((F.size(vector) == size) & fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    most = int(np.abs(values).max(initial=0))
    if most >= MOST:
        raise ValueError("components must stay below 2**53")
    return values if most < FAST else values.astype(object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, squared differences computed) of the rows of x; ties go to the smaller number."""
    if x.dtype != centroids.dtype:
        x, centroids = x.astype(object), centroids.astype(object)
    x, centroids = x[:, order], centroids[:, order]
    rows = np.arange(len(x))
    add = lambda r, c, a, b: ((x[r, a:b] - c[..., a:b]) ** 2).sum(axis=1)
    heads = np.array([add(rows, c, 0, block) for c in centroids], dtype=x.dtype)
    cluster = heads.argmin(axis=0)  # a first guess, finished at once
    best = heads[cluster, rows] + add(rows, centroids[cluster], block, x.shape[1])
    spent = heads.size * block + len(x) * (x.shape[1] - block)
    for j, c in enumerate(centroids):
        left = np.flatnonzero((cluster != j) & (heads[j] <= best))
        part = heads[j][left]
        for a in range(block, x.shape[1], block):
            part = part + add(left, c, a, a + block)
            spent += len(left) * block
            stays = part <= best[left]
            left, part = left[stays], part[stays]
        wins = (part < best[left]) | (j < cluster[left])
        cluster[left[wins]], best[left[wins]] = j, part[wins]
    return cluster, best, spent


def _array(centroids: list[list[int]]) -> np.ndarray:
    fast = all(abs(v) < FAST for c in centroids for v in c)
    return np.array(centroids, dtype=np.int64 if fast else object)


def _moments(vectors: DataFrame, size: int) -> np.ndarray:
    """The components in descending order of variance."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(size), np.zeros(size)
        for b in batches:
            x = matrix(b.column(0), size).astype(float)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total), pa.array(squares)], ["i", "n", "s", "q"])

    sums = vectors.select("q").mapInArrow(part, "i int, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = np.zeros(size)
    for r in sums.collect():  # a row a component
        spread[r.i] = r.q / r.n - (r.s / r.n) ** 2 if r.n else 0.0
    return np.argsort(-spread, kind="stable")


def _round(vectors: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The means of the vectors nearest to each centroid, rounded down; a centroid without vectors stays."""
    at, size = _array(centroids), len(order)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(at), np.int64), np.zeros((len(at), size), object)
        for b in batches:
            x = matrix(b.column(0), size)
            cluster, _, _ = nearest(x, at, order)
            for j in np.unique(cluster):
                mine = x[cluster == j]
                counts[j] += len(mine)
                sums[j] += mine.sum(axis=0)  # a batch's sums fit; those of a task are Python's integers
        some = [int(j) for j in np.flatnonzero(counts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([j for j in some for _ in range(size)], pa.int32()), pa.array([i for _ in some for i in range(size)], pa.int32()), pa.array([int(counts[j]) for j in some for _ in range(size)], pa.int64()), pa.array([str(v) for j in some for v in sums[j]], pa.string())],
            ["j", "i", "n", "s"],
        )

    sums = vectors.select("q").mapInArrow(part, "j int, i int, n long, s string").groupBy("j", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = [list(c) for c in centroids]
    for r in sums.collect():  # clusters times components
        new[r.j][r.i] = int(r.s) // r.n
    return new


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of the vectors of df(vec_id, embedding) that can be used; the centroids)."""
    vectors = df.select("vec_id", integers(F.col("embedding"), size, scale).alias("q")).where("q is not null")
    vectors = written(vectors)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.q) for r in vectors.orderBy(key.asc_nulls_last(), "vec_id", "q").limit(k).collect()]
    schema = vectors.select("vec_id").withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}).schema
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    order = _moments(vectors, size)
    for _ in range(rounds):
        new = _round(vectors, centroids, order)
        if new == centroids:  # nothing changes any more
            break
        centroids = new
    at = _array(centroids)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, distance, _ = nearest(matrix(b.column(1), size), at, order)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int32()), pa.array([int(d) for d in distance], pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(part, schema), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found of cluster() with the summed distances of each cluster and of all, and the digest of each centroid."""
    found = written(found)
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = found.sparkSession.createDataFrame(digests, "c int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    facts = names.join(sums, F.col("c") == F.col("cluster")).select("c", F.col("s").cast("long").alias("cluster_inertia"), "centroid_sha256")
    whole = found.agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("inertia"))
    # one row a centroid, and one row: bounded, so broadcast
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("c")).join(F.broadcast(whole)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings")))


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT)))"
    near = lambda t: (
        f"a{t} AS MATERIALIZED (SELECT id, vec_id, q, j, d FROM (SELECT v.id, v.vec_id, v.q, c.j, {square} AS d FROM v, c{t} c) "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, j) = 1)"
    )
    mean = lambda t: (
        f"m{t} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t}) GROUP BY j, i), "
        f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{t} GROUP BY j) m USING (j))"
    )
    steps = ",\n".join(f"{near(t)},\n{mean(t)}" for t in range(ROUNDS))
    bad = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE len(embedding) = {SIZE} AND {bad}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k) - 1 AS j, q FROM (SELECT sha256('{SEED}:' || vec_id) AS k, q FROM v ORDER BY k LIMIT {CLUSTERS})),
{steps},
{near(ROUNDS)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (j)
"""


ORACLE = _oracle()
