"""Bootstrap intervals by exact resampling: every replicate draws as many rows as there are, with replacement.

Equal rows are one cell with a count, since a draw can't tell them apart, so rows aren't multiplied: scores on a grid have
few cells, whatever their number. Cells lie in buckets by hash. A replicate's draws are split over the buckets by halves,
each a binomial given the draws of both, and within a bucket by one multinomial; each node of that tree has a generator
of its own, so all tasks agree on its draws without sharing any, and reruns and partitions don't matter. A metric is a
function of sums over rows (QWK, too, is one of six sums), so a replicate is a few numbers, which tasks add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.session import written

from .traits import summed

#: Cells of a bucket, about; most buckets (the tree of their sizes is sent to the tasks); replicates computed at once.
BUCKET_CELLS, MOST_BUCKETS, TOGETHER = 2000, 1 << 16, 100

Sums = Mapping[str, np.ndarray]
Metric = Callable[[Sums], np.ndarray]


def generator(seed: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFFFFFFFFFF, node]))


def halved(sizes: np.ndarray) -> np.ndarray:
    """The tree of sizes: node 1 has all, node i is split into 2i and 2i + 1, the last level are the buckets."""
    tree = np.zeros(2 * len(sizes), np.int64)
    tree[len(sizes) :] = sizes
    for i in range(len(sizes) - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def draws_of(tree: np.ndarray, bucket: int, n: int, seed: int) -> np.ndarray:
    """How many of a replicate's draws fall into a bucket, for n replicates."""
    node, draws = 1, np.full(n, tree[1], np.int64)
    path = bin(len(tree) // 2 + bucket)[3:]
    for bit in path:
        left = generator(seed, node).binomial(draws, tree[2 * node] / tree[node]) if tree[node] else np.zeros(n, np.int64)
        draws = draws - left if bit == "1" else left
        node = 2 * node + int(bit)
    return draws


def resampled(df: DataFrame, sums: Mapping[str, Column], n: int = 1000, seed: int = 42) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """(the sums over all rows, n values of each: the sums over each replicate), with the number of rows as the sum "n"."""
    names = list(sums)
    cells = df.select(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(sums.values())))
    values = [f"s{i}" for i in range(len(names))]
    cells = cells.groupBy(*values).agg(F.count("*").alias("c")) if values else cells.agg(F.count("*").alias("c"))
    cells = written(cells)
    hashed = F.xxhash64(*values) if values else F.lit(0).cast("long")
    # the hash's leading bits name the bucket, at any number of buckets
    fine = cells.groupBy(F.shiftrightunsigned(hashed, 48).cast("int").alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("k"))
    found = fine.collect()  # MOST_BUCKETS rows at most
    size, n_cells = np.zeros(MOST_BUCKETS, np.int64), sum(r.k for r in found)
    for r in found:
        size[r.b] = r.c
    levels = min(16, int(np.ceil(np.log2(max(n_cells / BUCKET_CELLS, 1)))))
    tree = halved(size.reshape(1 << levels, -1).sum(axis=1))
    shift = 64 - levels

    def part(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = np.zeros((n + 1, len(names) + 1))

        def add(bucket: int, count: np.ndarray, x: np.ndarray) -> None:
            order = np.lexsort(x.T[::-1]) if x.shape[1] else np.arange(len(x))  # whatever the order of rows
            count, x = count[order], np.column_stack([x, np.ones(len(x))])[order]
            out[n] += count @ x
            draws, rng = draws_of(tree, bucket, n, seed), generator(seed, len(tree) + bucket)
            for at in range(0, n, TOGETHER):
                out[at : min(at + TOGETHER, n)] += rng.multinomial(draws[at : at + TOGETHER], count / count.sum()) @ x

        held: list[tuple] = []
        for b in batches:
            bucket, count = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]) if values else np.zeros((len(bucket), 0))
            ends = np.flatnonzero(np.diff(bucket)) + 1
            for i, j in zip([0, *ends], [*ends, len(bucket)]):
                if j > i:
                    if held and held[0][0] != bucket[i]:
                        add(int(held[0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
                        held = []
                    held.append((bucket[i], count[i:j], x[i:j]))
        if held:
            add(int(held[0][0]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        return {0: out.ravel()}

    bucket = F.shiftrightunsigned(hashed, shift).cast("int") if levels else F.lit(0)
    dealt = cells.select(bucket.alias("b"), "c", *values).repartition("b").sortWithinPartitions("b")
    got = summed(dealt, part).get(0, np.zeros((n + 1) * (len(names) + 1))).reshape(n + 1, -1)
    every = [*names, "n"]
    return {k: float(v) for k, v in zip(every, got[n])}, dict(zip(every, got[:n].T))


def intervals(df: DataFrame, sums: Mapping[str, Column], metrics: Mapping[str, Metric], n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, estimate, low, high, n_valid): percentile intervals of metrics, functions of sums over the rows of df.

    Replicates in which a metric isn't finite are left out of it and not counted; a metric without any has no interval.
    """
    whole, replicates = resampled(df, sums, n, seed)
    rows, tail = [], (1 - level) / 2
    finite = lambda x: float(x) if np.isfinite(x) else None
    with np.errstate(divide="ignore", invalid="ignore"):
        for name, metric in metrics.items():
            point = np.asarray(metric({k: np.array([v]) for k, v in whole.items()}), float)[0]
            values = np.asarray(metric(replicates), float)
            values = values[np.isfinite(values)]
            low, high = (float(q) for q in np.quantile(values, [tail, 1 - tail])) if len(values) else (None, None)
            rows.append((name, finite(point), low, high, len(values)))
    return df.sparkSession.createDataFrame(rows, "metric string, estimate double, low double, high double, n_valid long")


def score_sums(gold: Column, pred: Column, prefix: str = "", step: float = 0.25) -> dict[str, Column]:
    """The sums that score_metrics() needs, of two columns of scores; rows where either is null count for nothing."""
    both = gold.isNotNull() & pred.isNotNull()
    e, i, j = pred - gold, F.rint(gold / step), F.rint(pred / step)
    parts = {"k": F.lit(1.0), "abs": F.abs(e), "e": e, "e2": e * e, "exact": (F.abs(e) <= 1e-9).cast("double"), "near": (F.abs(e) <= 1).cast("double"), "d2": (i - j) ** 2, "ij2": i * i + j * j, "i": i, "j": j}
    return {prefix + k: F.when(both, v) for k, v in parts.items()}


def score_metrics(prefix: str = "") -> dict[str, Metric]:
    """MAE, RMSE, bias, shares of exact and near scores, and QWK on the grid of score_sums()."""
    p = prefix
    ratio = lambda k: lambda s: s[p + k] / s[p + "k"]
    expected = lambda s: s[p + "k"] * s[p + "ij2"] - 2 * s[p + "i"] * s[p + "j"]
    return {
        "mae": ratio("abs"), "rmse": lambda s: np.sqrt(s[p + "e2"] / s[p + "k"]), "bias": ratio("e"), "exact": ratio("exact"), "within_1": ratio("near"),
        "qwk": lambda s: 1 - s[p + "k"] * s[p + "d2"] / np.where(expected(s) > 0, expected(s), np.nan),
    }


def score_intervals(df: DataFrame, gold: str, pred: str, n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """intervals() of the metrics of one column of predictions."""
    return intervals(df, score_sums(F.col(gold), F.col(pred)), score_metrics(), n, seed, level)


def delta_intervals(df: DataFrame, gold: str, before: str, after: str, n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """intervals() of what each metric gains from before to after: both are of the same rows, so they share the draws.

    Only rows with all three scores count.
    """
    rows = df.where(F.col(gold).isNotNull() & F.col(before).isNotNull() & F.col(after).isNotNull())
    sums = score_sums(F.col(gold), F.col(before), "a_") | score_sums(F.col(gold), F.col(after), "b_")
    a, b = score_metrics("a_"), score_metrics("b_")
    metrics = {f"delta_{k}": (lambda s, k=k: b[k](s) - a[k](s)) for k in a}
    return intervals(rows, sums, metrics, n, seed, level)


def mean_intervals(df: DataFrame, columns: Mapping[str, Column], n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """intervals() of the means of columns, each over its rows that aren't null."""
    sums = {k: v for m, c in columns.items() for k, v in ((f"{m}:sum", c), (f"{m}:rows", c.isNotNull().cast("double")))}
    return intervals(df, sums, {m: (lambda s, m=m: s[f"{m}:sum"] / s[f"{m}:rows"]) for m in columns}, n, seed, level)
