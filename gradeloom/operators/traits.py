"""Bagged models of several targets at once: ridges or boosted trees whose statistics are summed over the rows.

All targets and bags share each pass over the rows. A pass adds up, in each task, one array a model (products of the
features, errors of penalties, histograms of residuals); arrays of a model are added by Spark, and the driver gets one
array a model, whose size depends on features, bins and penalties only. So the number of jobs doesn't grow with targets
or bags, and no row is brought anywhere.

Ridge: two passes. The products of standardised features are decomposed once a model; the decomposition gives the
weights of every penalty, and with a second pass the exact error that each row has when it is left out. Trees: three
passes a round, one for each depth, over features in bins; the residuals of later rounds start from written scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gradeloom.functions.text import once
from gradeloom.session import written

from .sampling import unit_hash

#: Penalties that a ridge is chosen from, by its error on rows left out one at a time.
ALPHAS = np.logspace(-3, 3, 25)
#: Boosting: bins of a feature, depth, rate, share of the rows a round sees, rounds between written scores.
BINS, DEPTH, RATE, SUBSAMPLE, STATE_ROUNDS = 32, 3, 0.05, 0.9, 25
#: A row's weight in a bag is how many of these limits its hash reaches: a Poisson count of mean 1.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)


@dataclass
class Linear:
    """A ridge on raw features; alpha is the chosen penalty, errors are those of all penalties."""

    weights: np.ndarray
    intercept: float
    alpha: float
    errors: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def importance(self) -> np.ndarray:
        return np.abs(self.weights)


@dataclass
class Trees:
    """Boosted trees over binned features; each is (features, bins, values) of a complete tree."""

    start: float
    edges: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.start + sum((v[_leaf(bins, f, b)] for f, b, v in self.trees), np.zeros(len(bins)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(_binned(x, self.edges))

    def importance(self) -> np.ndarray:
        return self.gains if self.gains is not None and self.gains.sum() > 0 else np.zeros(len(self.edges))


@dataclass
class Trait:
    """The bags of one target. places: its features among names, one that is hinted twice."""

    names: list[str]
    places: list[int]
    medians: np.ndarray
    bags: list[Linear | Trees]
    isotonic: IsotonicRegressionModel | None = None
    stats: dict[str, float] = field(default_factory=dict)

    def bag_scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, bags) of raw features x, missing ones being NaN."""
        x = np.where(np.isnan(x), self.medians, x)[:, self.places]
        return np.stack([b(x) for b in self.bags], axis=1)

    def scores(self, df: DataFrame, key: str) -> DataFrame:
        """(key, mean, std) over the bags, the mean made monotone where that was fitted."""
        return trait_scores({"t": self}, df, key).select(key, F.col("t").alias("mean"), F.col("t__std").alias("std"))

    def importance(self, top: int = 15) -> list[tuple[str, float]]:
        """The features that weigh most, summed over a feature's copies and averaged over the bags."""
        total: dict[str, float] = {}
        for b in self.bags:
            for p, v in zip(self.places, b.importance()):
                total[self.names[p]] = total.get(self.names[p], 0.0) + float(v) / len(self.bags)
        return sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:top]


def report(traits: Mapping[str, Trait], top: int = 8) -> str:
    """A few lines a target: rows, error on rows left out of bags, features that weigh most."""
    line = lambda k, t: f"{k}: n={t.stats['n']:.0f}, out-of-bag MAE={t.stats['oob_mae']:.3f}; " + ", ".join(f"{n} ({v:.3f})" for n, v in t.importance(top))
    return "\n".join(line(k, t) for k, t in traits.items())


# --- rows and sums ---------------------------------------------------------------------------------------------------


def _features(names: Sequence[str]) -> Column:
    return F.array(*(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names))


def _doubles(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blobs(arrays: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(arrays), pa.int32()), pa.array([a.astype(np.float64).tobytes() for a in arrays.values()], pa.binary())], ["model", "blob"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for model, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(blob)
            totals[model] = totals[model] + x if model in totals else x
    if totals:
        yield _blobs(totals)


def summed(data: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The arrays of part, which a task makes of all its rows, added up by model: one array a model comes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = part(batches)
        if arrays:
            yield _blobs(arrays)

    schema = "model int, blob binary"
    rows = data.mapInArrow(task, schema).repartition("model").mapInArrow(_add, schema).collect()
    return {r.model: np.frombuffer(r.blob) for r in rows}


# --- ridge -----------------------------------------------------------------------------------------------------------


def _ridges(data: DataFrame, traits: list[Trait], n_bags: int, width: int) -> None:
    """Fills the bags of traits; data has x, y and w (a weight a bag)."""
    sizes = [len(t.places) for t in traits]

    def rows_of(b: pa.RecordBatch):
        x, y, w = _doubles(b, "x", width), _doubles(b, "y", len(traits)), _doubles(b, "w", n_bags)
        for t, trait in enumerate(traits):
            some = ~np.isnan(y[:, t])
            # about the medians, so that the products don't cancel
            yield t, (np.where(np.isnan(x[some]), 0.0, x[some] - trait.medians))[:, trait.places], y[some, t], w[some]

    def products(batches):
        out = {t * n_bags + b: np.zeros((s + 2, s + 2)) for t, s in enumerate(sizes) for b in range(n_bags)}
        for batch in batches:
            for t, x, y, w in rows_of(batch):
                z = np.column_stack([np.ones(len(x)), x, y])
                for b in range(n_bags):
                    out[t * n_bags + b] += (z * w[:, [b]]).T @ z
        return out

    sums, solved = summed(data, products), {}
    for m, s in sums.items():
        g = s.reshape(sizes[m // n_bags] + 2, -1)
        n = g[0, 0]
        if n == 0:  # a bag of a few rows may be empty
            continue
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        std[std < 1e-12 * np.maximum(1.0, np.abs(mean[:-1]))] = np.inf  # a constant says nothing
        values, vectors = np.linalg.eigh(n * cov[:-1, :-1] / np.outer(std, std))
        solved[m] = (n, mean[:-1], mean[-1], std, np.maximum(values, 0), vectors, vectors.T @ (n * cov[:-1, -1] / std))

    def left_out(batches):
        """Weighted squared errors of each penalty, every row left out of the fit that judges it, one copy at a time."""
        out = {m: np.zeros(len(ALPHAS)) for m in solved}
        for batch in batches:
            for t, x, y, w in rows_of(batch):
                for b in range(n_bags):
                    if (m := t * n_bags + b) in solved and len(x):
                        n, mean, y_mean, std, values, vectors, right = solved[m]
                        u = ((x - mean) / std) @ vectors
                        shrink = 1 / (values[:, None] + ALPHAS)
                        lever = 1 / n + (u * u) @ shrink
                        error = (y - y_mean)[:, None] - u @ (right[:, None] * shrink)
                        out[m] += w[:, b] @ (error / np.maximum(1 - lever, 1e-12)) ** 2
        return out

    errors = summed(data, left_out)
    for t, trait in enumerate(traits):
        for b in range(n_bags):
            if (m := t * n_bags + b) not in solved:
                continue
            n, mean, y_mean, std, values, vectors, right = solved[m]
            alpha = ALPHAS[int(np.argmin(errors[m]))]
            weights = vectors @ (right / (values + alpha)) / std
            trait.bags.append(Linear(weights, float(y_mean - weights @ (mean + trait.medians[trait.places])), float(alpha), errors[m] / n))


# --- trees -----------------------------------------------------------------------------------------------------------


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of each value: how many edges of its feature are below it."""
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8) if x.shape[1] else np.zeros(x.shape, np.uint8)


def _leaf(bins: np.ndarray, features: np.ndarray, at: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The node, numbered within its depth, that each row reaches."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for d in range(int(np.log2(len(features) + 1)) if depth is None else depth):
        i = node + 2**d - 1
        node = 2 * node + (bins[rows, features[i]] > at[i])
    return node


def _drawn(u: np.ndarray, model: int, turn: int) -> np.ndarray:
    """Which rows a round sees, by hash."""
    with np.errstate(over="ignore"):
        x = u.view(np.uint64) + np.uint64(model * 100_003 + turn + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < SUBSAMPLE


def _best(hist: np.ndarray) -> tuple[int, int, float]:
    """(feature, bin, gain) of the best split of one node's (weights, residuals) by feature and bin; gain 0 without one."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(axis=2)[:, :, None]
    w, r, w2, r2 = left[0], left[1], total[0] - left[0], total[1] - left[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((w > 0) & (w2 > 0), w * w2 / (w + w2) * (r / w - r2 / w2) ** 2, 0.0)
    # the first of equal ones, whatever the order of the sums
    f, b = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape)
    return int(f), int(b), float(gain[f, b])


def _boosted(data: DataFrame, traits: list[Trait], n_bags: int, width: int, trees: int) -> DataFrame:
    """Fills the bags of traits; the rows with scores, the models' predictions of every row."""
    step = [(i + 1) / BINS for i in range(BINS - 1)]
    value = lambda i: F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)))
    found = data.agg(*(F.percentile_approx(value(i), step, 10_000).alias(f"e{i}") for i in range(width))).first()
    edges = [np.array(sorted(set(found[i] or [])), dtype=float) for i in range(width)]
    filled = np.array([np.concatenate([e, np.full(BINS - 1 - len(e), np.inf)]) for e in edges]).reshape(width, BINS - 1)
    n_models = len(traits) * n_bags
    medians = [np.array([np.searchsorted(filled[i], v, "left") for i, v in enumerate(t.medians)], np.uint8) for t in traits]

    def means(batches):
        out = {m: np.zeros(2) for m in range(n_models)}
        for batch in batches:
            y, w = _doubles(batch, "y", len(traits)), _doubles(batch, "w", n_bags)
            for t in range(len(traits)):
                some = ~np.isnan(y[:, t])
                for b in range(n_bags):
                    out[t * n_bags + b] += [w[some, b].sum(), w[some, b] @ y[some, t]]
        return out

    start = summed(data, means)
    models = [Trees(float(s[1] / s[0]) if (s := start.get(m, np.zeros(2)))[0] else 0.0, filled[traits[m // n_bags].places], [], np.zeros(len(traits[m // n_bags].places))) for m in range(n_models)]

    def bins_of(batch: pa.RecordBatch, column: str = "bins") -> list[np.ndarray]:
        """The bins of each target's features, its medians where a value is missing."""
        raw = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(column)).to_pylist()), np.uint8).reshape(-1, width)
        return [np.where(raw == 255, medians[t], raw)[:, trait.places] for t, trait in enumerate(traits)]

    def prepared(batches):
        for batch in batches:
            x = _doubles(batch, "x", width)
            bins = np.where(np.isnan(x), 255, _binned(np.where(np.isnan(x), 0.0, x), filled)).astype(np.uint8)
            base = np.tile([m.start for m in models], (len(x), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([r.tobytes() for r in base], pa.binary())], ["y", "w", "u", "bins", "scores"])

    schema = "y array<double>, w array<double>, u long, bins binary, scores binary"

    def moved(new: list[list[tuple]]):
        """The rows with the scores of further trees added."""

        def task(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in scored(batch, new)], pa.binary())], batch.schema.names)

        return task

    def scored(batch: pa.RecordBatch, new: list[list[tuple]]) -> np.ndarray:
        scores = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("scores")).to_pylist())).reshape(-1, n_models).copy()
        bins = bins_of(batch)
        for m, later in enumerate(new):
            for f, b, v in later:
                scores[:, m] += v[_leaf(bins[m // n_bags], f, b)]
        return scores

    def histograms(new: list[list[tuple]], grown: list[tuple[np.ndarray, np.ndarray]], depth: int, turn: int):
        sizes = [(2, 2**depth, len(traits[m // n_bags].places), BINS) for m in range(n_models)]

        def part(batches):
            out = {m: np.zeros(int(np.prod(s))) for m, s in enumerate(sizes)}
            for batch in batches:
                scores, bins = scored(batch, new), bins_of(batch)
                y, w, u = _doubles(batch, "y", len(traits)), _doubles(batch, "w", n_bags), batch.column(batch.schema.get_field_index("u")).to_numpy(zero_copy_only=False)
                for m, (f, b) in enumerate(grown):
                    t, bag = divmod(m, n_bags)
                    use = np.flatnonzero((w[:, bag] > 0) & ~np.isnan(y[:, t]) & _drawn(u, m, turn))
                    mine, weight, p = bins[t][use], w[use, bag], len(traits[t].places)
                    place = ((_leaf(mine, f, b, depth)[:, None] * p + np.arange(p)) * BINS + mine).ravel()
                    cells = 2**depth * p * BINS
                    out[m][:cells] += np.bincount(place, np.repeat(weight, p), cells)
                    out[m][cells:] += np.bincount(place, np.repeat(weight * (y[use, t] - scores[use, m]), p), cells)
            return out

        return {m: a.reshape(sizes[m]) for m, a in summed(rows, part).items()}

    rows, new = written(data.select("x", "y", "w", "u").mapInArrow(prepared, schema)), [[] for _ in models]
    inner = 2**DEPTH - 1
    for turn in range(trees):
        grown = [(np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)) for _ in models]
        values = [np.zeros(2**DEPTH) for _ in models]
        for depth in range(DEPTH):
            for m, hist in histograms(new, grown, depth, turn).items():
                for node in range(2**depth):
                    f, b, gain = _best(hist[:, node]) if hist.shape[2] else (0, 0, 0.0)
                    if gain > 1e-12:
                        grown[m][0][node + 2**depth - 1], grown[m][1][node + 2**depth - 1] = f, b
                        models[m].gains[f] += gain
                    if depth == DEPTH - 1 and hist.shape[2]:
                        w, r = hist[:, node, f]
                        sides = ((w[: b + 1].sum(), r[: b + 1].sum()), (w[b + 1 :].sum(), r[b + 1 :].sum())) if gain > 1e-12 else ((w.sum(), r.sum()), (0.0, 0.0))
                        values[m][2 * node : 2 * node + 2] = [RATE * s / n if n > 0 else 0.0 for n, s in sides]
        for m, model in enumerate(models):
            model.trees.append((*grown[m], values[m]))
            new[m].append(model.trees[-1])
        if (turn + 1) % STATE_ROUNDS == 0:
            rows, new = written(rows.mapInArrow(moved(new), schema)), [[] for _ in models]
    for m, model in enumerate(models):
        model.gains /= model.gains.sum() or 1.0
        traits[m // n_bags].bags.append(model)
    return rows.mapInArrow(moved(new), schema)


# --- fitting and scoring ---------------------------------------------------------------------------------------------


def fit_traits(df: DataFrame, key: str, golds: Mapping[str, Sequence[str]], bags: int = 5, trees: int = 300, least: int = 5, seed: int = 42, algorithm: str = "trees", calibrate: bool = True) -> dict[str, Trait]:
    """A trait for each target column of golds (target -> its features; one that is there twice counts twice).

    A target needs least labels. Missing features take the median of the target's labelled rows. With calibrate, rows that a
    bag left out make the mean monotone, if there are more than ten.
    """
    if algorithm not in ("trees", "ridge"):
        raise ValueError(algorithm)
    names = list(dict.fromkeys(n for ns in golds.values() for n in ns))
    labels = list(golds)
    y = F.array(*(F.coalesce(F.col(f"`{g}`").cast("double"), F.lit(float("nan"))) for g in labels))
    draws = lambda u: sum(((u >= x).cast("double") for x in POISSON), F.lit(0.0))
    weights = F.array(*(once(unit_hash(f"{seed}:{i}", F.col(key)), draws) for i in range(bags)))
    data = df.select(_features(names).alias("x"), y.alias("y"), weights.alias("w"), F.xxhash64(F.lit(seed + 1), key).alias("u"))
    data = written(data.where(F.exists("y", lambda v: ~F.isnan(v))))
    known = lambda a, i: F.when(~F.isnan(F.get(a, F.lit(i))), F.get(a, F.lit(i)))
    found = data.agg(
        *(f(known("y", t)).alias(f"{n}{t}") for t in range(len(labels)) for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))),
        *(F.percentile_approx(F.when(known("y", t).isNotNull(), known("x", i)), 0.5, 10_000).alias(f"m{t}_{i}") for t in range(len(labels)) for i in range(len(names))),
    ).first()
    kept = [t for t in range(len(labels)) if found[f"n{t}"] >= least]
    if not kept:
        return {}
    traits = [Trait(names, [names.index(n) for n in golds[labels[t]]], np.array([found[f"m{t}_{i}"] or 0.0 for i in range(len(names))]), []) for t in kept]
    data = data.withColumn("y", F.array(*(F.get("y", F.lit(t)) for t in kept)))
    if algorithm == "ridge":
        _ridges(data, traits, bags, len(names))
        predict, width = _predictor(traits), [len(t.bags) for t in traits]
        judged = data.select("y", "w", predict(F.col("x")).alias("p"))
    else:
        read = F.pandas_udf(lambda s: pd.Series([np.frombuffer(b) for b in s]), ArrayType(DoubleType()))
        judged, width = _boosted(data, traits, bags, len(names), trees).select("y", "w", read("scores").alias("p")), [bags] * len(traits)
    judged, at = written(judged), np.concatenate([[0], np.cumsum(width)])
    for t, trait in enumerate(traits):
        left = [(F.get("w", F.lit(b)) == 0).cast("double") for b in range(width[t])]
        sums = sum((x * F.get("p", F.lit(int(at[t]) + b)) for b, x in enumerate(left)), F.lit(0.0))
        held = judged.select(F.get("y", F.lit(t)).alias("label"), F.try_divide(sums, sum(left, F.lit(0.0))).alias("oob")).where("oob is not null and not isnan(label)")
        r = held.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("oob") - F.col("label"))).alias("mae")).first()
        trait.isotonic = IsotonicRegression(featuresCol="oob", labelCol="label").fit(held) if calibrate and r.n > 10 else None
        trait.stats = {"n": float(found[f"n{kept[t]}"]), "oob_mae": r.mae or 0.0, "y_mean": found[f"mean{kept[t]}"], "y_std": found[f"std{kept[t]}"]}
    return {labels[t]: trait for t, trait in zip(kept, traits)}


def _predictor(traits: Sequence[Trait]):
    """A function of the column of features: array<double> with the bags of all traits, in order."""
    plain = [Trait(t.names, t.places, t.medians, t.bags) for t in traits]  # without what stays in the JVM

    @F.pandas_udf(ArrayType(DoubleType()))
    def predict(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(plain[0].names)))
        return pd.Series(list(np.concatenate([t.bag_scores(rows) for t in plain], axis=1)))

    return predict


def _squares(values: Column, about: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - about) * (v - about))


def trait_scores(traits: Mapping[str, Trait], df: DataFrame, key: str) -> DataFrame:
    """(key, <name>, <name>__std ...): means over the bags, made monotone where that was fitted. One pass for all traits."""
    if not traits:
        return df.select(key)
    names = next(iter(traits.values())).names
    d = df.select(key, _features(names).alias("_x"))
    d = d.select(key, _predictor(list(traits.values()))(F.col("_x")).alias("_p"))
    at = 0
    for name, t in traits.items():
        n = len(t.bags)
        own = F.slice("_p", at + 1, n)
        mean = F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / n
        d = d.withColumn(name, mean)
        d = d.withColumn(f"{name}__std", F.sqrt(_squares(own, F.col(name)) / n))
        if t.isotonic:
            made = t.isotonic.copy().setFeaturesCol(name).setPredictionCol(f"{name}__made")
            d = made.transform(d).drop(name).withColumnRenamed(f"{name}__made", name)
        at += n
    return d.select(key, *(c for name in traits for c in (name, f"{name}__std")))
