"""Bagged ridges and boosted trees against plain versions that see all rows at once."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import traits

SCHEMA = "id int, a double, b double, c double, g double, h double"


def rows(n=48, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b, c = rng.normal(5, 2), rng.normal(-3, 0.5), float(rng.integers(0, 4))
        g = 2 * a - b + 0.3 * c + rng.normal(0, 0.4)
        out.append((i, float(a), None if i % 9 == 0 else float(b), math.nan if i % 11 == 0 else c, None if i % 7 == 0 else float(g), float(a * c) if i % 3 else None))
    return out


def weights(i, bag, seed=42):
    u = int(hashlib.sha256(f"{seed}:{bag}:{i}".encode()).hexdigest()[:12], 16) / 16.0**12
    return sum(u >= x for x in traits.POISSON)


def plain_data(data, target, names=(1, 2, 3)):
    some = [r for r in data if r[target] is not None]
    x = np.array([[math.nan if r[j] is None else r[j] for j in names] for r in some])
    lower_median = lambda v: sorted(v)[(len(v) - 1) // 2]
    medians = [lower_median([v for v in c if not math.isnan(v)]) for c in x.T]
    return [r[0] for r in some], np.where(np.isnan(x), medians, x), np.array([r[target] for r in some]), np.array(medians)


@pytest.mark.parametrize("parts", [1, 5])
def test_ridge_weights_and_left_out_errors(spark, parts):
    data = rows()
    found = traits.fit_traits(spark.createDataFrame(data, SCHEMA).repartition(parts), "id", {"g": ["a", "b", "c", "a"], "h": ["a", "b", "c"]}, bags=2, algorithm="ridge")
    for target, column, places in (("g", 4, [0, 1, 2, 0]), ("h", 5, [0, 1, 2])):
        ids, x, y, _ = plain_data(data, column)
        x = x[:, places]
        for bag, model in enumerate(found[target].bags):
            w = np.array([weights(i, bag) for i in ids])
            mean, y_mean = np.average(x, axis=0, weights=w), np.average(y, weights=w)
            z = (x - mean) / np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
            rep = np.repeat(np.arange(len(y)), w)  # a row a copy

            def solve(zs, ys, alpha):
                d = np.column_stack([zs, np.ones(len(zs))])
                return np.linalg.solve(d.T @ d + np.diag([alpha] * zs.shape[1] + [0]), d.T @ ys)

            errors = []
            for alpha in traits.ALPHAS:
                squares = []
                for k in range(len(rep)):
                    rest = np.delete(rep, k)
                    squares.append((y[rep[k]] - np.append(z[rep[k]], 1) @ solve(z[rest], y[rest], alpha)) ** 2)
                errors.append(np.mean(squares))
            assert model.errors == pytest.approx(errors, rel=1e-6)
            assert model.alpha == traits.ALPHAS[int(np.argmin(errors))]
            assert model(x) == pytest.approx(np.column_stack([z, np.ones(len(z))]) @ solve(z[rep], y[rep], model.alpha), rel=1e-6)


def test_ridge_is_that_of_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = [(i, float(i % 5), float(i % 3), 1.0, float(3 * (i % 5) + i % 4), None) for i in range(50)]
    df = spark.createDataFrame(data, SCHEMA)
    model = traits.fit_traits(df, "id", {"g": ["a", "b"]}, bags=1, algorithm="ridge")["g"].bags[0]
    w = np.array([weights(i, 0) for i in range(50)], dtype=float)
    x = np.array([r[1:3] for r in data])
    mean = np.average(x, axis=0, weights=w)
    std = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    scaled = [(*map(float, (r - mean) / std), float(k), d[4]) for r, k, d in zip(x, w, data) if k]
    d = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(scaled, "a double, b double, w double, g double"))
    y = np.array([r[4] for r in data])
    spread = np.sqrt(np.average((y - np.average(y, weights=w)) ** 2, weights=w))  # the library divides its penalty by this
    got = LinearRegression(labelCol="g", weightCol="w", regParam=model.alpha / w.sum() * spread, standardization=False, solver="normal").fit(d)
    assert model.weights * std == pytest.approx(got.coefficients.toArray(), rel=1e-6)
    assert model.intercept == pytest.approx(got.intercept - got.coefficients.toArray() @ (mean / std), rel=1e-6)


def plain_trees(ids, x, y, w, edges, turns, model, hashes):
    """One bag of boosted trees, node by node over lists of rows."""
    bins = np.array([[sum(v > e for e in es) for v, es in zip(r, edges)] for r in x])
    score = np.full(len(y), np.average(y, weights=w))
    for turn in range(turns):
        use = (w > 0) & traits._drawn(np.array([hashes[i] for i in ids], dtype=np.int64), model, turn)
        add = np.zeros(len(y))

        def grow(members, depth):
            mine = members & use
            r, k = (y - score)[mine], w[mine]
            value = traits.RATE * (k @ r) / k.sum() if k.sum() else 0.0
            best = (1e-12, None)
            if depth < traits.DEPTH:
                for f in range(x.shape[1]):
                    for b in range(traits.BINS - 1):
                        left = bins[mine, f] <= b
                        wl, wr = k[left].sum(), k[~left].sum()
                        if wl > 0 and wr > 0:
                            gain = wl * wr / (wl + wr) * ((k[left] @ r[left]) / wl - (k[~left] @ r[~left]) / wr) ** 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, (f, b))
            if best[1] is None:
                add[members] = value
                return
            f, b = best[1]
            grow(members & (bins[:, f] <= b), depth + 1)
            grow(members & (bins[:, f] > b), depth + 1)

        grow(np.ones(len(y), bool), 0)
        score = score + add
    return score


def test_trees_are_those_of_a_plain_version_whatever_the_partitions(spark):
    data = rows(60)
    df = spark.createDataFrame(data, SCHEMA)
    golds = {"g": ["a", "b", "c"], "h": ["a", "c"]}
    several = traits.fit_traits(df.repartition(6), "id", golds, bags=2, trees=4)
    hashes = {r.id: r.u for r in df.select("id", F.xxhash64(F.lit(43), "id").alias("u")).collect()}
    for t, (target, column, names) in enumerate((("g", 4, (1, 2, 3)), ("h", 5, (1, 3)))):
        ids, x, y, _ = plain_data(data, column, names)
        for bag, model in enumerate(several[target].bags):
            w = np.array([weights(i, bag) for i in ids])
            edges = [[e for e in es if np.isfinite(e)] for es in model.edges]
            assert model(x) == pytest.approx(plain_trees(ids, x, y, w, edges, 4, 2 * t + bag, hashes), rel=1e-6)
    one = traits.fit_traits(df.repartition(1), "id", golds, bags=2, trees=4)
    got = [{r.id: (r.g, r.h__std) for r in traits.trait_scores(f, df, "id").collect()} for f in (several, one)]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k]) for k in got[0])


def test_scores_pass_over_written_state_and_learn(spark, monkeypatch):
    monkeypatch.setattr(traits, "STATE_ROUNDS", 3)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 2), 0.0, float((i % 7) ** 2), None) for i in range(90)], SCHEMA)
    found = traits.fit_traits(df, "id", {"g": ["a", "b"]}, bags=2, trees=40)["g"]
    assert found.stats["n"] == 90 and found.stats["oob_mae"] < 0.4 * found.stats["y_std"]
    assert found.importance()[0][0] == "a" and "out-of-bag" in traits.report({"g": found})
    got = found.scores(df, "id").join(df, "id").agg(F.avg(F.abs(F.col("mean") - F.col("g")))).first()[0]
    assert got < 3


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext.setJobGroup("tests", "tests")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("algorithm", ["ridge", "trees"])
def test_jobs_do_not_grow_with_targets_and_bags(spark, algorithm):
    df = spark.createDataFrame(rows(), SCHEMA)
    fit = lambda golds, bags: traits.fit_traits(df, "id", golds, bags=bags, trees=2, algorithm=algorithm, calibrate=False)
    one = jobs(spark, f"one-{algorithm}", lambda: fit({"g": ["a"]}, 1))
    many = jobs(spark, f"many-{algorithm}", lambda: fit({"g": ["a", "b"], "h": ["a"], "c": ["b"]}, 4))
    assert one <= many <= one + 6  # a look at each further target's error


def test_odd_targets(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert traits.fit_traits(df.where("false"), "id", {"g": ["a"]}) == {} and traits.trait_scores({}, df, "id").columns == ["id"]
    with pytest.raises(ValueError, match="forest"):
        traits.fit_traits(df, "id", {"g": ["a"]}, algorithm="forest")
    blank = spark.createDataFrame([(i, 1.0, None, math.nan, float(i), None) for i in range(12)], SCHEMA)
    for algorithm in ("ridge", "trees"):  # constant and empty features give the mean
        found = traits.fit_traits(blank, "id", {"g": ["a", "b", "c"]}, bags=1, trees=2, algorithm=algorithm, calibrate=False)["g"]
        got = {round(r.mean, 6) for r in found.scores(blank, "id").collect()}
        assert len(got) == 1 and 0 <= got.pop() <= 11
