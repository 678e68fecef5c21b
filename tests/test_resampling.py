"""Exact resampling: counts that sum to the rows, and intervals like those of drawing rows one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import evaluation, resampling


def qwk(i, j):
    lo, hi = min(i.min(), j.min()), max(i.max(), j.max())
    k = int(hi - lo + 1)
    seen = np.zeros((k, k))
    np.add.at(seen, ((i - lo).astype(int), (j - lo).astype(int)), 1)
    w = (np.arange(k)[:, None] - np.arange(k)) ** 2
    expected = np.outer(seen.sum(axis=1), seen.sum(axis=0)) / seen.sum()
    return 1 - (w * seen).sum() / (w * expected).sum()


def scores(n=400, seed=4):
    rng = np.random.default_rng(seed)
    gold = np.clip(np.rint(rng.normal(6, 2, n) * 4) / 4, 0, 10)
    a = np.clip(np.rint((gold + rng.normal(0.2, 1, n)) * 4) / 4, 0, 10)
    b = np.clip(np.rint((gold + rng.normal(0, 0.7, n)) * 4) / 4, 0, 10)
    return gold, a, b


def frame(spark, *columns):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(*columns))], "id int, gold double, a double, b double")


def test_draws_of_the_buckets_sum_to_the_rows():
    sizes = np.array([5, 0, 1000, 3, 7, 7, 0, 78])
    tree = resampling.halved(sizes)
    draws = np.array([resampling.draws_of(tree, b, 500, 9) for b in range(8)])
    assert (draws.sum(axis=0) == 1100).all() and (draws[[1, 6]] == 0).all()
    assert draws.mean(axis=1) == pytest.approx(sizes, rel=0.05, abs=0.4)
    assert draws[2].var() == pytest.approx(1100 * (1000 / 1100) * (100 / 1100), rel=0.25)
    assert np.corrcoef(draws[2], draws[7])[0, 1] < -0.5  # more here is less there


@pytest.mark.parametrize("cells", [2000, 10])
def test_intervals_are_those_of_drawing_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(resampling, "BUCKET_CELLS", cells)  # one bucket, and many
    gold, a, b = scores()
    df = frame(spark, gold, a, b)
    got = {r.metric: r for r in resampling.score_intervals(df, "gold", "a").collect()}
    rng, draws = np.random.default_rng(0), [None] * 2000
    for k in range(2000):
        at = rng.integers(0, len(gold), len(gold))
        e = a[at] - gold[at]
        draws[k] = (np.abs(e).mean(), np.sqrt((e * e).mean()), e.mean(), (e == 0).mean(), (np.abs(e) <= 1).mean(), qwk(gold[at] * 4, a[at] * 4))
    e = a - gold
    point = (np.abs(e).mean(), np.sqrt((e * e).mean()), e.mean(), (e == 0).mean(), (np.abs(e) <= 1).mean(), qwk(gold * 4, a * 4))
    for m, (name, values) in enumerate(zip(("mae", "rmse", "bias", "exact", "within_1", "qwk"), np.array(draws).T)):
        r = got[name]
        low, high = np.quantile(values, [0.025, 0.975])
        assert r.estimate == pytest.approx(point[m]) and r.n_valid == 1000
        assert abs(r.low - low) < 0.12 * (high - low) and abs(r.high - high) < 0.12 * (high - low), name


def test_replicates_do_not_depend_on_partitions_and_count_all_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET_CELLS", 20)
    df = frame(spark, *scores())
    sums = {"e": F.col("a") - F.col("gold"), "k": F.col("id") % 7}
    whole, some = resampling.resampled(df.repartition(1), sums, 50)
    again, other = resampling.resampled(df.repartition(7), sums, 50)
    assert whole == pytest.approx(again) and all(some[k] == pytest.approx(other[k]) for k in some)
    assert (some["n"] == 400).all() and len(set(some["k"])) > 20
    assert any((resampling.resampled(df, sums, 50, seed=1)[1]["k"] != some["k"]).tolist())


def test_paired_scores_share_their_draws(spark):
    gold, a, b = scores()
    df = frame(spark, gold, a, b)
    got = {r.metric: r for r in resampling.delta_intervals(df, "gold", "a", "b").collect()}
    d = np.abs(b - gold) - np.abs(a - gold)
    rng = np.random.default_rng(1)
    low, high = np.quantile(d[rng.integers(0, 400, (2000, 400))].mean(axis=1), [0.025, 0.975])
    r = got["delta_mae"]
    assert r.estimate == pytest.approx(d.mean()) and abs(r.low - low) < 0.12 * (high - low) and abs(r.high - high) < 0.12 * (high - low)
    assert got["delta_qwk"].estimate == pytest.approx(qwk(gold * 4, b * 4) - qwk(gold * 4, a * 4)) and got["delta_qwk"].low > 0
    same = resampling.delta_intervals(df, "gold", "a", "a").collect()
    assert all(r.estimate == r.low == r.high == 0 for r in same)


def test_odd_tables(spark):
    df = frame(spark, *scores(20))
    none = {r.metric: r for r in resampling.score_intervals(df.where("false"), "gold", "a").collect()}
    assert none["mae"].estimate is None and none["mae"].low is None and none["mae"].n_valid == 0
    one = {r.metric: r for r in resampling.score_intervals(df.limit(1), "gold", "gold").collect()}
    assert one["mae"].high == 0 and one["qwk"].n_valid == 0  # one label has no spread
    holes = df.withColumn("a", F.when(F.col("id") < 10, F.col("a")))
    got = {r.metric: r for r in resampling.score_intervals(holes, "gold", "a").collect()}
    assert got["mae"].estimate == pytest.approx(df.where("id < 10").agg(F.avg(F.abs(F.col("a") - F.col("gold")))).first()[0])
    hot = df.limit(1).crossJoin(spark.range(50_000).select()).withColumn("id", F.lit(1)).unionByName(df)
    got = evaluation.bootstrap(hot, {"gold": F.col("gold")}, 20).first()  # one cell holds nearly all rows
    assert got.low <= got.estimate <= got.high and got.n_valid == 20
