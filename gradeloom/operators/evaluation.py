"""Accuracy, fairness and review efficiency of predicted scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .agreement import bins, pearson, qwk
from .resampling import mean_intervals


def smd(a: str, b: str) -> Column:
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when(pooled > 0, (F.avg(b) - F.avg(a)) / pooled).otherwise(0.0)


def metrics(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), step: float = 0.25, tol: float = 1.0) -> DataFrame:
    """One row a group: n, mae, rmse, exact and adjacent agreement, smd, bias, pearson, deviations and their ratio, qwk."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = F.col(a) - F.col(b)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((bins(F.col(a), step) == bins(F.col(b), step)).cast("double")).alias("exact_agreement"),
        F.avg((F.abs(e) <= tol).cast("double")).alias("adjacent_agreement"),
        smd(a, b).alias("smd"),
        F.avg(-e).alias("bias"),
        pearson(a, b).alias("pearson"),
        F.stddev_pop(b).alias("pred_std"),
        F.stddev_pop(a).alias("true_std"),
        F.when(F.stddev_pop(a) > 0, F.stddev_pop(b) / F.stddev_pop(a)).alias("std_ratio"),
    )
    kappa = qwk(rows, a, b, by, step).drop("n")
    return out.join(kappa, list(by)) if by else out.join(F.broadcast(kappa))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(spearman): Pearson's correlation of average ranks. Ranks come from the counts of distinct values."""

    def ranks(c: str, name: str) -> DataFrame:
        counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(c).alias(name)).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(name)) - F.col("n")  # one row a distinct score
        return counts.select(name, (before + (F.col("n") + 1) / 2).alias(f"{name}_rank"))

    both = df.join(ranks(a, "_a"), F.col(a) == F.col("_a")).join(ranks(b, "_b"), F.col(b) == F.col("_b"))
    return both.agg(pearson("_a_rank", "_b_rank").alias("spearman"))


def review_efficiency(df: DataFrame, a: str, b: str, review: Column, by: tuple[str, ...] = (), tol: float = 1.0) -> DataFrame:
    rows = df.withColumn("_err", (F.abs(F.col(a) - F.col(b)) > tol).cast("double")).withColumn("_rev", review.cast("double"))
    err, rev, n = F.sum("_err"), F.sum("_rev"), F.count("*")
    both, auto = F.sum(F.col("_err") * F.col("_rev")), F.sum(1 - F.col("_rev"))
    return rows.groupBy(*by).agg(
        (rev / n).alias("review_rate"),
        (err / n).alias("error_rate_overall"),
        F.coalesce(F.try_divide(err - both, auto), F.lit(0.0)).alias("error_rate_auto_accepted"),
        F.coalesce(F.try_divide(both, err), F.lit(1.0)).alias("recall_of_errors"),
        F.coalesce(F.try_divide(both, rev), F.lit(0.0)).alias("precision_of_review"),
        auto.alias("n_auto_accepted"),
        (auto / n).alias("workload_saved"),
    )


#: Thresholds from 0.3 on in steps of 0.05, added up in floating point: a confidence of 0.6 lies below the seventh.
GRID = tuple(float(x) for x in np.arange(0.30, 0.96, 0.05))


def threshold_curve(df: DataFrame, a: str, b: str, confidence: str, tol: float = 1.0, grid=GRID) -> DataFrame:
    """review_efficiency() at each threshold: rows meet the fixed grid as an array, aggregated before any shuffle."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in grid))).alias("threshold")
    return review_efficiency(df.select(a, b, confidence, at), a, b, F.col(confidence) < F.col("threshold"), ("threshold",), tol)


def suggest_threshold(curve: DataFrame, target: float = 0.15, min_recall: float = 0.80) -> DataFrame:
    """The least review rate that still finds enough errors; without one, the rate nearest to the target."""
    ok = F.col("recall_of_errors") >= min_recall
    order = F.struct((~ok).cast("int"), F.when(ok, F.col("review_rate")).otherwise(F.abs(F.col("review_rate") - target)), F.col("threshold"))
    return curve.agg(F.min_by(F.struct(*curve.columns), order).alias("s")).select("s.*")


def fairness(df: DataFrame, group: str, a: str, b: str, least: int = 10) -> DataFrame:
    found = metrics(df, a, b, (group,)).where(F.col("n") >= least)
    best = F.min("mae").over(Window.partitionBy(F.lit(0)))  # one row a group
    return found.select(group, "n", "qwk", "mae", "smd", "bias", (F.abs("smd") > 0.25).alias("warn_bias"), (F.col("mae") > best + 0.5).alias("warn_mae"))


def by_split(df: DataFrame, a: str, b: str, split: str, exam: str) -> DataFrame:
    """mae, bias and n by split and by split and exam, in one pass of grouping sets."""
    e = F.col(b) - F.col(a)
    return df.groupingSets([[F.col(split)], [F.col(split), F.col(exam)]], F.col(split), F.col(exam)).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def human_benchmark(machine: DataFrame, human: DataFrame, least: float = 0.90) -> DataFrame:
    """(machine_qwk, human_qwk, ratio, passed) of two one-row frames with qwk."""
    both = machine.agg(F.max("qwk").alias("machine_qwk")).join(F.broadcast(human.agg(F.max("qwk").alias("human_qwk"))))
    ratio = F.coalesce(F.try_divide("machine_qwk", "human_qwk"), F.lit(0.0))
    return both.withColumns({"ratio": ratio, "passed": ratio >= least})


def per_criterion(df: DataFrame, pairs: dict[str, tuple[str, str]], by: tuple[str, ...] = (), least: int = 5) -> DataFrame:
    """metrics() of each criterion (name to gold and predicted column) with enough scores; one pass over all."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")) for k, (a, b) in pairs.items())))
    return metrics(df.select(*by, each.alias("s")).select(*by, "s.*"), "_a", "_b", ("criterion", *by)).where(F.col("n") >= least)


def length_bias(df: DataFrame, key: str, length: str, a: str, b: str, n_bins: int = 4) -> DataFrame:
    """fairness() over quantile bins of length."""
    from .sampling import quantile_bins

    return fairness(quantile_bins(df, length, key, n_bins, "length_bin"), "length_bin", a, b)


def totals(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), step: float = 0.25) -> DataFrame:
    """n, mae, rmse, qwk over observed labels, pearson, bias, exact agreement up to half a step; null where not defined."""
    from .agreement import qwk_observed

    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = F.col(b) - F.col(a)
    close = F.abs(e) <= step / 2 - 1e-4 + 1e-5 * F.abs(F.col(b))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), pearson(a, b).alias("pearson"), F.avg(e).alias("bias"), F.avg(close.cast("double")).alias("exact_agreement"))
    kappa = qwk_observed(rows, a, b, by, step).drop("n")
    return out.join(kappa, list(by), "left") if by else out.join(F.broadcast(kappa), F.lit(True), "left")


def fixed_labels_qwk(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), top: float = 10.0, step: float = 0.25) -> DataFrame:
    """(by..., n, qwk) over the labels 0, step ... top whether they occur or not: null where both sides have one label only, and outside them."""
    from .agreement import qwk

    rows = df.where(F.col(a).between(0, top) & F.col(b).between(0, top))
    sides = rows.groupBy(*by).agg((F.min(F.least(F.rint(F.col(a) / step), F.rint(F.col(b) / step))) == F.max(F.greatest(F.rint(F.col(a) / step), F.rint(F.col(b) / step)))).alias("_one"))
    out = qwk(rows, a, b, by, step)
    both = out.join(sides, list(by)) if by else out.join(F.broadcast(sides))
    return both.select(*by, "n", F.when(~F.col("_one"), F.col("qwk")).alias("qwk"))


#: The experiments of an ablation: what each one uses. Fixed values.
ABLATION = (
    {"experiment_id": "A", "encoder": "tfidf", "uses": ("feature_model",)},
    {"experiment_id": "B", "encoder": "phobert", "uses": ("feature_model",)},
    {"experiment_id": "C", "encoder": "none", "uses": ("vistral",)},
    {"experiment_id": "D", "encoder": "none", "uses": ("vistral", "anchors")},
    {"experiment_id": "E", "encoder": "none", "uses": ("vistral", "anchors", "rag")},
    {"experiment_id": "F", "encoder": "none", "uses": ("vistral", "qlora")},
    {"experiment_id": "G", "encoder": "none", "uses": ("vistral", "qlora", "rag")},
    {"experiment_id": "H", "encoder": "phobert", "uses": ("feature_model", "vistral", "qlora", "rag", "anchors", "self_consistency")},
)
PARTS = ("feature_model", "vistral", "qlora", "rag", "anchors", "self_consistency")


def ablation_plan(spark: SparkSession, experiments: tuple[dict, ...] = ABLATION, seed: int = 42) -> DataFrame:
    """(experiment_id, encoder, use_<part>..., use_rule_engine, seed), one row an experiment."""
    rows = [(e["experiment_id"], e["encoder"], *(p in e["uses"] for p in PARTS), True, seed) for e in experiments]
    return spark.createDataFrame(rows, "experiment_id string, encoder string, " + "".join(f"use_{p} boolean, " for p in PARTS) + "use_rule_engine boolean, seed int")


def predictions(spark: SparkSession, folder: str, pattern: str = "pred_*.csv") -> DataFrame:
    """Rows of all prediction files of a folder, with experiment_id from the file's name."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", pattern).csv(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return d.withColumn("experiment_id", F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^pred_", ""))


def ablation_summary(pred: DataFrame, gold: DataFrame, key: str, pred_column: str, gold_column: str) -> DataFrame:
    """metrics() of each experiment over the essays that have a label: one join and one pass for all of them."""
    g = gold.select(F.col(key).cast("string").alias("_k"), F.col(gold_column).cast("double").alias("_g"))
    both = pred.withColumn("_p", F.col(pred_column).cast("string").try_cast("double")).join(g, F.col(key).cast("string") == F.col("_k"))
    return metrics(both, "_g", "_p", ("experiment_id",))


def paired_interval(before: DataFrame, after: DataFrame, key: str, value: str, n: int = 1000) -> DataFrame:
    """(metric, estimate, low, high, n_valid): bootstrap() of the mean of paired_delta()."""
    return bootstrap(paired_delta(before, after, key, value), {"delta": F.col("delta")}, n)


def feedback_similarity(pred: DataFrame, gold: DataFrame, key: str, text: str, score) -> DataFrame:
    """(n, precision, recall, f1): means over pairs of feedback texts, by a function that scores them in the tasks.

    score: (candidates, references) -> three lists of numbers, such as a client of an embedding model.
    """
    both = pred.select(key, F.coalesce(F.col(text), F.lit("")).alias("a")).join(gold.select(key, F.coalesce(F.col(text), F.lit("")).alias("b")), key)

    @F.pandas_udf("p double, r double, f double")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        p, r, f = score(a.tolist(), b.tolist())
        return pd.DataFrame({"p": p, "r": r, "f": f})

    return both.select(scored("a", "b").alias("s")).agg(F.count("*").alias("n"), F.avg("s.p").alias("precision"), F.avg("s.r").alias("recall"), F.avg("s.f").alias("f1"))


def median_runs(df: DataFrame, key: str, run: str, total: str) -> DataFrame:
    """(key, total, run_std, n_runs): the median of an essay's runs and their spread."""
    return df.groupBy(key).agg(F.percentile(total, F.lit(0.5)).alias("total"), F.coalesce(F.stddev_samp(total), F.lit(0.0)).alias("run_std"), F.count(total).alias("n_runs"))


def test_retest(median: DataFrame, tol: float = 0.25) -> DataFrame:
    """(n_essays, mean_run_std, max_run_std, stable_share) over median_runs(); the figures are null if no essay has two runs."""
    repeated = F.max("n_runs") > 1
    return median.agg(
        F.count("*").alias("n_essays"),
        F.when(repeated, F.avg("run_std")).alias("mean_run_std"),
        F.when(repeated, F.max("run_std")).alias("max_run_std"),
        F.when(repeated, F.avg((F.col("run_std") <= tol).cast("double"))).alias("stable_share"),
    )


def bootstrap(df: DataFrame, columns: dict[str, Column], n: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, estimate, low, high, n_valid): percentile intervals of means over exact resamples, see resampling."""
    return mean_intervals(df, columns, n, seed, level)


def paired_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta); fails where the two don't have the same keys."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(F.col(key).alias("_k"), F.col(value).alias("after"))
    both = a.join(b, F.col(key) == F.col("_k"), "full_outer")
    same = F.col(key).isNotNull() & F.col("_k").isNotNull()
    checked = F.when(same, F.col("after") - F.col("before")).otherwise(F.raise_error(F.lit("the variants don't have the same keys")).cast("double"))
    return both.select(key, "before", "after", checked.alias("delta"))
