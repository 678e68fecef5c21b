"""Agreement of raters and gold labels, as grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import bucketed, written


def pearson(a: str, b: str) -> Column:
    """Null where a side is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def bins(x: Column, step: float) -> Column:
    return F.rint(x / step)


def qwk(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), step: float = 0.25) -> DataFrame:
    """(by..., n, qwk): quadratic weighted kappa over contiguous bins of a step.

    In closed form, 1 - n * sum((i-j)^2) / sum over both histograms: the double sum is n*(sum i^2 + sum j^2) - 2 sum i sum j,
    so one pass with partial sums does. 1 where there is one bin only.
    """
    i, j = bins(F.col(a), step), bins(F.col(b), step)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, i.alias("i"), j.alias("j"))
    agg = both.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("i") - F.col("j")) ** 2).alias("d"), F.sum(F.col("i") ** 2).alias("ii"), F.sum(F.col("j") ** 2).alias("jj"), F.sum("i").alias("si"), F.sum("j").alias("sj"))
    chance = F.col("n") * (F.col("ii") + F.col("jj")) - 2 * F.col("si") * F.col("sj")
    return agg.select(*by, "n", F.when(chance > 0, 1 - F.col("n") * F.col("d") / chance).otherwise(1.0).alias("qwk"))


def qwk_observed(df: DataFrame, a: str, b: str, by: tuple[str, ...] = (), step: float = 0.25) -> DataFrame:
    """The same with ranks among the labels observed in place of bins: gaps collapse. Null where a side is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, bins(F.col(a), step).alias("i"), bins(F.col(b), step).alias("j"))
    cells = both.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    labels = cells.select(*by, "i").unionByName(cells.select(*by, F.col("j").alias("i"))).distinct()
    ranked = labels.withColumn("r", F.dense_rank().over(Window.partitionBy(*by).orderBy("i")).cast("double"))
    side = lambda c, r: ranked.select(*(F.col(k).alias(f"{r}_{k}") for k in by), F.col("i").alias(c), F.col("r").alias(r))
    same = lambda r: [cells[k].eqNullSafe(F.col(f"{r}_{k}")) for k in by]
    left, right = side("xi", "x"), side("yi", "y")
    out = cells.join(left, [*same("x"), cells["i"] == F.col("xi")]).join(right, [*same("y"), cells["j"] == F.col("yi")])
    n = F.col("n").cast("double")
    agg = out.groupBy(*by).agg(F.sum(n).alias("t"), F.sum(n * (F.col("x") - F.col("y")) ** 2).alias("d"), F.sum(n * F.col("x") ** 2).alias("xx"), F.sum(n * F.col("y") ** 2).alias("yy"), F.sum(n * F.col("x")).alias("sx"), F.sum(n * F.col("y")).alias("sy"))
    chance = F.col("t") * (F.col("xx") + F.col("yy")) - 2 * F.col("sx") * F.col("sy")
    varied = (F.col("t") * F.col("xx") > F.col("sx") ** 2) & (F.col("t") * F.col("yy") > F.col("sy") ** 2)
    return agg.select(*by, F.col("t").cast("long").alias("n"), F.when(varied, 1 - F.col("t") * F.col("d") / chance).alias("qwk"))


def alpha_ordinal(df: DataFrame, item: str, value: str) -> DataFrame:
    """(n_pairable, alpha): Krippendorff's ordinal alpha over rows (item, value), nulls left out.

    Values are counted per item and level first, so an item's pairs come from its level counts, not from its rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(item, F.col(value).alias("v")).agg(F.count("*").cast("double").alias("c"))
    m = F.sum("c").over(Window.partitionBy(item))
    pairable = counts.withColumn("m", m).where("m > 1")
    other = pairable.select(F.col(item).alias("o_item"), F.col("v").alias("w"), F.col("c").alias("d"))
    joined = pairable.join(other, F.col(item) == F.col("o_item"))
    weight = F.col("c") * (F.col("d") - (F.col("v") == F.col("w")).cast("double")) / (F.col("m") - 1)
    cells = joined.groupBy("v", "w").agg(F.sum(weight).alias("o"))
    levels = cells.groupBy("v").agg(F.sum("o").alias("n"))
    run = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("cum", F.sum("n").over(run))  # one row a level
    x, y = levels.select(*(F.col(c).alias(f"x_{c}") for c in ("v", "n", "cum"))), levels.select(*(F.col(c).alias(f"y_{c}") for c in ("v", "n", "cum")))
    # levels are the points of a scale: few, and paired by design
    grid = x.join(y, F.col("x_v") < F.col("y_v")).withColumn("dist", (F.col("y_cum") - F.col("x_cum") + F.col("x_n") / 2 - F.col("y_n") / 2) ** 2)
    observed = grid.join(cells, (F.col("x_v") == F.col("v")) & (F.col("y_v") == F.col("w")), "left")
    agg = observed.agg(F.sum(2 * F.col("o") * F.col("dist")).alias("do"), F.sum(2 * F.col("x_n") * F.col("y_n") * F.col("dist")).alias("de"))
    total = levels.agg(F.sum("n").alias("t"))
    alpha = F.when(F.col("de") > 0, 1 - (F.col("do") / F.col("t")) / (F.col("de") / (F.col("t") * (F.col("t") - 1)))).otherwise(1.0)
    return agg.join(F.broadcast(total)).select(F.round("t").cast("long").alias("n_pairable"), alpha.alias("alpha"))


def resolve(df: DataFrame, essay: str, total: str, scale: float = 10.0, tol_ratio: float = 0.10, method: str = "closest_pair", criteria: tuple[str, ...] = ()) -> DataFrame:
    """(essay, n_raters, gold_total, status, rater_range, rater_std): gold labels by the closest pair of scores, or their median.

    With criteria also needs_adjudication, and gold_<criterion> (mean) and range_<criterion> of each; an essay without a
    total then takes the sum of each rater's criteria.
    """
    if method not in ("closest_pair", "median"):
        raise ValueError(method)
    if criteria:
        summed = sum((F.coalesce(c, F.lit(0.0)) for c in criteria), F.lit(0.0))
        d = df.withColumn("_any", F.max(F.col(total).isNotNull()).over(Window.partitionBy(essay)))
        d = d.withColumn("_total", F.when(F.col("_any"), F.col(total)).otherwise(summed))
        base = resolve(d.select(essay, F.col("_total").alias(total)), essay, total, scale, tol_ratio, method)
        each = [x for c in criteria for x in (F.round(F.avg(c), 4).alias(f"gold_{c}"), F.coalesce(F.max(c) - F.min(c), F.lit(0.0)).alias(f"range_{c}"))]
        return base.join(df.groupBy(essay).agg(*each), essay).withColumn("needs_adjudication", F.col("status") == "needs_adjudication")
    tol = tol_ratio * scale
    by = Window.partitionBy(essay).orderBy(total)
    gaps = df.select(essay, total).withColumn("gap", F.lead(total).over(by) - F.col(total))
    agg = gaps.groupBy(essay).agg(
        F.count("*").alias("n_raters"),
        F.count(total).alias("n"),
        F.avg(total).alias("mean"),
        F.min(total).alias("lo"),
        F.max(total).alias("hi"),
        F.stddev_samp(total).alias("sd"),
        F.median(total).alias("median"),
        F.min(F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), F.col(total).alias("at")))).alias("pair"),
    )
    spread = F.col("hi") - F.col("lo")
    status = (
        F.when(F.col("n") == 1, "single_scored")
        .when(F.col("n") == 2, F.when(spread <= tol, "agreed").otherwise("needs_adjudication"))
        .otherwise(F.when(F.col("pair.gap") <= tol, "closest_pair").otherwise("needs_adjudication"))
    )
    gold = F.when(F.col("n") <= 2, F.col("mean")).otherwise(F.col("pair.at") + F.col("pair.gap") / 2)
    if method == "median":
        gold, status = F.when(F.col("n") <= 2, F.col("mean")).otherwise(F.col("median")), F.when(F.col("n") > 2, "median").otherwise(status)
    return agg.where("n > 0").select(essay, "n_raters", F.round(gold, 4).alias("gold_total"), status.alias("status"), spread.alias("rater_range"), F.coalesce("sd", F.lit(0.0)).alias("rater_std"))


def disagreements(df: DataFrame, essay: str, total: str, tol: float) -> DataFrame:
    """Essays of two scores or more that lie further apart than tol."""
    agg = df.groupBy(essay).agg(F.count(total).alias("n_raters"), F.min(total).alias("lowest"), F.max(total).alias("highest"))
    return agg.where((F.col("n_raters") >= 2) & (F.col("highest") - F.col("lowest") > tol)).withColumn("rater_range", F.col("highest") - F.col("lowest"))


def rater_drift(df: DataFrame, anchors: DataFrame, essay: str, rater: str, total: str, gold: str, batch: str | None = None) -> DataFrame:
    """(rater, n, bias, mae) of scores against the gold labels of anchor essays, by batch as well where one is named."""
    error = F.col(total) - F.col(gold)
    return df.join(anchors.select(F.col(essay).alias("_e"), gold), F.col(essay) == F.col("_e")).groupBy(rater, *([batch] if batch else [])).agg(F.count("*").alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"))


def snap(x: Column, levels: list[float]) -> Column:
    """The nearest level, the lower one of two; null stays null."""
    at = F.array(*map(F.lit, sorted(levels)))
    return F.when(x.isNotNull(), F.array_min(F.transform(at, lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))["v"])


def snapped_gold(df: DataFrame, levels: dict[str, list[float]], step: float = 0.25) -> DataFrame:
    """df with gold_<criterion> at the nearest level of each criterion, and gold_total at the nearest step."""
    d = df.withColumns({f"gold_{c}": snap(F.col(f"gold_{c}"), v) for c, v in levels.items() if v and f"gold_{c}" in df.columns})
    return d.withColumn("gold_total", to_step(F.col("gold_total"), step))


def to_step(x: Column, step: float = 0.25) -> Column:
    """Half-even rounding to a step."""
    return F.rint(x / step) * step


def icc(df: DataFrame, essay: str, rater: str, total: str) -> DataFrame:
    """(n_essays, n_raters, icc): ICC(2,k) over essays that every rater scored; null where it isn't defined.

    A rater's scores of an essay are averaged. Sums of squares come from sums by essay and by rater.
    """
    cells = df.where(F.col(total).isNotNull()).groupBy(essay, rater).agg(F.avg(total).alias("x"))
    raters = cells.agg(F.countDistinct(rater).alias("k"))
    per = Window.partitionBy(essay)
    full = cells.withColumns({"m": F.count("*").over(per), "row": F.avg("x").over(per)}).join(F.broadcast(raters)).where("m = k")
    columns = full.groupBy(rater).agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.sum(F.col("row") * F.col("row")).alias("rr"), F.count("*").alias("n"), F.max("k").alias("k"))
    a = columns.agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("rr").alias("rr"), F.sum((F.col("s") / F.col("n")) ** 2).alias("cc"), F.max("n").alias("n"), F.max("k").alias("k"))
    c, n, k = F.col, F.col("n"), F.col("k")
    grand = c("s") / (n * k)
    rows, cols = c("rr") - n * k * grand**2, n * (c("cc") - k * grand**2)
    ms_r, ms_c, ms_e = rows / (n - 1), cols / (k - 1), (c("ss") - n * k * grand**2 - rows - cols) / ((n - 1) * (k - 1))
    a = a.select("n", "k", *(F.when((n >= 2) & (k >= 2), x).alias(name) for name, x in (("r", ms_r), ("c", ms_c), ("e", ms_e))))
    denominator = c("r") + (c("c") - c("e")) / c("n")
    return a.select(F.coalesce("n", F.lit(0)).alias("n_essays"), F.coalesce("k", F.lit(0)).alias("n_raters"), F.when(denominator > 0, (c("r") - c("e")) / denominator).alias("icc"))


def rater_pairs(df: DataFrame, essay: str, rater: str, total: str, step: float = 0.25, least: int = 5) -> DataFrame:
    """(rater_a, rater_b, n_common, qwk, adjacent, pearson) of pairs with enough essays in common."""
    cells = df.where(F.col(total).isNotNull()).groupBy(essay, rater).agg(F.avg(total).alias("x"))
    a, b = (cells.select(F.col(essay).alias("_e"), F.col(rater).alias(f"rater_{s}"), F.col("x").alias(s)) for s in "ab")
    both = a.join(b, "_e").where("rater_a < rater_b")
    by = ("rater_a", "rater_b")
    i, j = bins(F.col("a"), step), bins(F.col("b"), step)
    agg = both.groupBy(*by).agg(
        F.count("*").alias("n_common"), F.sum((i - j) ** 2).alias("d"), F.sum(i**2).alias("ii"), F.sum(j**2).alias("jj"), F.sum(i).alias("si"), F.sum(j).alias("sj"),
        F.avg((F.abs(F.col("a") - F.col("b")) <= 4 * step + 1e-9).cast("double")).alias("adjacent"), pearson("a", "b").alias("pearson"),
    )
    chance = F.col("n_common") * (F.col("ii") + F.col("jj")) - 2 * F.col("si") * F.col("sj")
    kappa = F.when(chance > 0, 1 - F.col("n_common") * F.col("d") / chance).otherwise(1.0)
    return agg.where(F.col("n_common") >= least).select(*by, "n_common", kappa.alias("qwk"), "adjacent", "pearson")


def rater_matrix(df: DataFrame, essay: str, rater: str, total: str, raters: list) -> DataFrame:
    """One row an essay and one column a rater, for display: mean scores, null where a rater has none."""
    return df.groupBy(essay).pivot(rater, raters).agg(F.avg(total))


def criteria_report(df: DataFrame, essay: str, rater: str, criteria: tuple[str, ...], step: float = 0.25) -> DataFrame:
    """(criterion, n_raters, n_essays, n_double_scored, qwk_mean, qwk_min, adjacent_agreement, pearson_mean, krippendorff_alpha, icc_2k), one row a criterion."""
    out = None
    for c in (c for c in criteria if c in df.columns):
        rows = df.where(F.col(c).isNotNull())
        per = rows.groupBy(essay).agg(F.countDistinct(rater).alias("k"))
        counts = per.agg(F.count("*").alias("n_essays"), F.count_if(F.col("k") >= 2).alias("n_double_scored")).join(F.broadcast(rows.agg(F.countDistinct(rater).alias("n_raters"))))
        pairs = agreement_report(rater_pairs(df, essay, rater, c, step)).select(F.col("mean_qwk").alias("qwk_mean"), F.col("min_qwk").alias("qwk_min"), F.col("mean_adjacent").alias("adjacent_agreement"), F.col("mean_pearson").alias("pearson_mean"))
        cells = rows.groupBy(essay, rater).agg(F.avg(c).alias("_x")).withColumn("_x", bins(F.col("_x"), step))
        one = counts.join(pairs).join(alpha_ordinal(cells, essay, "_x").select(F.col("alpha").alias("krippendorff_alpha")), F.lit(True), "left").join(icc(df, essay, rater, c).select(F.col("icc").alias("icc_2k")), F.lit(True), "left")
        one = one.select(F.lit(c).alias("criterion"), "n_raters", "n_essays", "n_double_scored", "qwk_mean", "qwk_min", "adjacent_agreement", "pearson_mean", "krippendorff_alpha", "icc_2k")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("none of the criteria is a column")
    return out


def agreement_report(pairs: DataFrame) -> DataFrame:
    """(n_pairs, mean_qwk, min_qwk, mean_adjacent, mean_pearson) over rater_pairs()."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("qwk").alias("mean_qwk"), F.min("qwk").alias("min_qwk"), F.avg("adjacent").alias("mean_adjacent"), F.avg("pearson").alias("mean_pearson"))


def rater_severity(df: DataFrame, essay: str, rater: str, total: str, sweeps: int = 30) -> DataFrame:
    """(rater, leniency, interpretation, n_scored): score = mean + ability of the essay + leniency of the rater, by turns.

    The cells of essay and rater are counted once and stay in buckets of essays, where each sweep reads them: it moves
    only what it sums by rater (if raters are too many to broadcast, cells as well), and what it gives is written.
    """
    rows = df.where(F.col(total).isNotNull())
    mean = rows.agg(F.avg(total).alias("mu"))
    cells = rows.groupBy(F.col(essay).alias("e"), F.col(rater).alias("r")).agg(F.count("*").alias("n"), F.sum(total).alias("s")).join(F.broadcast(mean))
    with bucketed(cells.select("e", "r", "n", (F.col("s") - F.col("n") * F.col("mu")).alias("s")), "e") as cells:
        raters = written(cells.groupBy("r").agg(F.sum("n").alias("n_scored")))
        beta = raters.select("r", F.lit(0.0).alias("beta"))
        of = Window.partitionBy("e")
        for _ in range(sweeps):
            now = cells.where("e is not null").join(beta, "r")
            theta = F.sum(F.col("s") - F.col("n") * F.col("beta")).over(of) / F.sum("n").over(of)
            beta = written(now.withColumn("theta", theta).groupBy("r").agg((F.sum(F.col("s") - F.col("n") * F.col("theta")) / F.sum("n")).alias("beta")))
    word = F.when(F.col("beta") > 0.25, "lenient").when(F.col("beta") < -0.25, "severe").otherwise("balanced")
    return beta.join(raters, "r").select(F.col("r").alias(rater), F.col("beta").alias("leniency"), word.alias("interpretation"), "n_scored")


def usability(df: DataFrame, items: list[str]) -> DataFrame:
    """(n, mean, std, median, min, max, cronbach_alpha) of ten-item usability scores; rows with a null are left out.

    An answer outside 1..5 fails the query.
    """
    if len(items) != 10:
        raise ValueError("ten items are needed")
    whole = F.lit(True)
    for i in items:
        whole = whole & F.col(i).isNotNull()
    ok = lambda c: F.when(c.between(1, 5), c.cast("double")).otherwise(F.raise_error(F.lit("answers lie between 1 and 5")).cast("double"))
    d = df.where(whole).select(*(ok(F.col(i)).alias(f"q{k}") for k, i in enumerate(items)))
    q = [F.col(f"q{k}") for k in range(10)]
    score = sum((x - 1 if k % 2 == 0 else 5 - x for k, x in enumerate(q)), F.lit(0.0)) * 2.5
    spread = F.var_samp(sum(q[1:], q[0]))
    alpha = F.when(spread > 0, F.lit(10 / 9) * (1 - sum((F.var_samp(x) for x in q[1:]), F.var_samp(q[0])) / spread)).otherwise(0.0)
    return d.withColumn("s", score).agg(
        F.count("*").alias("n"), F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("std"), F.percentile("s", F.lit(0.5)).alias("median"), F.min("s").alias("min"), F.max("s").alias("max"), alpha.alias("cronbach_alpha")
    )


def self_consistency(df: DataFrame, key: str, criterion: str, run: str, score: str, level: str, levels: list[float], top: float, evidence: str | None = None, flags: str | None = None) -> DataFrame:
    """(key, criterion, score, level, n_runs, spread, confidence) over several runs of a judge.

    The median of the snapped scores, snapped; the most frequent level, the first seen of equal ones; the range over the
    maximum as spread; confidence is one minus the mean spread of a key's criteria. A score that isn't a number is the
    lowest level. evidence and flags name array columns: the first three pieces in order of run, and the sorted set of
    all flags of a key. Runs are a handful, so their lists are bounded.
    """
    number = F.coalesce(F.col(score).cast("string").try_cast("double"), F.lit(float(min(levels))))
    rows = df.where(F.col(score).isNotNull()).select(key, criterion, F.col(run).alias("_at"), snap(number, levels).alias("_x"), F.nullif(level, F.lit("")).alias("_l"), *([F.col(evidence).alias("_ev")] if evidence else []))
    per_level = rows.groupBy(key, criterion, "_l").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.collect_list("_x").alias("_xs"), *([F.collect_list(F.struct("_at", "_ev")).alias("_evs")] if evidence else []))
    best = F.max(F.when(F.col("_l").isNotNull(), F.struct("_n", (-F.col("_first")).alias("first"), "_l"))).alias("_best")
    agg = per_level.groupBy(key, criterion).agg(F.flatten(F.collect_list("_xs")).alias("_xs"), best, *([F.array_sort(F.flatten(F.collect_list("_evs"))).alias("_evs")] if evidence else []))
    xs, n = F.array_sort("_xs"), F.size("_xs")
    middle = (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2
    spread = (F.array_max("_xs") - F.array_min("_xs")) / top
    shown = [F.slice(F.flatten(F.transform("_evs", lambda e: F.coalesce(e["_ev"], F.array().cast("array<string>")))), 1, 3).alias("evidence")] if evidence else []
    out = agg.select(key, criterion, snap(middle, levels).alias("score"), F.coalesce("_best._l", F.lit("")).alias("level"), n.alias("n_runs"), spread.alias("spread"), *shown)
    out = out.withColumn("confidence", F.round(1 - F.avg("spread").over(Window.partitionBy(key)), 3))
    if flags:
        said = df.select(F.col(key).alias("_k"), F.explode_outer(flags).alias("_f")).withColumn("_f", F.nullif(F.trim("_f"), F.lit(""))).groupBy("_k").agg(F.array_sort(F.collect_set("_f")).alias("flags"))
        out = out.join(said, F.col(key) == F.col("_k"), "left").drop("_k")
    return out
