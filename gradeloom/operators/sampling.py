"""Ranks, bands, splits and samples with results that reruns repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of SHA-256 over 'seed:key'."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 12), 16, 10).cast("double") / 16.0**12


def hash_split(df: DataFrame, group: str, seed: str = "42", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """df with split: whole groups go to train, validation or test, so nothing leaks between them."""
    u = unit_hash(seed, F.col(group))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def leakage(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def band(x: Column, edges: tuple[float, ...] = (-0.01, 4.0, 6.0, 8.0, 10.01)) -> Column:
    """The number of the right-closed band; -1 outside and for null."""
    out = F.lit(-1)
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((x > a) & (x <= b), i).otherwise(out)
    return out


def first_rank(df: DataFrame, by: str, tie: str, within: str, name: str = "rank") -> DataFrame:
    """1..n within a group by value, ties by another column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(within).orderBy(by, tie)))


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark drops most rows before the shuffle, as the rank is bounded."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).withColumnRenamed("_r", "place")


#: Essays of a batch in a scoring plan.
BATCH = 50


def scoring_plan(df: DataFrame, key: str, raters: list[str], rate: float = 0.25, anchors: list | None = None, anchor_rate: float = 0.05, seed: str = "42") -> DataFrame:
    """(key, rater_id, role, batch): primary raters in turn over the essays in hash order, secondary ones for a share.

    Each rater also gets the same number of anchors (batch -1), one at least, drawn without replacement.
    """
    if len(raters) < 2:
        raise ValueError("a plan needs two raters at least")
    mixed = unit_hash(f"{seed}a", F.col(key))
    d = ordinal(df.select(key), [mixed, F.col(key)], "_k").withColumn("_k", F.col("_k") - 1)
    names, n = F.array(*map(F.lit, raters)), len(raters)
    at = (F.col("_k") % n).cast("int")
    other = ((at + 1 + F.floor(unit_hash(f"{seed}b", F.col(key)) * (n - 1)).cast("int")) % n).cast("int")
    row = lambda at, role: F.struct(F.get(names, at).alias("rater_id"), F.lit(role).alias("role"))
    both = F.array_compact(F.array(row(at, "primary"), F.when(unit_hash(seed, F.col(key)) < rate, row(other, "secondary"))))
    plan = d.select(key, F.explode(both).alias("r"), F.floor(F.col("_k") / BATCH).cast("int").alias("batch")).select(key, "r.*", "batch")
    if anchors:
        each = min(max(1, int(df.count() * anchor_rate / n)), len(anchors))
        rows = df.sparkSession.createDataFrame([(a, r) for a in anchors for r in raters], f"{key} {df.schema[key].dataType.simpleString()}, rater_id string")
        drawn = top_per_group(rows, "rater_id", [unit_hash(seed, F.concat_ws(":", "rater_id", F.col(key).cast("string"))), F.col(key)], each)
        plan = plan.unionByName(drawn.select(key, "rater_id", F.lit("anchor").alias("role"), F.lit(-1).alias("batch")))
    return plan


def forms(plan: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """An empty scoring form for each row of a plan: score and evidence of each criterion, total, flag, note, duration."""
    blank = lambda c: F.lit("").alias(c)
    number = lambda c: F.lit(None).cast("double").alias(c)
    return plan.select(key, "rater_id", *(x for c in criteria for x in (number(c), blank(f"{c}__evidence"))), number("total"), blank("flag"), blank("note"), number("duration_sec"))


def form_of(plan: DataFrame, key: str, criteria: list[str], rater: str) -> DataFrame:
    """The form of one rater; write forms() partitioned by rater_id to have all of them."""
    return forms(plan.where(F.col("rater_id") == rater), key, criteria)


def double_scoring(df: DataFrame, key: str, raters: int, rate: float = 0.25, seed: str = "42") -> DataFrame:
    """(key, rater, part): a first rater for each essay, and another one for a share of them."""
    if raters < 2:
        raise ValueError("a plan needs two raters at least")
    first = F.floor(unit_hash(f"{seed}a", F.col(key)) * raters).cast("int")
    second = F.pmod(first + 1 + F.floor(unit_hash(f"{seed}b", F.col(key)) * (raters - 1)).cast("int"), F.lit(raters))
    primary = df.select(key, first.alias("rater"), F.lit("primary").alias("part"))
    other = df.where(unit_hash(seed, F.col(key)) < rate).select(key, second.alias("rater"), F.lit("secondary").alias("part"))
    return primary.unionByName(other)


def anchors(scores: DataFrame, essay: str, total: str, per_level: int = 3) -> DataFrame:
    """(essay, level, quality): for each whole score the essays that raters agree on best, two scores at least."""
    mean = F.avg(total)
    found = scores.groupBy(essay).agg(F.count(total).alias("n"), mean.alias("mean"), F.stddev_samp(total).alias("sd")).where("n >= 2")
    level = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.rint("mean")))
    found = found.withColumn("level", level).withColumn("quality", F.round(F.col("sd") + F.abs(F.col("mean") - F.col("level")), 6))
    return top_per_group(found, "level", [F.col("quality"), F.col(essay)], per_level).select(essay, "level", "quality", "place")


def ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """df with 1..n in a global order, without a single-task window: ranges are sorted, counted, and numbered from their offsets."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    spread = _held(spread)
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_b")  # one row a partition
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return spread.withColumn("_r", local).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_b", "_r")


def _held(df: DataFrame) -> DataFrame:
    """Partition numbers must not change between the two uses of df."""
    from gradeloom.session import cut

    return cut(df)


def quantile_edges(n: int, bins: int) -> list[float]:
    """Edges of right-closed quantile bins of the ranks 1..n."""
    import numpy as np

    return [float(1 + (n - 1) * q) for q in np.linspace(0, 1, bins + 1)] if n else []


def quantile_bins(df: DataFrame, by: str, tie: str, bins: int, name: str = "bin") -> DataFrame:
    """df with the number of the right-closed quantile bin of its rank by value; sizes differ from those of ntile."""
    ranked = ordinal(df, [F.col(by), F.col(tie)], "_rank")
    edges = quantile_edges(ranked.count(), bins)
    below = sum(((F.col("_rank") > e).cast("int") for e in edges), F.lit(0))
    return ranked.withColumn(name, F.greatest(F.lit(0), below - 1)).drop("_rank")


def stratified_pilot(df: DataFrame, key: str, length: str, n: int, bins: int = 5, seed: str = "42") -> DataFrame:
    """n // bins essays of each length bin (all if it has fewer), by hash order."""
    binned = quantile_bins(df, length, key, bins)
    return top_per_group(binned, "bin", [unit_hash(seed, F.col(key)), F.col(key)], n // bins)


def uncertainty_sample(df: DataFrame, key: str, uncertainty: str, group: str, n: int) -> DataFrame:
    """n essays: the most uncertain n // groups (one at least) of each group, then the most uncertain others."""
    groups = max(1, df.select(group).distinct().count())
    order = [F.col(uncertainty).desc(), F.col(key)]
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    first = ranked.where(F.col("_r") <= max(1, n // groups)).withColumn("_late", F.lit(0))
    # the rest of the sample is among the first n rows of each group
    rest = ranked.where((F.col("_r") > max(1, n // groups)) & (F.col("_r") <= n)).withColumn("_late", F.lit(1))
    return first.unionByName(rest).orderBy("_late", *order).limit(max(n, groups)).drop("_r", "_late")


def group_holdout(df: DataFrame, group: str, key: str, prompt: str, held: list[str], seed: str = "42", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """hash_split() by group (the key where it is null), where every essay of a group with a held-out prompt goes to test."""
    d = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("essay:"), F.col(key).cast("string"))))
    out = d.where(F.col(prompt).isin(*held)).select("_g").distinct().withColumn("_held", F.lit(True))
    split = hash_split(d, "_g", seed, train, validation).join(out, "_g", "left")
    return split.withColumn("split", F.when(F.col("_held"), "test").otherwise(F.col("split"))).drop("_g", "_held")


def tail_split(df: DataFrame, order: list[Column], share: float = 0.2, least: int = 10) -> DataFrame:
    """df with split: the last rows in an order are for testing, a share of all rows and so many at least."""
    d = ordinal(df, order, "_at")
    n = df.count()
    return d.withColumn("split", F.when(F.col("_at") > n - max(least, int(n * share)), "test").otherwise("train")).drop("_at")


def keyword_map(df: DataFrame, prompt: str, keywords: str, order: str) -> DataFrame:
    """(prompt, keywords: array): those of a prompt's first row, split at semicolons; prompts without any are left out."""
    first = df.groupBy(prompt).agg(F.min_by(F.coalesce(keywords, F.lit("")), order).alias("_k"))
    parts = F.filter(F.transform(F.split("_k", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return first.select(prompt, parts.alias("keywords")).where(F.size("keywords") > 0)


def batches(df: DataFrame, rater: str, key: str, size: int = 50, seed: str = "42") -> DataFrame:
    """df with batch: each rater's essays in hash order, in runs of a size."""
    place = F.row_number().over(Window.partitionBy(rater).orderBy(F.xxhash64(F.lit(seed), key), key))
    return df.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def exam_split(df: DataFrame, key: str, exam: str, score: str, seed: str = "42", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """df with split, for one essay a student: exact sizes per exam, the score bands of an exam spread over the parts.

    Essays of a band are numbered in hash order, bands interleave by that number, and the parts are dealt along the line in
    proportion: the j-th of n essays goes to a part when its share of j grows by one. Exams of three essays or more have one
    validation and one test essay at least; of two essays one is for testing.
    """
    if not 0 < train < 1 or not 0 <= validation < 1 or train + validation >= 1:
        raise ValueError("the shares must lie between 0 and 1")
    mixed = unit_hash(seed, F.col(key))
    d = df.withColumn("_b", band(F.col(score)))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(exam, "_b").orderBy(mixed, key)))
    line = Window.partitionBy(exam)
    d = d.withColumns({"_j": F.row_number().over(line.orderBy("_i", "_b", key)), "_n": F.count("*").over(line)})
    n = F.col("_n")
    part = lambda share: F.when(n >= 3, F.greatest(F.lit(1), F.rint(n * share).cast("long"))).otherwise(F.lit(0))
    v, t = part(validation), part(1 - train - validation)
    over = v + t >= n
    v = F.when(over, F.when(n >= 3, 1).otherwise(0)).otherwise(v)
    t = F.when(over | (n < 3), F.when(n >= 3, 1).otherwise(F.greatest(F.lit(0), n - 1))).otherwise(t)
    d = d.withColumns({"_v": v.cast("long"), "_t": t.cast("long")})
    d = d.withColumn("_h", F.col("_v") + F.col("_t"))
    # whole-number division, so that the deal is exact
    d = d.withColumns({"_k": F.expr("_j * _h div _n"), "_was": F.expr("(_j - 1) * _h div _n")})
    is_test = F.expr("_k * _t div nullif(_h, 0) > (_k - 1) * _t div nullif(_h, 0)")
    split = F.when(F.col("_k") == F.col("_was"), "train").when(is_test, "test").otherwise("validation")
    return d.withColumn("split", split).drop("_b", "_i", "_j", "_n", "_v", "_t", "_h", "_k", "_was")
