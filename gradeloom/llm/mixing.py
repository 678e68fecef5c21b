"""Mixing sources to target weights (operator 6).

Documents get hash-random keys. A key's leading part names one of a source's equal key ranges, so ranges are known
without sampling and a source with a third of all rows spreads over as many ranges as it needs. Sums of the ranges give
the prefix sum at each range's start; a window inside a range gives the rest. The source's budget cuts there.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; repeated rows are documents of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, table, written

#: Weights by a source's place in code-point order, repeating; the mix's share of all sizes; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Rows of a key range, about.
RANGE_ROWS = 20_000


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """sources(source, source_size, n_rows) with target: weighted shares, stopped at epochs times the size.

    Water filling in closed form: in order of capacity over weight, a source is capped while its capacity is below its
    part of what the sources before it left. One row per source, so a plain window is small.
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int")).cast("double"))
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("cap", F.col("source_size").cast("double") * epochs)
        .withColumn("capped", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(everywhere).cast("double") * share - F.col("capped")) / F.col("w_left"))
        .withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everywhere))
    )
    level = F.col("final.level")
    return filled.select("source", "source_size", "n_rows", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, source, text).

    A source gives whole epochs while its target lasts, then its documents in key order up to the exact rest: the
    document at the cut gives only its first words, so a source's taken words are its target, rounded.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    # equal rows are told apart by their number; grouping them first keeps a much repeated row out of one key range
    grouped = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    sources = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_rows"))
    goal = targets(sources, weights, share, epochs).withColumnRenamed("source", "s")
    rows = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("copy").cast("string"), F.col("size").cast("string")))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("key", key)
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.ceil(F.col("n_rows") / RANGE_ROWS)))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("range_start"))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    rows = rows.withColumn("before", F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH g AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, count(*) AS copies
           FROM documents GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, sum(copies) AS n_rows FROM g GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)] AS DOUBLE) AS w,
              CAST(source_size AS DOUBLE) * 2 AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER f, 0.0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER f, 0.0) AS w_left,
              CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget
       FROM s1 WINDOW f AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (budget - capped) / w_left AS level FROM s2),
lv AS (SELECT arg_min(level, cap / w) AS level FROM s3 WHERE level * w <= cap),
goal AS (SELECT source AS s, source_size, coalesce(least(cap, w * lv.level), cap) AS target FROM s3, lv),
r AS (SELECT g.*, goal.source_size, goal.target, c.copy,
             md5('mix:' || doc_id || ':' || c.copy || ':' || size) AS key
      FROM g JOIN goal ON g.source IS NOT DISTINCT FROM goal.s, LATERAL (SELECT unnest(range(1, g.copies + 1)) AS copy) c),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM b)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM e
"""
