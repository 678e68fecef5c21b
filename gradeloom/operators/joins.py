"""Joins that check what they rely on: unique keys, complete matches, equal sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import ordinal


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df; a key that is there twice fails the query when it runs. Rows are counted within the partition that a join by key needs anyway."""
    n = F.count("*").over(Window.partitionBy(*keys))
    said = F.raise_error(F.concat(F.lit("not unique: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, said.cast("boolean")).otherwise(F.lit(True))).drop("_n")


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner", required: tuple[str, ...] = (), suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """The join of two tables whose keys must be unique; columns of both get suffixes, and required ones mustn't be null."""
    both = {c for c in left.columns if c in right.columns and c != key}
    l = unique(left, key).select(*(F.col(c).alias(c + suffixes[0] if c in both else c) for c in left.columns))
    r = unique(right, key).select(F.col(key).alias("_key"), *(F.col(c).alias(c + suffixes[1] if c in both else c) for c in right.columns if c != key))
    out = l.join(r, F.col(key) == F.col("_key"), how).drop("_key")
    if not required:
        return out
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    said = F.raise_error(F.concat(F.lit(f"no {', '.join(required)} for "), F.col(key).cast("string")))
    return out.where(F.when(missing, said.cast("boolean")).otherwise(F.lit(True)))


def lookup(df: DataFrame, facts: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """df with the columns of a small table, null where it has no row. Larger tables aren't broadcast."""
    small = facts.limit(most + 1).count() <= most
    return df.join(F.broadcast(facts) if small else facts, key, "left")


def by_position(left: DataFrame, right: DataFrame, l_order: list[Column], r_order: list[Column]) -> DataFrame:
    """Rows side by side in their orders; tables of different sizes fail the query."""
    l, r = ordinal(left, l_order, "_at"), ordinal(right, r_order, "_at2")
    both = l.join(r, F.col("_at") == F.col("_at2"), "full_outer")
    same = F.col("_at").isNotNull() & F.col("_at2").isNotNull()
    return both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the tables differ in size")).cast("boolean"))).drop("_at", "_at2")


def paired(left: DataFrame, right: DataFrame, key: str, l_order: list[Column], r_order: list[Column]) -> DataFrame:
    """By key where both tables have it, else by position."""
    return left.join(right, key) if key in left.columns and key in right.columns else by_position(left, right, l_order, r_order)


def reordered(gold: DataFrame, essays: DataFrame, key: str) -> DataFrame:
    """gold once for each row of essays, in whose keys it must have a row."""
    wanted = essays.select(F.col(key).alias("_key"))
    out = wanted.join(gold.withColumn("_there", F.lit(True)), F.col("_key") == F.col(key), "left")
    said = F.raise_error(F.concat(F.lit("no label for "), F.col("_key").cast("string"))).cast("boolean")
    return out.where(F.when(F.col("_there").isNull(), said).otherwise(F.lit(True))).drop("_key", "_there")
