"""Layered dictionaries: first one wins, merges with their actions, review decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakloom.operators.ranking import global_rank


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order. The order must be total for a fixed result."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def best_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """As first_per_key by the least order value, by partial aggregation: for keys with very many rows."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*key, "_r.*")


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """Union of dictionaries of the same columns with the layer each row comes from; an earlier layer hides a later one's key."""
    marked = [x.withColumn("layer", F.lit(i)) for i, x in enumerate(layers)]
    return best_per_key(reduce(lambda a, b: a.unionByName(b), marked), [key], F.col("layer"))


def merge_actions(main: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, action: insert, update (new wins), same, keep. Keys are distinct on both sides."""
    m, n = main.select(key, F.col(value).alias("_m")), new.select(key, F.col(value).alias("_n"))
    both = m.withColumn("_in_m", F.lit(True)).join(n.withColumn("_in_n", F.lit(True)), key, "full_outer")
    action = F.when(F.col("_in_m").isNull(), "insert").when(F.col("_in_n").isNull(), "keep").when(F.col("_m").eqNullSafe(F.col("_n")), "same").otherwise("update")
    return both.select(key, F.when(F.col("_in_n").isNull(), F.col("_m")).otherwise(F.col("_n")).alias(value), action.alias("action"))


def upsert(existing: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """existing with the rows of changes in place of those of the same key."""
    return existing.join(changes.select(*key).distinct(), key, "left_anti").unionByName(changes)


def overlay(rows: DataFrame, answers: DataFrame, key: list[str], value: str, answer: str) -> DataFrame:
    """rows with value replaced by the answer where there is one."""
    return rows.join(answers.select(*key, F.col(answer).alias("_a")), key, "left").withColumn(value, F.coalesce("_a", value)).drop("_a")


def interleave(first: DataFrame, second: DataFrame, order: list, every: int = 3) -> DataFrame:
    """Rows of two ranked tables with slot: after every `every` rows of the first comes one of the second."""
    a, b = global_rank(first, order, "_r"), global_rank(second, order, "_r")
    a = a.withColumn("slot", F.col("_r") + F.floor(F.col("_r") / every))
    b = b.withColumn("slot", F.col("_r") * (every + 1) + every)
    return a.unionByName(b).drop("_r")
