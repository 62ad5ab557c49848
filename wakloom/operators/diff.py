"""Differences between two copies of a table, field by field.

Repeats are dropped on each side, then EXCEPT ALL in both directions leaves the
rows that the other side has not. Only keys of those are looked at further: all
rows of such keys are fetched from both sides, a full join of the keys tells
one-sided ones, a full join of the cells (key, field, value) the fields that
differ. What both sides hold alike never meets a join, and no group is listed.

Defined results
- null equals null only; values are compared as stored. A null key is a key.
- A row repeated identically, on one or both sides, is no difference.
- Where a key has several unlike rows on a side, a field differs when one side
  has a value of it that the other lacks.
- Columns other than key and fields are not read. Two empty tables differ in
  nothing; against an empty table every key is one-sided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.session import settle


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(F.col(name).isNotNull(), F.to_json(F.struct(F.col(name))))
    return F.col(name).cast("string")


def _full_join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """names of either side with _l and _r, which sides have them; null joins null."""
    r = right.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], F.lit(True).alias("_r"))
    on = [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)]
    both = left.withColumn("_l", F.lit(True)).join(r, on, "full_outer")
    return both.select(*[F.when(F.col("_l"), F.col(n)).otherwise(F.col(f"_r{i}")).alias(n) for i, n in enumerate(names)], F.col("_l").isNotNull().alias("_l"), F.col("_r").isNotNull().alias("_r"))


def table_diff(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], only_left: str = "only_left", only_right: str = "only_right") -> DataFrame:
    """key columns, kind (only_left, only_right or differs), field ('' for one-sided keys)."""
    names = key + fields
    l, r = left.select(*names).distinct(), right.select(*names).distinct()
    residue = l.exceptAll(r).select(*key).unionAll(r.exceptAll(l).select(*key)).distinct()
    hit = settle(residue, "residue").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    near = [side.join(hit, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left_semi") for side in (left.select(*names), right.select(*names))]
    keys = _full_join(*[side.select(*key).distinct() for side in near], key)
    single = keys.where("not (_l and _r)").select(*key, F.when(F.col("_l"), only_left).otherwise(only_right).alias("kind"), F.lit("").alias("field"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("_field"), _as_text(left, f).alias("_value")) for f in fields]))
    parts = [side.select(*key, cells.alias("_cell")).select(*key, "_cell.*").distinct() for side in near]
    odd = _full_join(*parts, [*key, "_field", "_value"]).where("not (_l and _r)").select(*key, F.col("_field").alias("field")).distinct()
    two = keys.where("_l and _r").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    differ = odd.join(two, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left_semi").select(*key, F.lit("differs").alias("kind"), "field")
    return single.unionAll(differ)
