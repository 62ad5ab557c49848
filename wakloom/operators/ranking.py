"""Places in an order over a whole table, without putting the table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakloom.session import settle


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with its place in the order, from 0. The order must be total for a fixed result.

    Rows are range-partitioned and sorted; a row's place is its place in its
    partition and the rows of the partitions before. Partitions and places are
    written down first, so that both readings of them agree.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_gr_id", F.monotonically_increasing_id())
    kept = settle(ranged.withColumn("_gr_part", F.shiftright("_gr_id", 33)).withColumn("_gr_at", F.col("_gr_id").bitwiseAND((1 << 33) - 1)).drop("_gr_id"), "ranked")
    sizes = kept.groupBy("_gr_part").agg(F.count("*").alias("_gr_n"))
    # One row for each partition, n at most.
    before = sizes.select("_gr_part", F.coalesce(F.sum("_gr_n").over(Window.orderBy("_gr_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gr_before"))
    return kept.join(F.broadcast(before), "_gr_part").withColumn(name, F.col("_gr_before") + F.col("_gr_at")).drop("_gr_part", "_gr_at", "_gr_before")


def round_robin(df: DataFrame, order: list, k: int, name: str) -> DataFrame:
    """df with a batch number: place in the order modulo k."""
    return global_rank(df, order, name).withColumn(name, F.pmod(name, F.lit(k)))


def chunks(df: DataFrame, order: list, size: int, name: str) -> DataFrame:
    """df with a chunk number: size consecutive rows of the order share one."""
    return global_rank(df, order, name).withColumn(name, F.floor(F.col(name) / size))


def rank_in_group(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """df with its place in its group, from 0: the place over all less that of the group's first row.

    For groups that may hold a large part of all rows; the order must be total.
    """
    ranked = global_rank(df, [*key, *order], "_at")
    first = ranked.groupBy(*key).agg(F.min("_at").alias("_first"))
    first = first.select(*[F.col(k).alias(f"_{k}") for k in key], "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return ranked.join(first, same).withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_first", *[f"_{k}" for k in key])


def with_neighbour(ranked: DataFrame, rank: str, key: list[str], values: dict[str, str], step: int) -> DataFrame:
    """ranked with values (name: column) of the row `step` places on in rank, null where that is of another group.

    A lag or lead as a join on places: even, whatever the sizes of the groups.
    rank must be unique, as global_rank makes it; a place no row has gives null.
    """
    there = ranked.select((F.col(rank) - step).alias(rank), *[F.col(k).alias(f"_{k}") for k in key], *[F.col(c).alias(f"_v_{n}") for n, c in values.items()], F.lit(True).alias("_there"))
    same = F.coalesce(F.col("_there"), F.lit(False))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = ranked.join(there, rank, "left").withColumns({n: F.when(same, F.col(f"_v_{n}")) for n in values})
    return out.drop("_there", *[f"_{k}" for k in key], *[f"_v_{n}" for n in values])
