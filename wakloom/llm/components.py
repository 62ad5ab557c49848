"""Connected components of a link table, by DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakloom.session import forget, settle


FEW_LINKS = 1_000_000  # so many fit one task


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of the links seen with the least node it is connected to by them."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(u) if up.setdefault(u, u) != u else u, root(v) if up.setdefault(v, v) != v else v
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
    if up:
        yield pa.RecordBatch.from_pydict({"u": list(up), "v": [root(x) for x in up]})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node of links (a, b) with the least node it is connected to.

    First each partition replaces its links by a forest. If no more than
    FEW_LINKS links are left, one task joins the forests; else rounds follow.

    Each round every node takes the least name among its neighbours' and then
    that name's own (stars of large and small neighbours by turns), so long
    chains shrink by a factor each round and hubs are only ever aggregated,
    never listed. Each round's table is written to the shared folder. Null ends
    are left out; a link of a node to itself makes it a component of its own.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = settle(links.mapInArrow(forest, links.schema), "edges")
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(forest, edges.schema).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rounds(edges)


def rounds(edges: DataFrame) -> DataFrame:
    nodes = edges.select("u").unionAll(edges.select(F.col("v").alias("u"))).distinct()
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour is linked to the least one.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to the least one.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = settle(small, "edges")
        changed = new.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(new, ["u", "v"], "left_anti").limit(1).count()
        forget(edges)
        edges = new
        if not changed:
            return nodes.join(edges, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))
