"""Train, validation and test splits that keep related chapters together.

Chapters are linked through the lines they share at a seam: a chapter without
its beginning names the line before it. Links run over a node for the seam
itself, so a seam that many chapters share costs one link for each, not one for
each pair. Components of one size and one story (the least of their stories)
are interchangeable; they are counted in bundles, min-cost flows with costs for
deviations from the quotas give each bundle's components to the splits, and
which component goes where is decided by its hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakloom.llm.canon import look_alike
from wakloom.llm.components import components
from wakloom.llm.flow import allocate
from wakloom.session import settle

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def seam_links(stanza: DataFrame) -> DataFrame:
    """a (chapter), b (seam): which chapters meet at which seam.

    A seam is (story, row, look of the line). A chapter meets it from behind
    when it has a row at row + 1 but none at row and names the line in prev_w4,
    from the front when its w4 at row is the line. Only seams met from both
    sides link. Null stories, chapters, rows and lines link nothing.
    """
    rows = stanza.select("story", "chapter", "row", "w4", "prev_w4").where("story is not null and chapter is not null and row is not null")
    here = rows.select("chapter", "row").distinct()
    heads = rows.where("prev_w4 is not null").select("story", "chapter", (F.col("row") - 1).alias("row"), F.col("prev_w4").alias("line"))
    heads = heads.join(here, ["chapter", "row"], "left_anti").distinct().withColumn("behind", F.lit(True))
    # Only lines at a row that some head asks for are folded.
    wanted = heads.select("story", "row").distinct()
    fronts = rows.where("w4 is not null").select("story", "chapter", "row", F.col("w4").alias("line")).join(wanted, ["story", "row"], "left_semi").distinct().withColumn("behind", F.lit(False))
    met = heads.select("story", "chapter", "row", "line", "behind").unionAll(fronts.select("story", "chapter", "row", "line", "behind")).withColumn("look", look_alike("line")).where("look <> ''")
    met = met.select("chapter", "behind", F.concat_ws("\u0001", F.lit("\u0002seam"), F.xxhash64("story", "row", "look").cast("string"), "story", F.col("row").cast("string"), "look").alias("seam")).distinct()
    both = met.groupBy("seam").agg(F.bool_or("behind").alias("x"), F.bool_and("behind").alias("y")).where("x and not y")
    return met.join(both, "seam", "left_semi").select(F.col("chapter").alias("a"), F.col("seam").alias("b"))


def chapter_groups(stanza: DataFrame) -> DataFrame:
    """chapter, root: linked chapters with the name of their component."""
    found = settle(components(seam_links(stanza)), "groups")
    # A component is named after a chapter: its least one.
    chapters = found.where(~F.col("node").startswith("\u0002seam"))
    names = chapters.groupBy("root").agg(F.min("node").alias("name"))
    return chapters.join(names, "root").select(F.col("node").alias("chapter"), F.col("name").alias("root"))


def members(groups: DataFrame) -> DataFrame:
    """chapter, root, n_chapters: the whole result without pairs, one row a linked chapter."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n_chapters"))
    return groups.join(sizes, "root").select("chapter", "root", "n_chapters")


def linked_pairs(groups: DataFrame) -> DataFrame:
    """chapter_a, chapter_b: all pairs of chapters of one component."""
    a, b = groups.select("root", F.col("chapter").alias("chapter_a")), groups.select("root", F.col("chapter").alias("chapter_b"))
    return a.join(b, "root").where("chapter_a < chapter_b").select("chapter_a", "chapter_b")


def assign_splits(stanza: DataFrame, shares: dict[str, float] | None = None, label: str = "story") -> DataFrame:
    """chapter, split: every chapter, null as one chapter of its own, in exactly one split.

    Shares are of rows, over all and within each label as far as the sizes
    allow. The result is the same in every run.
    """
    shares = shares or SPLITS
    groups = chapter_groups(stanza)
    sizes = stanza.groupBy("chapter").agg(F.count("*").alias("n"), F.min(label).alias("label"))
    members = sizes.join(groups, "chapter", "left").withColumn("root", F.coalesce("root", "chapter", F.lit("")))
    parts = settle(members.groupBy("root").agg(F.sum("n").alias("size"), F.coalesce(F.min("label"), F.lit("")).alias("label")), "parts")
    keyed = parts.select("root", F.col("size").alias("bundle_size"), F.col("label").alias("bundle_label"))
    # One row for each label and size: unlike sizes add up, so a label of n rows has no more than the root of 2 n of them.
    bundles = sorted((r.bundle_label, r.bundle_size, r.n) for r in keyed.groupBy("bundle_size", "bundle_label").agg(F.count("*").alias("n")).collect())
    plan = allocate(bundles, shares)
    # Rank of a component within its bundle by hash: counts of hash slots first, so no bundle is sorted in one task.
    keyed = keyed.withColumn("h", F.xxhash64("root")).withColumn("slot", F.shiftrightunsigned("h", 56).cast("int"))
    key = ["bundle_label", "bundle_size"]
    slots = keyed.groupBy(*key, "slot").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a bundle
    slots = slots.select(*key, "slot", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*key, "slot").orderBy("h", "root")
    ranked = keyed.withColumn("r", F.row_number().over(inside)).join(slots, [*key, "slot"]).withColumn("rank", F.col("r") + F.col("before"))
    spark = stanza.sparkSession
    ends = spark.createDataFrame([(lab, int(size), list(map(int, cum))) for (lab, size, _), cum in zip(bundles, plan, strict=True)] or [("", 0, [0])], "bundle_label string, bundle_size long, ends array<long>")
    names = F.array(*[F.lit(s) for s in shares])
    which = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    roots = ranked.join(ends, key).select("root", F.element_at(names, which + 1).alias("split"))
    return members.join(roots, "root").select("chapter", "split")


def split_rows(stanza: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """stanza_id, split: every row with the split of its chapter."""
    plan = assign_splits(stanza, shares)
    return stanza.select("stanza_id", "chapter").join(plan.withColumnRenamed("chapter", "c"), F.col("chapter").eqNullSafe(F.col("c"))).select("stanza_id", "split")
