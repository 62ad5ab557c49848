"""Sections, stanzas and windows of chapters, as window functions over line positions.

Lines are (chapter, pos, line, anchor): pos counts lines in their order, anchor
marks a line before which a new section begins. Lines of one text are one
window partition, as they come from one row; over tables of stanzas, where one
chapter may hold a large part of all rows, places over the whole table are used
instead of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakloom.functions.text import CONSONANT, cells, strip
from wakloom.operators.ranking import global_rank, with_neighbour

ANCHOR, END = "๏", "ฯ"


def chapter_lines(chapters: DataFrame, chapter: str, text: str, separators: str = "\\t\\r\\n") -> DataFrame:
    """chapter, pos (from 0), line, anchor of every line with a Thai consonant.

    Anchors and end marks are cut out of the line; an anchor on a cell of its
    own belongs to the next line. Null and empty texts have no line. A line is
    found together with the cells without consonants before it, so places and
    anchors are known within the row and nothing is shuffled. separators: the
    characters that part cells, as in a character class.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"[^ก-ฮ]*[ก-ฮ][^{separators}]*"), F.lit(0))
    parts = chapters.select(F.col(chapter).alias("chapter"), F.posexplode(found).alias("pos", "raw"))
    cell = F.regexp_replace("raw", f"(?s)^.*[{separators}]", "")
    return parts.select("chapter", "pos", strip(F.regexp_replace(cell, f"[{ANCHOR}{END}]", "")).alias("line"), F.col("raw").contains(ANCHOR).alias("anchor"))


def sections(lines: DataFrame) -> DataFrame:
    """lines with section (from 0), place in it (from 0) and its size.

    Lines before the first anchor are a section of their own; a chapter without
    anchors has no sections (null).
    """
    by = Window.partitionBy("chapter")
    run = F.sum(F.col("anchor").cast("int")).over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("run").over(by)
    some = F.max(F.col("anchor").cast("int")).over(by) == 1
    out = lines.withColumn("run", run).withColumn("section", F.when(some, F.col("run") - first))
    one = Window.partitionBy("chapter", "section")
    return out.drop("run").withColumn("place", F.row_number().over(one.orderBy("pos")) - 1).withColumn("size", F.count("*").over(one))


def section_sizes(lines: DataFrame) -> DataFrame:
    """chapter, section, start, n_lines, whole: whether the lines make whole stanzas."""
    return sections(lines).where("section is not null").groupBy("chapter", "section").agg(F.min("pos").alias("start"), F.count("*").alias("n_lines"), (F.count("*") % 4 == 0).alias("whole"))


def stanzas_in_sections(lines: DataFrame) -> DataFrame:
    """chapter, section, stanza, w1..w4. Sections of 4k lines, or of 4k + 3 less their opening three; others are left out."""
    rest = F.col("size") % 4
    body = sections(lines).where("section is not null").where(rest.isin(0, 3) & (F.col("place") >= rest))
    return _wide(body.withColumn("k", F.col("place") - rest), ["chapter", "section"])


def stanzas_of_chapters(lines: DataFrame) -> DataFrame:
    """chapter, stanza, w1..w4 over whole chapters.

    Three opening lines are left out if and only if the first section has
    4k + 3 lines; a tail of fewer than four lines is left out.
    """
    by = Window.partitionBy("chapter")
    cut = F.max(F.when((F.col("section") == 0) & (F.col("size") % 4 == 3), 3).otherwise(0)).over(by)
    body = sections(lines).withColumn("cut", cut).where("pos >= cut")
    return _wide(body.withColumn("k", F.col("pos") - F.col("cut")), ["chapter"])


def _wide(body: DataFrame, key: list[str]) -> DataFrame:
    pick = lambda i: F.max(F.when(F.col("k") % 4 == i, F.col("line"))).alias(f"w{i + 1}")
    return body.groupBy(*key, F.floor(F.col("k") / 4).cast("int").alias("stanza")).agg(F.count("*").alias("n"), *[pick(i) for i in range(4)]).where("n = 4").drop("n")


def sound_windows(stanzas: DataFrame, key: list[str], order: list[str], sound: Column, values: list[str], width: int = 2) -> DataFrame:
    """Windows of width consecutive sound rows, step one, within runs that nothing unsound breaks.

    key, order and v: an array of width structs of values. Places over the
    whole table take the part of windows over key, so that one group may hold
    any part of the rows: the row at the next place is the next of the run if
    it is sound and of the same key. The order must be total within a key.
    """
    whole = global_rank(stanzas.select(*key, *order, F.struct(*values).alias("_v0"), sound.alias("_ok")), [*key, *order], "_g")
    runs = whole.where("_ok")
    for i in range(1, width):
        runs = with_neighbour(runs, "_g", key, {f"_v{i}": "_v0"}, i)
    full = runs.where(" and ".join(f"_v{i} is not null" for i in range(width)))
    return full.select(*key, *order, F.array(*[f"_v{i}" for i in range(width)]).alias("v"))


def with_previous(stanzas: DataFrame, key: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The value of the row before in its group, null for the first. The order must be total within a key."""
    return with_neighbour(global_rank(stanzas, [*key, *order], "_g"), "_g", key, {name: column}, -1).drop("_g")


def chapter_bounds(stanzas: DataFrame, number: Column) -> DataFrame:
    """story, chapter, number, last line of it, next_chapter and its first second line."""
    ends = stanzas.groupBy("story", "chapter").agg(F.max_by("w4", F.struct("row", "stanza_id")).alias("last_w4"), F.min_by("w2", F.struct("row", "stanza_id")).alias("first_w2")).withColumn("number", number)
    w = Window.partitionBy("story").orderBy("number", "chapter")
    return ends.select("story", "chapter", "number", "last_w4", F.lead("chapter").over(w).alias("next_chapter"), F.lead("first_w2").over(w).alias("next_w2")).where("next_chapter is not null")


def beat_cells(segmented: Column, bar: str = r"\s*\|\s*") -> Column:
    """The three cells of a cut line: padded with empty ones, more than three cut off; null for null."""
    return cells(F.split(segmented, bar))


def training_rows(windows: DataFrame, key: list[str], lines: list[str] | None = None) -> DataFrame:
    """key and w1_a .. w8_c of windows of two stanzas (v, from sound_windows) whose lines are cut by bars."""
    lines = lines or ["w1", "w2", "w3", "w4"]
    out = [beat_cells(F.col("v")[i][w])[c].alias(f"w{4 * i + j + 1}_{'abc'[c]}") for i in (0, 1) for j, w in enumerate(lines) for c in range(3)]
    return windows.select(*key, *out)
