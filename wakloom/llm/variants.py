"""Records whose text prints like another's but is written differently.

Each distinct text is folded once, however often it stands in the table; only
texts that differ from the first of their look are joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakloom.llm.canon import look_alike
from wakloom.session import settle


def written_variants(df: DataFrame, id_col: str, text_col: str, src: str) -> DataFrame:
    """src, first_id, other_id.

    first_id is the smallest id among the texts of one look; other_id each
    record whose stored text is unlike that of first_id, code point by code
    point. Null and empty texts are left out; texts of blanks or invisible
    characters only look the same as each other.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    # Folded once: the table of distinct texts is read for the first of each look and for the others.
    texts = settle(rows.groupBy("text").agg(F.min("id").alias("id")).withColumn("look", look_alike("text")), "looks")
    first = texts.groupBy("look").agg(F.min("id").alias("first_id"), F.min_by("text", "id").alias("first_text"), F.count("*").alias("n")).where("n > 1")
    other = texts.join(first, "look").where("text <> first_text").select("text", "first_id")
    return rows.join(other, "text").select(F.lit(src).alias("src"), "first_id", F.col("id").alias("other_id"))


def one_form(df: DataFrame, id_col: str, text_col: str, src: str) -> DataFrame:
    """src, id, text, form: every record with the one form of its text (null for null)."""
    return df.select(F.lit(src).alias("src"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), look_alike(text_col).alias("form"))
