"""Readers of the verse formats: chapters, stanza tables, dictionaries, checkpoints.

All give DataFrames with fixed schemas; paths may be globs. A missing optional
file gives an empty table of the same schema.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakloom.functions.text import number_in, strip

# Columns of the training, review and checkpoint files.
BEATS = [f"w{i}_{c}" for i in range(1, 9) for c in "abc"]
QUEUE = ["wak", "syllables", "flag", "guess", "a", "b", "c"]
ENTRY = T.StructType([T.StructField("word", T.StringType()), T.StructField("syllables", T.ArrayType(T.StringType())), T.StructField("line_no", T.IntegerType())])
REVIEW = T.StructType([T.StructField("wak", T.StringType()), T.StructField("exclude", T.BooleanType()), T.StructField("rhythm", T.ArrayType(T.IntegerType())), T.StructField("segmented", T.StringType())])
UNIT = "id string, waks array<string>, fail string, score array<int>, repli array<int>"


def _stem(path):
    return F.regexp_extract(F.url_decode(path), r"([^/]+?)(\.[^./]*)?$", 1)


def _folder(path):
    return F.regexp_extract(F.url_decode(path), r"([^/]+)/[^/]+$", 1)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def chapters(spark: SparkSession, paths: str) -> DataFrame:
    """chapter (file name), story (folder), text: each file whole."""
    path = F.col("_metadata.file_path")
    return spark.read.text(paths, wholetext=True).select(_stem(path).alias("chapter"), _folder(path).alias("story"), F.col("value").alias("text"))


def csv(spark: SparkSession, paths: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header, line feeds in cells allowed, a byte-order mark ignored; strings, with path.

    Fails before reading when a file's header is not that of columns.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False, schema=schema)
    return df.select(*columns, F.col("_metadata.file_path").alias("path"))


def stanzas(spark: SparkSession, paths: str, suffix: str = "_ok") -> DataFrame:
    """story, chapter, number, row, w1..w4, prev_w4 of evaluation files, cells stripped.

    A file is one partition of the window, as row order is file order; number
    is the chapter's, for numeric order.
    """
    from pyspark.sql import Window

    raw = csv(spark, paths, ["w1", "w2", "w3", "w4"]).withColumn("_at", F.monotonically_increasing_id())
    w = Window.partitionBy("path").orderBy("_at")
    named = raw.select(_folder(F.col("path")).alias("story"), F.regexp_replace(_stem(F.col("path")), f"{suffix}$", "").alias("chapter"), (F.row_number().over(w) - 1).alias("row"), *[strip(c).alias(c) for c in ("w1", "w2", "w3", "w4")])
    prev = F.lag("w4").over(Window.partitionBy("story", "chapter").orderBy("row"))
    return named.withColumn("number", number_in("chapter")).withColumn("prev_w4", prev)


def training(spark: SparkSession, paths: str) -> DataFrame:
    """The 24 beats of each training row with its chapter."""
    df = csv(spark, paths, BEATS)
    return df.select(*BEATS, F.regexp_replace(_stem(F.col("path")), "_ok$", "").alias("chapter"))


def corpus_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line a row: its cells that hold something, joined."""
    return df.select(F.concat_ws("", *columns).alias("line"))


def review_queue(spark: SparkSession, paths: str) -> DataFrame:
    return csv(spark, paths, QUEUE).drop("path")


def pronunciations(spark: SparkSession, paths: str) -> DataFrame:
    """word, counts: how many syllables each reading has, the first reading first, repeats left out."""
    rows = spark.read.text(paths).select("value", F.monotonically_increasing_id().alias("at")).select(F.split("value", r"\t+|\s{2,}", 2).alias("p"), "at").where("size(p) = 2")
    n = F.size(F.filter(F.split(F.col("p")[1], r" \. "), lambda x: F.trim(x) != ""))
    rows = rows.select(strip(F.col("p")[0]).alias("word"), n.alias("n"), "at").where("word <> '' and n > 0")
    first = rows.groupBy("word", "n").agg(F.min("at").alias("at"))
    # A word has few counts, so its list is short.
    return first.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("counts"))


def sound_list(spark: SparkSession, paths: str) -> DataFrame:
    """word, ipa, syllables of lists with a word and its sounds, parted by a tab or blanks; blank and shorter lines left out.

    A syllable ends at a full stop between blanks.
    """
    rows = spark.read.text(paths).select(strip("value").alias("v"))
    word, ipa = F.regexp_extract("v", r"^(\S+)\s+(.*)$", 1), F.regexp_extract("v", r"^(\S+)\s+(.*)$", 2)
    made = rows.select(word.alias("word"), ipa.alias("ipa")).where("word <> '' and ipa <> ''")
    return made.withColumn("syllables", F.filter(F.transform(F.split("ipa", r"\s\.\s"), strip), lambda x: x != ""))


def documents_json(spark: SparkSession, paths: str, schema: T.StructType | str) -> DataFrame:
    """Instances, verdicts or metrics: JSON documents, a list of objects or one object a file; fields that are missing are null."""
    return spark.read.schema(schema).json(paths, multiLine=True)


def vocabulary(lists: list[DataFrame], column: str, cut) -> DataFrame:
    """syllable: the distinct syllables of word lists, of all their words. cut: words to arrays of syllables."""
    words = [x.select(F.col(column).alias("w")).where("w is not null") for x in lists]
    all_ = reduce(lambda a, b: a.unionAll(b), words).distinct()
    return all_.select(F.explode(cut(F.col("w"))).alias("syllable")).where("syllable <> ''").distinct()


def dictionary_literal(spark: SparkSession, path: str) -> DataFrame:
    """word, syllables, line_no of every entry of a dictionary literal in a Python file.

    The file is parsed, never run; of a repeated word every entry comes out.
    Such files are written by hand and small; keep dictionaries as Parquet.
    """
    text = spark.read.text(path, wholetext=True).first()
    rows = []
    for node in ast.walk(ast.parse(text[0] if text else "")):
        if isinstance(node, ast.Dict):
            for k, v in zip(node.keys, node.values, strict=True):
                if isinstance(k, ast.Constant) and isinstance(k.value, str) and isinstance(v, (ast.List, ast.Tuple)):
                    rows.append((k.value, [str(x.value) for x in v.elts if isinstance(x, ast.Constant)], k.lineno))
    return spark.createDataFrame(rows, ENTRY)


def review_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Answers to lines, one JSON object a line; empty where there is no file."""
    return spark.read.schema(REVIEW).json(path) if _exists(spark, path) else spark.createDataFrame([], REVIEW)


def checkpoint_map(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept as one JSON object from line to answer."""
    if not _exists(spark, path):
        return spark.createDataFrame([], REVIEW)
    answer = "struct<exclude:boolean,rhythm:array<int>,segmented:string>"
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{answer}>").alias("m"))
    return parsed.select(F.explode("m").alias("wak", "x")).select("wak", F.coalesce("x.exclude", F.lit(False)).alias("exclude"), "x.rhythm", "x.segmented")


def units(spark: SparkSession, paths: str) -> DataFrame:
    """Scored units, one JSON object a line; a line that is no JSON comes out with fail set."""
    raw = spark.read.text(paths).select(F.from_json("value", UNIT).alias("u"), "value")
    return raw.select("u.id", "u.waks", F.when(F.col("u.id").isNull(), F.lit("unreadable")).otherwise(F.col("u.fail")).alias("fail"), "u.score", "u.repli")
