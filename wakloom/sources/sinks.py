"""Writers of the verse formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakloom.functions.text import work_of
from wakloom.operators.dictionary import upsert


# Names of the four lines of a stanza.
WAK_NAMES = ("วรรคสดับ", "วรรครับ", "วรรครอง", "วรรคส่ง")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of CSV parts, quotes doubled inside quotes."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', quoteAll=False, emptyValue="")


def write_by_work(stanzas: DataFrame, path: str) -> None:
    """w1..w4 under work=.../chapter=... folders; rows of a chapter stay in order."""
    out = stanzas.withColumn("work", work_of("chapter")).repartition("work", "chapter").sortWithinPartitions("work", "chapter", "row")
    out.select("work", "chapter", "w1", "w2", "w3", "w4").write.mode("overwrite").partitionBy("work", "chapter").csv(path, header=True, escape='"')


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def restore(spark: SparkSession, path: str) -> None:
    """Puts back the version set aside by a swap that was broken off."""
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(f"{path}.old")):
        fs.rename(hadoop(f"{path}.old"), hadoop(path))


def _swap(spark: SparkSession, source: str, target: str) -> None:
    """source in the place of target. The old version is deleted only when the new one stands; see restore."""
    hadoop, fs = _file_system(spark, target)
    old = hadoop(f"{target}.old")
    if fs.exists(hadoop(target)):
        fs.delete(old, True)
        if not fs.rename(hadoop(target), old):
            raise OSError(f"cannot set {target} aside")
    if not fs.rename(hadoop(source), hadoop(target)):
        restore(spark, target)
        raise OSError(f"cannot move {source} to {target}")
    fs.delete(old, True)


def save_answers(existing: DataFrame, answers: DataFrame, path: str, key: list[str]) -> int:
    """A new version of the answers beside the old one, then put in its place. Nothing is written without answers."""
    n = answers.count()
    if n:
        spark, new = answers.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
        upsert(existing, answers, key).write.json(new)
        _swap(spark, new, path)
    return n


def literal_lines(entries: DataFrame) -> DataFrame:
    """Dictionary entries as lines of a literal: word, line."""
    quoted = F.concat(F.lit('["'), F.array_join("syllables", '", "'), F.lit('"]'))
    return entries.select("word", F.concat(F.lit('    "'), "word", F.lit('": '), quoted, F.lit(",")).alias("line"))


def chunks_done(spark: SparkSession, path: str) -> set[int]:
    """The numbers of the chunks that are written. A job's chunks appear when it commits."""
    hadoop, fs = _file_system(spark, path)
    found = fs.listStatus(hadoop(path)) if fs.exists(hadoop(path)) else []
    return {int(f.getPath().getName()[6:]) for f in found if f.isDirectory() and f.getPath().getName().startswith("chunk=")}


def write_chunks(df: DataFrame, path: str, chunk: str, n: int) -> list[int]:
    """Chunks 0..n-1, each a folder chunk=k, those already written left as they are: one pass, one write. The numbers written now."""
    todo = sorted(set(range(n)) - chunks_done(df.sparkSession, path))
    if todo:
        rows = df.withColumnRenamed(chunk, "chunk").where(F.col("chunk").isin(todo))
        rows.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)
    return todo


def write_report(reports: DataFrame, path: str, key: list[str], kind: int, lines: str = "line_reports", texts: str = "texts") -> None:
    """One row a line of a report: key, klon_type, line, wak_name, text, syllables, rhythm, status."""
    names = F.array(*[F.lit(x) for x in WAK_NAMES])
    each = reports.select(*key, F.posexplode(F.arrays_zip(F.col(lines).alias("r"), F.col(texts).alias("t"))).alias("at", "x"))
    rhythm = F.coalesce(F.when(F.col("x.r.rhythm").isNotNull(), F.array_join(F.transform("x.r.rhythm", lambda b: b.cast("string")), "–")), F.lit("—"))
    out = each.select(*key, F.lit(kind).alias("klon_type"), (F.col("at") + 1).alias("line"), F.get(names, F.col("at") % 4).alias("wak_name"), F.col("x.t").alias("text"), F.col("x.r.n_syllables").alias("syllables"), rhythm.alias("rhythm"), F.col("x.r.status").alias("status"))
    write_csv(out, path)


def write_screen(entries: DataFrame, path: str) -> None:
    """word, freq, syllables, flags, bucket, context, parted by tabs."""
    write_csv(entries.select("word", "freq", F.array_join("syllables", "-").alias("syllables"), F.array_join("flags", "; ").alias("flags"), "bucket", "context"), path, sep="\t")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; nulls left out."""
    df.write.mode("overwrite").json(path)
