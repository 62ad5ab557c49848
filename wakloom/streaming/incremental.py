"""Work that goes on where it stopped: files as they arrive, changed rows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def process_new_files(spark: SparkSession, source: str, schema: T.StructType | str, work: Callable[[DataFrame], DataFrame], target: str, state: str, file_format: str = "parquet") -> None:
    """work on every file of source not yet processed, appended to target; then stop.

    What is done is kept in state: a second call does nothing for the same
    files, and a call that was broken off is resumed without loss or doubling.
    """
    stream = spark.readStream.schema(schema).format(file_format).load(source)
    work(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def content_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with _key, a hash of the contents of columns; null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.withColumn("_key", F.sha2(F.concat_ws("\u0001", *parts), 256))


def changed_rows(now: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of now whose contents no row of before has."""
    known = content_key(before, columns).select("_key").distinct()
    return content_key(now, columns).join(known, "_key", "left_anti").drop("_key")


def keep_latest(spark: SparkSession, source: str, schema: T.StructType | str, key: list[str], order: str, target: str, state: str) -> None:
    """A table with the latest row of each key, kept up with new files of source; ties go to either row.

    A batch writes a new version from the one before; versions older than that
    are deleted, the one before stays for a batch that must be done again.
    """
    def merge(batch: DataFrame, n: int) -> None:
        both = batch
        if n:
            both = batch.unionByName(spark.read.parquet(f"{target}/v={n - 1}"))
        rest = [c for c in batch.columns if c not in key]
        both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*").write.mode("overwrite").parquet(f"{target}/v={n}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={n - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts in windows of event time; rows more than late behind are left out when streaming."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
