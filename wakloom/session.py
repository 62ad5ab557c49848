"""Session settings, table access and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def build(app: str = "wakloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on: adaptive plans and Arrow exchange."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in spark.checkpoint.dir.

    Where none is named, a local session gets one of its own; a cluster's
    executors would not see it, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="wakloom-")
    return _OWN[app]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives executors.

    The folder is deleted when the driver ends, as results may read it until
    then; forget deletes it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wakloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def forget(*settled: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for df in settled:
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
