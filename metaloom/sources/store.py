"""Cutting long lineages: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a job's shuffle files once it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="spark-shared-")
    return folder.rstrip("/")


def keeps_texts_once(spark: SparkSession) -> None:
    """Lets the session's Parquet writers keep long texts that repeat: equal ones once, in dictionaries of up to 64 MB in place of 1, and texts that begin alike by zstd, whose window is longer than they are. What the user has set stays."""
    for key, value in (("parquet.dictionary.page.size", str(64 << 20)), ("spark.sql.parquet.compression.codec", "zstd")):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def written(df: DataFrame, name: str = "cut", *by: str) -> str:
    """The path of a new Parquet table in the shared folder with the rows of df, in a folder for each value of `by`. It replaces the job's shuffle files, which go."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cut/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path


def cut(df: DataFrame, name: str = "cut", *by: str) -> DataFrame:
    """df written to spark.checkpoint.dir as Parquet and read again: a lost executor costs a reread."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, *by))
