"""Tables between steps, written to the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and one machine does all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-steps/{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession, label: str) -> str:
    """A new path for this application in the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_stored(spark: SparkSession) -> None:
    """Delete every table that this application has stored between steps; call it once its results are saved."""
    target = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))  # noqa: SLF001 - the file system behind any Spark path
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)  # noqa: SLF001


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it again: cuts lineage and survives lost executors."""
    path = path or own_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
