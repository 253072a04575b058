"""Reading the Parquet tables that stand in for the library's own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process (tests).

    On a cluster executors don't share such a folder: there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """df on as many tasks as the session has cores, where its scan has fewer splits (a small file of one row group); else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _stored_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored. Results that read them must have been read or written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stored_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; drop_stored deletes it too."""
    return f"{_stored_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: its lineage ends there.

    The tables of an application lie in one folder, which drop_stored deletes.
    """
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
