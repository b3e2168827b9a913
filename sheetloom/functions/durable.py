"""Write a shared intermediate once so several branches read one copy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; only a local session without that setting gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, rows_per_file: int = 100_000) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder.

    Files hold ``rows_per_file`` rows at most, so that later scans spread over all cores
    however few tasks wrote the table.  Unlike cached blocks the copy survives lost executors, and later branches
    still get column pruning and pushed filters.  It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
