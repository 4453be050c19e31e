"""Objects in the shared store: what is there, copies, and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes, sha256 of each data file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def copied(spark: SparkSession, source: str, target: str) -> bool:
    """Copy an object or a folder of the store to another name."""
    (a, one), (b, other) = _path(spark, source), _path(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(one, a, other, b, False, spark._jsc.hadoopConfiguration())


def deleted(spark: SparkSession, name: str) -> bool:
    """Whether there was something to delete."""
    path, system = _path(spark, name)
    return system.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path, system = _path(spark, name)
    return system.exists(path)
