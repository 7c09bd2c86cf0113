"""Files as rows: digests, sizes and result sinks that refuse to overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of every file below a folder; Spark makes no row of an empty one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def write_logits(logits: DataFrame, path: str) -> None:
    """``(case_id, pos, logits)`` as Parquet in a new folder."""
    logits.write.mode("error").parquet(path)
