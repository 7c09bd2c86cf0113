"""The shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Where none is named, as in tests, a local session gets a folder that goes with the process; on a
    cluster that is an error, since executors share no local folder.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tilecask-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name below the shared folder that nobody else has."""
    return f"{shared_dir(spark).rstrip('/')}/tilecask-{kind}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """The paths of all that lies in a folder."""
    where, fs = _file_system(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(where)] if fs.exists(where) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)
