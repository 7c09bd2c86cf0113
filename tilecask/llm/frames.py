"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete_folder, folders, new_folder, shared_dir

#: Folders that :func:`stored` has written, for each open :func:`temporaries`.
_written: list[list[str]] = []


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what operators have stored and checkpointed in the shared folder meanwhile; results must have been written by then."""
    shared_dir(spark)
    checkpoints = spark.sparkContext.getCheckpointDir()
    before = set(folders(spark, checkpoints))
    _written.append([])
    try:
        yield
    finally:
        own = _written.pop()
        for path in [*own, *(set(folders(spark, checkpoints)) - before)]:
            delete_folder(spark, path)


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of texts and sets stay small, unless the session has chosen a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(name, "4m")


def _merged(df: DataFrame, few: int) -> DataFrame:
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // few))


def settle(df: DataFrame, few: int = 1) -> DataFrame:
    """Cut the lineage of a table that several later steps read; of small rows ``few`` shuffle partitions make one file."""
    shared_dir(df.sparkSession)
    return (_merged(df, few) if few > 1 else df).checkpoint(eager=True)


def stored(df: DataFrame, few: int = 1) -> DataFrame:
    """The same for larger tables: compressed columns in a folder of its own, without a fixed order of partitions."""
    path = new_folder(df.sparkSession, "rows")
    for own in _written:
        own.append(path)
    (_merged(df, few) if few > 1 else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of all rows is heavy, so there are fewer than ``1 / HEAVY`` heavy keys.
HEAVY = 1 / 256
#: Places that the rows of a heavy key are dealt to.
SALTS = 64


def heavy_keys(sizes: DataFrame, keys: list[str], n: str) -> list[int]:
    """Hashes of the keys of ``(keys, n)``, one row for each key, that hold too large a share of all rows; fewer than 256 by their definition."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in sizes.where(F.col(n) > max(64, int(total * HEAVY))).select(F.xxhash64(*keys)).limit(round(1 / HEAVY)).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], heavy: list[int], by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by ``keys``, the left rows of heavy keys dealt to ``SALTS`` places by a hash of ``by``.

    The right rows of a heavy key are repeated for each place.  ``heavy`` comes from :func:`heavy_keys`; another key with such a
    hash is dealt as well, which does no harm.  ``how`` is inner, left or left_semi.
    """
    dealt = F.xxhash64(*keys).isin(heavy) if heavy else F.lit(False)
    absent = reduce(or_, (F.col(k).isNull() for k in keys)) if how == "left" else F.lit(False)  # meets nothing, wherever it is dealt to
    if not heavy and how != "left":
        return left.join(right, keys, how)
    left = left.withColumn("_salt", F.when(dealt | absent, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    places = F.when(dealt, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("_salt", F.explode(places)), [*keys, "_salt"], how).drop("_salt")


#: What operators keep in a Python worker from task to task.
WORKER_CACHES: list[dict] = []


def release_unused() -> None:
    """Give the system back what earlier tasks of this worker have freed, which allocators keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc has no such call
        ctypes.CDLL(None).malloc_trim(0)


def pieces_of(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the named column holds about ``most`` bytes in each.

    Workers serve one operator after another; what others than the present one keep is given up here.
    """
    for cache in WORKER_CACHES:
        if cache is not keep:
            cache.clear()
    release_unused()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = max(1, batch.column(column).nbytes)
        step = max(1, min(rows, rows * most // size))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
