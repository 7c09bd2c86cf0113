"""Sets of bit ordinals: planes, portable Roaring sizes, bytes to bits and back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType

#: Bits of the largest payload.
MOST_BITS = 8 * (64 << 20)
#: Bytes of which the ordinals are held at once; they take up to 64 times as many.
STEP = 1 << 16


@pandas_udf(ArrayType(LongType()))
def plane_ordinals(codes: pd.Series, bits: pd.Series) -> pd.Series:
    """Ordinals of the ones, plane after plane: bit b of value i lies at b * n + i."""

    def one(c, b) -> np.ndarray | None:
        return None if c is None else np.flatnonzero((np.asarray(c, np.int64)[None, :] >> np.arange(int(b))[:, None]) & 1)

    return pd.Series([one(c, b) for c, b in zip(codes, bits, strict=True)])


@pandas_udf(LongType())
def roaring_size(ordinals: pd.Series) -> pd.Series:
    """Bytes of the portable 64-bit Roaring form after run optimisation, of each ascending array of ordinals."""

    def one(values) -> int | None:
        if values is None:
            return None
        o = np.asarray(values, np.int64)
        total = 8
        for half in np.unique(o >> 32):
            own = o[(o >> 32) == half]
            _, first, card = np.unique(own >> 16, return_index=True, return_counts=True)
            fresh = np.ones(len(own), bool)
            fresh[1:] = np.diff(own) != 1
            fresh[first] = True
            runs = np.add.reduceat(fresh.astype(np.int64), first)
            plain, by_runs = np.where(card <= 4096, 2 * card, 8192), 2 + 4 * runs
            n, r = len(card), int((by_runs < plain).sum())
            header = 4 + -(-n // 8) + 4 * n + (4 * n if n >= 4 else 0) if r else 8 + 8 * n
            total += 4 + header + int(np.minimum(plain, by_runs).sum())
        return total

    return ordinals.map(one)


@pandas_udf(LongType())
def roaring_size_of_bytes(data: pd.Series) -> pd.Series:
    """The same of the set that :func:`bytes_to_ordinals` makes of some bytes, without making it."""
    step = 1 << 20

    def one(d) -> int | None:
        if d is None:
            return None
        halves: dict[int, list[int]] = {}
        for at in range(0, len(d) + 1, step):
            part = np.unpackbits(np.frombuffer(d, np.uint8, min(step, len(d) - at), at), bitorder="little").astype(bool)
            if at + step > len(d):
                part = np.append(part, True)  # the end mark
            box = np.zeros((-(-len(part) // 65536), 65536), bool)
            box.reshape(-1)[: len(part)] = part
            card = box.sum(1)
            runs = box[:, 0] + (box[:, 1:] & ~box[:, :-1]).sum(1)
            plain, by_runs = np.where(card <= 4096, 2 * card, 8192), 2 + 4 * runs
            there = card > 0
            own = halves.setdefault(8 * at >> 32, [0, 0, 0])
            own[0] += int(there.sum())
            own[1] += int((there & (by_runs < plain)).sum())
            own[2] += int(np.minimum(plain, by_runs)[there].sum())
        total = 8
        for n, r, body in halves.values():
            if n:
                total += 4 + body + (4 + -(-n // 8) + 4 * n + (4 * n if n >= 4 else 0) if r else 8 + 8 * n)
        return total

    return data.map(one)


#: Places of the sets that are looked at in one step.
BITS_AT_ONCE = 1 << 20


def _sizes(ones: np.ndarray) -> np.ndarray:
    """Portable 64-bit Roaring bytes of each row of bits, see :func:`roaring_size`."""
    m, n = ones.shape
    parts = -(-n // 65536)
    box = np.zeros((m, parts * 65536 if parts > 1 else n), bool)
    box[:, :n] = ones
    box = box.reshape(m, parts, -1)
    card = box.sum(2)
    runs = box[:, :, 0] + (box[:, :, 1:] & ~box[:, :, :-1]).sum(2)
    plain, by_runs = np.where(card <= 4096, 2 * card, 8192), 2 + 4 * runs
    there = card > 0
    short = there & (by_runs < plain)
    body = np.where(there, np.minimum(plain, by_runs), 0).sum(1)
    k, r = there.sum(1), short.sum(1)
    header = np.where(r > 0, 4 + -(-k // 8) + 4 * k + np.where(k >= 4, 4 * k, 0), 8 + 8 * k)
    return 8 + np.where(k > 0, 4 + header + body, 0)


def layout_sizes(rows: DataFrame, codes: str, bits: int) -> DataFrame:
    """``(interleaved, transposed)`` for each array of codes: bytes of its bits as a set, value after value and plane after plane.

    Arrays of one length are looked at together, some at a time; their ordinals are not made.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).drop_null()
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.cumsum(sizes)))
            for n in np.unique(sizes):
                own = first[:-1][sizes == n]
                if not n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), 8, np.int64))] * 2, ["interleaved", "transposed"])
                    continue
                step = max(1, BITS_AT_ONCE // (int(n) * bits))
                for at in range(0, len(own), step):
                    c = flat[own[at : at + step, None] + np.arange(n)].astype(np.int64)
                    ones = np.stack([(c >> b) & 1 for b in range(bits)], 1).astype(bool)  # by row, plane and value
                    both = (ones.transpose(0, 2, 1), ones)
                    yield pa.RecordBatch.from_arrays([pa.array(_sizes(o.reshape(len(c), -1)).astype(np.int64)) for o in both], ["interleaved", "transposed"])

    return rows.select(codes).mapInArrow(run, "interleaved bigint, transposed bigint")


def sized(card: Column, runs: Column) -> Column:
    """Body bytes of a container and whether runs are its cheapest form."""
    base = F.when(card <= 4096, 2 * card).otherwise(8192)
    by_runs = 2 + 4 * runs
    return F.struct(F.least(base, by_runs).cast("bigint").alias("body"), (by_runs < base).alias("run"))


def total_size(n: Column, with_runs: Column, body: Column) -> Column:
    """Bytes of one 32-bit half with n containers and its place in the 64-bit form; an empty set has the count only."""
    header = F.when(with_runs > 0, 4 + F.ceil(n / 8) + 4 * n + F.when(n >= 4, 4 * n).otherwise(0)).otherwise(8 + 8 * n)
    return (8 + F.when(n > 0, 4 + header + body).otherwise(0)).cast("bigint")


def roaring_size_of_rows(ordinals: DataFrame, keys: list[str]) -> DataFrame:
    """``bytes`` of each key's set of rows ``(keys, ordinal)``, for sets too large for an array."""
    order = Window.partitionBy(*keys, "container").orderBy("ordinal")
    rows = ordinals.withColumn("container", F.shiftright("ordinal", 16))
    rows = rows.withColumn("starts", F.when(F.col("ordinal") - F.lag("ordinal").over(order) == 1, 0).otherwise(1))
    each = rows.groupBy(*keys, "container").agg(F.count("*").alias("card"), F.sum("starts").alias("runs")).withColumn("s", sized(F.col("card"), F.col("runs")))
    half = each.groupBy(*keys, F.shiftright("container", 16).alias("half")).agg(F.count("*").alias("n"), F.sum(F.col("s.run").cast("int")).alias("r"), F.sum("s.body").alias("body"))
    return half.groupBy(*keys).agg((8 + F.sum(total_size(F.col("n"), F.col("r"), F.col("body")) - 8)).alias("bytes"))


def _ordinals(data) -> np.ndarray:
    return np.append(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")), 8 * len(data))


def _bytes(ordinals) -> bytes | None:
    if ordinals is None or not len(ordinals) or ordinals[-1] % 8 or ordinals[-1] > MOST_BITS:
        return None
    bits = np.zeros(int(ordinals[-1]), np.uint8)
    bits[np.asarray(ordinals[:-1], np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


@pandas_udf(ArrayType(LongType()))
def bytes_to_ordinals(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ordinals of the ones, low bit of each byte first, and a last one just past the data.

    A batch is answered in parts, so that no more is held than the ordinals of ``STEP`` bytes or of one value.
    """
    for data in batches:
        ends = data.map(lambda d: 0 if d is None else len(d)).cumsum() // STEP
        for _, part in data.groupby(ends, sort=False):
            yield part.map(lambda d: None if d is None else _ordinals(d))


@pandas_udf(BinaryType())
def ordinals_to_bytes(ordinals: pd.Series) -> pd.Series:
    """The bytes of such a set; null unless the last ordinal is byte aligned and within 64 MiB."""
    return ordinals.map(_bytes)


def _there_and_back(data) -> tuple[int, int, bool]:
    """Ones and end mark of some bytes, and whether the bytes come back from their ordinals; ``STEP`` bytes at a time."""
    ones, end, same = 0, 0, True
    for at in range(0, len(data), STEP):
        part = _ordinals(data[at : at + STEP])
        ones, end = ones + len(part) - 1, 8 * at + int(part[-1])
        same = same and _bytes(part) == data[at : at + STEP]
    return ones, end, same


def byte_round_trips(rows: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, ones, sentinel, same)`` of bytes of any size: what their ordinals count and end with, and whether they give the bytes back."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(None, None, None) if not d.is_valid else _there_and_back(memoryview(d.as_buffer()).cast("B")) for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], [key, "ones", "sentinel", "same"])

    return rows.select(key, data).mapInArrow(run, f"`{key}` {kind}, ones bigint, sentinel bigint, same boolean")


def _bit_is_set(b: int):
    return lambda c: F.shiftright(c, b).bitwiseAND(F.lit(1)) == 1


def plane_density(codes: DataFrame, codes_col: str, bits: int, keys: list[str]) -> DataFrame:
    """Ones and places of each bit plane, summed over rows."""
    parts = [F.struct(F.lit(b).alias("plane"), F.size(F.filter(codes_col, _bit_is_set(b))).alias("ones"), F.size(codes_col).alias("total")) for b in range(bits)]
    planes = F.explode(F.array(*parts))
    return codes.select(*keys, planes.alias("p")).groupBy(*keys, "p.plane").agg(F.sum("p.ones").alias("ones"), F.sum("p.total").alias("total"))
