"""Bit views that Spark SQL has no expression for, as Arrow UDFs over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType


@pandas_udf(ArrayType(LongType()))
def float_bits(values: pd.Series) -> pd.Series:
    """The 32-bit patterns of each array's floats."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float32).view(np.uint32).astype(np.int64))


@pandas_udf(ArrayType(FloatType()))
def floats_of(bits: pd.Series) -> pd.Series:
    """Floats with these 32-bit patterns."""
    return bits.map(lambda v: None if v is None else np.asarray(v, np.int64).astype(np.uint32).view(np.float32))


@pandas_udf(ArrayType(FloatType()))
def bf16_decode(words: pd.Series) -> pd.Series:
    """16-bit brain floats to floats."""
    return words.map(lambda v: None if v is None else (np.asarray(v, np.int64).astype(np.uint32) << 16).view(np.float32))


@pandas_udf(BinaryType())
def pack_codes(codes: pd.Series, bits: pd.Series) -> pd.Series:
    """Codes of 1, 2, 4 or 8 bits, low bits first, without gaps."""

    def one(c, b):
        flat = (np.asarray(c, np.uint8)[:, None] >> np.arange(b)) & 1
        return np.packbits(flat.reshape(-1).astype(np.uint8), bitorder="little").tobytes()

    return pd.Series([None if c is None else one(c, int(b)) for c, b in zip(codes, bits, strict=True)])


@pandas_udf(BinaryType())
def pack_floats(values: pd.Series, width: pd.Series) -> pd.Series:
    """Floats, low byte first, in four bytes each or, as brain floats, in the upper two."""

    def one(v, w):
        words = np.asarray(v, np.float32).view(np.uint32)
        return (words >> 16).astype("<u2").tobytes() if w == 2 else words.astype("<u4").tobytes()

    return pd.Series([None if v is None else one(v, int(w)) for v, w in zip(values, width, strict=True)])


@pandas_udf(ArrayType(IntegerType()))
def unpack_codes(data: pd.Series, bits: pd.Series, n: pd.Series) -> pd.Series:
    """The first n codes of packed bytes."""

    def one(d, b, k):
        flat = np.unpackbits(np.frombuffer(d, np.uint8), bitorder="little")[: k * b].reshape(k, b)
        return (flat.astype(np.int32) << np.arange(b)).sum(1)

    return pd.Series([None if d is None else one(d, int(b), int(k)) for d, b, k in zip(data, bits, n, strict=True)])


def bf16_exact(bits: Column) -> Column:
    """Whether every 32-bit pattern has a zero lower half."""
    return F.forall(bits, lambda b: b.bitwiseAND(F.lit(0xFFFF)) == 0)


def padded(values: Column, multiple: int, fill: float = 0.0) -> Column:
    """An array filled up to a multiple of a block."""
    missing = F.pmod(-F.size(values), F.lit(multiple))
    return F.concat(values, F.array_repeat(F.lit(fill).cast("float"), missing))
