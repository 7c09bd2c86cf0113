"""Compact quantisation: one group for the whole axis, dense codes of 1, 2 or 4 bits, exact tail."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from ..functions.bits import bf16_exact, float_bits, pack_codes, pack_floats
from . import tensor


@dataclass(frozen=True)
class CompactPolicy:
    """Width of the codes, the axis of the groups and the length of the exact tail."""

    axis: str
    bits: int = 4
    tail: int = 32

    def __post_init__(self) -> None:
        if self.bits not in (1, 2, 4) or self.tail < 0:
            raise Invalid(f"policy {self}")


def two_centroids(values: Column, rounds: int = 8) -> Column:
    """``struct(low, high)`` after Lloyd rounds from the extremes; a round that empties a side is not taken."""
    x = F.transform(values, lambda v: v.cast("double"))

    def mean(side: Column) -> Column:
        return F.aggregate(side, F.lit(0.0).cast("double"), lambda s, v: s + v) / F.size(side)

    def step(c: Column, _: Column) -> Column:
        middle = (c["low"] + c["high"]) / 2
        low, high = F.filter(x, lambda v: v <= middle), F.filter(x, lambda v: v > middle)
        moved = F.struct(mean(low).alias("low"), mean(high).alias("high"))
        return F.when((F.size(low) > 0) & (F.size(high) > 0), moved).otherwise(c)

    start = F.struct(F.array_min(x).alias("low"), F.array_max(x).alias("high"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.struct(done["low"].cast("float").alias("low"), done["high"].cast("float").alias("high"))


def parameters(values: Column, bits: int) -> Column:
    """``struct(a, b)`` as floats: both centroids for one bit, else minimum and step."""
    if bits == 1:
        c = two_centroids(values)
        return F.struct(c["low"].alias("a"), c["high"].alias("b"))
    low, high = F.array_min(values).cast("float"), F.array_max(values).cast("float")
    step = ((high.cast("double") - low.cast("double")) / F.lit(float((1 << bits) - 1))).cast("float")
    return F.struct(low.alias("a"), step.alias("b"))


def codes(values: Column, p: Column, bits: int) -> Column:
    a, b = p["a"].cast("double"), p["b"].cast("double")
    if bits == 1:
        return F.transform(values, lambda v: (v.cast("double") > (a + b) / 2).cast("int"))
    top = (1 << bits) - 1
    return F.transform(values, lambda v: F.when(b == 0, F.lit(0)).otherwise(F.least(F.greatest(F.round((v.cast("double") - a) / b), F.lit(0.0)), F.lit(float(top))).cast("int")))


def decoded(code: Column, p: Column, bits: int) -> Column:
    a, b = p["a"].cast("double"), p["b"].cast("double")
    if bits == 1:
        return F.transform(code, lambda c: F.when(c == 1, p["b"]).otherwise(p["a"]))
    return F.transform(code, lambda c: (a + c * b).cast("float"))


def encode(groups: DataFrame, policy: CompactPolicy) -> DataFrame:
    """Parameters, codes and packed bytes of groups ``(tile_id, grp, values, tail)``.

    ``tail`` has the elements kept exactly; a tile's tail may be stored as brain floats if every
    one of its words allows it.
    """
    p = parameters(F.col("values"), policy.bits)
    rows = groups.where(F.size("values") > 0).withColumn("p", p)
    rows = rows.withColumn("codes", codes(F.col("values"), F.col("p"), policy.bits))
    return rows.select("tile_id", "grp", "values", "p", "codes", pack_codes("codes", F.lit(policy.bits)).alias("packed"), F.ceil(F.size("codes") * policy.bits / 8).alias("packed_bytes"))


def tail_dtype(groups: DataFrame) -> DataFrame:
    """``(tile_id, dtype)`` of the exact tail."""
    exact = bf16_exact(float_bits("tail"))
    return groups.groupBy("tile_id").agg(F.when(F.bool_and(exact), "bf16-le").otherwise("f32-le").alias("dtype"))


def split(tiles: DataFrame, policy: CompactPolicy, token_axis: str = "token") -> DataFrame:
    """``(tile_id, grp, values, tail)`` of tiles: each group's elements in order, those of the last tokens apart.

    A group runs along the whole axis; the tail is told for each element, so a group may have both.
    """
    whole = tensor.MOST_ELEMENTS
    long = tensor.with_groups(tensor.long_form(tiles), token_axis, whole).withColumn("late", F.col("along") >= F.col("width") - policy.tail)
    rows = tensor.with_groups(long.select("tile_id", "shape", "axes", "idx", "v", "late"), policy.axis, whole)
    parts = F.array_sort(F.collect_list(F.struct("along", "v", "late")))
    rows = rows.groupBy("tile_id", "grp").agg(parts.alias("p"))
    of = lambda late: F.transform(F.filter("p", lambda x: x["late"] == F.lit(late)), lambda x: x["v"])
    return rows.select("tile_id", "grp", of(False).alias("values"), of(True).alias("tail"))


#: The kinds of the stored columns.
STORED = "codes binary, parameters binary, tail binary, tail_dtype string"


def encode_tiles(tiles: DataFrame, policy: CompactPolicy, token_axis: str = "token") -> DataFrame:
    """``(tile_id, shape, axes, codes, parameters, tail, tail_dtype)``: dense codes of all groups, two floats for each group that has any, and the exact tail.

    The tail is of brain floats if all of its words allow it.
    """
    groups = split(tiles, policy, token_axis).withColumn("p", F.when(F.size("values") > 0, parameters(F.col("values"), policy.bits)))
    groups = groups.withColumn("codes", F.when(F.size("values") > 0, codes(F.col("values"), F.col("p"), policy.bits)).otherwise(F.array().cast("array<int>")))
    each = groups.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("grp", "codes", "p", "tail"))).alias("g"))
    flat = lambda f: F.flatten(F.transform("g", f))
    pairs = flat(lambda x: F.when(x["p"].isNull(), F.array().cast("array<float>")).otherwise(F.array(x["p"]["a"], x["p"]["b"])))
    each = each.select("tile_id", flat(lambda x: x["codes"]).alias("codes"), pairs.alias("pairs"), flat(lambda x: x["tail"]).alias("exact"))
    if not each.where(F.exists("pairs", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).isEmpty():
        raise Invalid("parameters are not finite")
    dtype = F.when(bf16_exact(float_bits("exact")) & (F.size("exact") > 0), "bf16-le").otherwise("f32-le")
    each = each.withColumn("tail_dtype", dtype)
    out = each.select("tile_id", pack_codes("codes", F.lit(policy.bits)).alias("codes"), pack_floats("pairs", F.lit(4)).alias("parameters"), pack_floats("exact", F.when(F.col("tail_dtype") == "bf16-le", 2).otherwise(4)).alias("tail"), "tail_dtype")
    return tiles.select("tile_id", "shape", "axes").join(out, "tile_id")


def _decoded_tile(shape: list[int], axes: list[str], policy: CompactPolicy, token_axis: str, codes_: bytes, parameters_: bytes, tail: bytes, dtype: str) -> np.ndarray:
    """The values of one tile in order; whatever does not fit is corrupt."""
    n, bits = int(np.prod(shape)), policy.bits
    if policy.axis not in axes or token_axis not in axes or dtype not in ("bf16-le", "f32-le"):
        raise Corrupt("axes or tail kind")
    place = np.moveaxis(np.arange(n).reshape(shape), axes.index(policy.axis), -1).reshape(-1, shape[axes.index(policy.axis)])
    at = axes.index(token_axis)
    late = (place // int(np.prod(shape[at + 1 :], dtype=np.int64)) % shape[at]) >= shape[at] - policy.tail
    used = int((~late).sum())
    coded = (~late).any(1)
    width = 2 if dtype == "bf16-le" else 4
    if len(codes_) != -(-used * bits // 8) or len(parameters_) != 8 * int(coded.sum()) or len(tail) != width * int(late.sum()):
        raise Corrupt("buffer length")
    flat = np.unpackbits(np.frombuffer(codes_, np.uint8), bitorder="little")
    if flat[used * bits :].any():
        raise Corrupt("padding")
    pair = np.zeros((len(place), 2))
    pair[coded] = np.frombuffer(parameters_, "<f4").reshape(-1, 2)
    if not np.isfinite(pair).all() or (pair[:, 1] < 0).any() and bits > 1 or (pair[:, 0] > pair[:, 1])[coded].any() and bits == 1:
        raise Corrupt("parameters")
    code = (flat[: used * bits].reshape(used, bits).astype(np.int64) << np.arange(bits)).sum(1)
    row = np.nonzero(~late)[0]
    values = np.empty(place.shape, np.float32)
    with np.errstate(over="ignore"):
        values[~late] = pair[row, code] if bits == 1 else (pair[row, 0] + code * pair[row, 1]).astype(np.float32)
    values[late] = (np.frombuffer(tail, "<u2").astype(np.uint32) << 16).view(np.float32) if width == 2 else np.frombuffer(tail, "<f4")
    if not np.isfinite(values).all():
        raise Corrupt("a value is not finite")
    out = np.empty(n, np.float32)
    out[place.reshape(-1)] = values.reshape(-1)
    return out


def decode_tiles(stored: DataFrame, policy: CompactPolicy, token_axis: str = "token") -> DataFrame:
    """``(tile_id, shape, axes, values, error)`` of encoded tiles; values are null and the error says what is wrong where a tile is corrupt."""
    kind = stored.schema["tile_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for row in batch.select(["shape", "axes", "codes", "parameters", "tail", "tail_dtype"]).to_pylist():
                try:
                    values.append(_decoded_tile(row["shape"], row["axes"], policy, token_axis, row["codes"], row["parameters"], row["tail"], row["tail_dtype"]))
                    errors.append(None)
                except Corrupt as e:
                    values.append(None)
                    errors.append(f"Corrupt: {e}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tile_id", "shape", "axes")), pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["tile_id", "shape", "axes", "values", "error"])

    columns = ["tile_id", "shape", "axes", "codes", "parameters", "tail", "tail_dtype"]
    return stored.select(*columns).mapInArrow(run, f"tile_id {kind}, shape array<int>, axes array<string>, values array<float>, error string")
