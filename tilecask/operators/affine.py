"""Error-bounded affine quantisation of groups, chosen by measured size.

Everything works on one array column for each group, so trials of widths and trims need no
shuffle: a single width is an expression, the search for the cheapest one goes over Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from .bitset import _sizes

#: Bytes of a stored group descriptor.
DESCRIPTOR = 29


@dataclass(frozen=True)
class Policy:
    """How the groups of a tile are quantised."""

    axis: str
    group_size: int = 32
    bits: tuple[int, ...] = (2, 4, 8)
    error: float = 0.02
    outliers: float = 0.0
    tail: int = 0

    def __post_init__(self) -> None:
        fine = self.bits and set(self.bits) <= {2, 4, 8} and 1 <= self.group_size <= 65536 and 0 <= self.error < float("inf") and 0 <= self.outliers <= 0.1 and self.tail >= 0
        if not fine:
            raise Invalid(f"policy {self}")

    @classmethod
    def keys(cls, error: float) -> Policy:
        return cls("token", 32, (2, 4, 8), error, 0.02, 16)

    @classmethod
    def values(cls, error: float) -> Policy:
        return cls("channel", 32, (2, 4, 8), error, 0.02, 16)


def with_quantised(df: DataFrame, values: str, bits: int, trim: int, name: str = "q") -> DataFrame:
    """Adds ``struct(bits, minimum, step, codes, kept)`` of an array of floats.

    The trimmed range comes in columns of its own, so it is found once for each group and not for
    each element.
    """
    low, high = f"_{name}_low", f"_{name}_high"
    if trim:
        df = df.withColumn("_sorted", F.array_sort(F.transform(values, lambda v: v.cast("double"))))
        df = df.withColumn(low, F.element_at("_sorted", trim + 1)).withColumn(high, F.element_at("_sorted", F.size("_sorted") - trim)).drop("_sorted")
    else:
        df = df.withColumn(low, F.array_min(values).cast("double")).withColumn(high, F.array_max(values).cast("double"))
    step = f"_{name}_step"
    df = df.withColumn(step, (F.col(high) - F.col(low)) / F.lit(float((1 << bits) - 1)))

    def out(v: Column) -> Column:
        return (v.cast("double") < F.col(low)) | (v.cast("double") > F.col(high))

    code = F.transform(values, lambda v: F.when(out(v) | (F.col(step) == 0), F.lit(0)).otherwise(F.round((v.cast("double") - F.col(low)) / F.col(step)).cast("int")))
    kept = F.transform(values, out)
    q = F.struct(F.lit(bits).alias("bits"), F.col(low).alias("minimum"), F.col(step).alias("step"), code.alias("codes"), kept.alias("kept"))
    return df.withColumn(name, q).drop(low, high, step)


def decoded(q: Column, values: Column) -> Column:
    """Floats that a quantised group gives back; exceptions are exact."""
    plain = F.transform(q["codes"], lambda c: (q["minimum"] + q["step"] * c).cast("float"))
    return F.zip_with(F.zip_with(plain, q["kept"], lambda d, k: F.struct(d.alias("d"), k.alias("k"))), values, lambda x, v: F.when(x["k"], v).otherwise(x["d"]))


def largest_error(back: Column, values: Column) -> Column:
    return F.array_max(F.zip_with(back, values, lambda a, b: F.abs(a.cast("double") - b.cast("double"))))


def exceptions(q: Column) -> Column:
    return F.size(F.filter(q["kept"], lambda k: k))


def span(q: Column, n: Column) -> Column:
    """Bits that the group takes before packing."""
    e = exceptions(q)
    return n * q["bits"] + F.when(e > 0, n + 32 * e).otherwise(0)


TRIAL = "trial int, bits int, minimum double, step double, codes array<int>, back array<float>, exceptions int, max_err double, ok boolean, cost bigint, span bigint"


def _one_trial(v: np.ndarray, ordered: np.ndarray, bits: int, trim: int, policy: Policy) -> tuple:
    """A trial of many groups of one length at once."""
    n = v.shape[1]
    x, words = v.astype(np.float64), v.view(np.uint32).astype(np.int64)
    if bits == 32:
        planes = ((words[:, None, :] >> np.arange(32)[:, None]) & 1).reshape(len(v), -1).astype(bool)
        zero = np.zeros(len(v))
        return zero, zero, np.zeros(v.shape, np.int32), v, np.zeros(len(v), np.int32), zero, np.ones(len(v), bool), _sizes(planes) + DESCRIPTOR, np.full(len(v), 32 * n)
    low, high = ordered[:, trim, None], ordered[:, n - 1 - trim, None]
    step = (high - low) / ((1 << bits) - 1)
    kept = (x < low) | (x > high)
    with np.errstate(divide="ignore", invalid="ignore"):
        place = (x - low) / step
    code = np.floor(place)
    code = np.where(kept | (step == 0), 0, code + (place - code >= 0.5)).astype(np.int32)
    back = np.where(kept, v, (low + step * code).astype(np.float32))
    err = np.abs(x - back.astype(np.float64)).max(1)
    ok = (back.view(np.uint32) == v.view(np.uint32)).all(1) if policy.error == 0 else err <= policy.error
    e = kept.sum(1)
    planes = ((code[:, None, :] >> np.arange(bits)[:, None]) & 1).reshape(len(v), -1).astype(bool)
    cost = _sizes(planes)
    for i in np.flatnonzero(e):  # a mask of positions and the exact words follow the planes
        exact = ((words[i, kept[i]][:, None] >> np.arange(32)) & 1).reshape(-1).astype(bool)
        cost[i] = _sizes(np.concatenate((planes[i], kept[i], exact))[None])[0]
    return low[:, 0], step[:, 0], code, back, e.astype(np.int32), err, ok, cost + DESCRIPTOR, n * bits + np.where(e > 0, n + 32 * e, 0)


def _all_trials(v: np.ndarray, policy: Policy, with_raw: bool = True) -> list[tuple]:
    """Every trial of many groups of one length, in order."""
    n = v.shape[1]
    ordered = np.sort(v.astype(np.float64), axis=1)
    trim = int(n * policy.outliers)
    plans = [(2 * k + (t > 0), b, t) for k, b in enumerate(policy.bits) for t in ((0, trim) if trim else (0,))]
    if with_raw:
        plans.insert(0, (-1, 32, 0))
    return [(k, b, *_one_trial(v, ordered, b, t, policy)) for k, b, t in plans]


def _ranked(done: list[tuple], forced: np.ndarray) -> np.ndarray:
    """For each trial and group its place among the acceptable ones."""
    return np.stack([np.where(d[8] & ((d[1] == 32) | ~forced), d[9] * 64 + d[1], np.iinfo(np.int64).max) for d in done])


def trials(groups: DataFrame, policy: Policy, best_only: bool = False, with_raw: bool = True) -> DataFrame:
    """Each group ``(tile_id, grp, values, raw)`` with its trials in order, or with the best one.

    The best is the cheapest acceptable trial, with fewer bits and then the earlier among equals; a group
    marked ``raw`` has only the raw trial.  Whole Arrow batches are tried at once and nothing is
    shuffled.
    """
    kind = groups.schema["tile_id"].dataType.simpleString()
    grp = groups.schema["grp"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("values").value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            first = np.concatenate(([0], np.cumsum(sizes)))
            forced = batch.column("raw").to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == n)
                v = flat[first[rows][:, None] + np.arange(n)]
                done = _all_trials(v, policy, with_raw)
                pick = None
                if best_only:
                    rank = _ranked(done, forced[rows])
                    pick = rank.argmin(0)  # the first of equals is the earlier trial
                for at, (k, b, low, step, code, back, e, err, ok, cost, span) in enumerate(done):
                    own = np.arange(len(rows)) if pick is None else np.flatnonzero((pick == at) & (rank[at] < np.iinfo(np.int64).max))
                    if not len(own):
                        continue
                    keep = batch.select(["tile_id", "grp", "values"]).take(pa.array(rows[own]))
                    m = len(own)
                    new = [pa.array(np.full(m, k), pa.int32()), pa.array(np.full(m, b), pa.int32()), pa.array(low[own]), pa.array(step[own]), pa.array(list(code[own]), pa.list_(pa.int32())), pa.array(list(back[own]), pa.list_(pa.float32())), pa.array(e[own], pa.int32()), pa.array(err[own]), pa.array(ok[own] & ((b == 32) | ~forced[rows[own]])), pa.array(cost[own], pa.int64()), pa.array(span[own], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*keep.columns, *new], names=["tile_id", "grp", "values", *TRIAL_NAMES])

    return groups.select("tile_id", "grp", "values", "raw").mapInArrow(run, f"tile_id {kind}, grp {grp}, values array<float>, {TRIAL}")


TRIAL_NAMES = [c.split()[0] for c in TRIAL.split(", ")]


def with_offsets(groups: DataFrame) -> DataFrame:
    """Where each group's bits begin in its tile."""
    order = Window.partitionBy("tile_id").orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumn("offset", F.sum("span").over(order) - F.col("span"))


def encode(groups: DataFrame, policy: Policy) -> DataFrame:
    """Chosen descriptors and codes of groups ``(tile_id, grp, values, raw)``."""
    return with_offsets(trials(groups, policy, best_only=True))


def report(encoded: DataFrame) -> DataFrame:
    """A row for each tile: sizes and errors."""
    err = F.aggregate(F.zip_with("back", "values", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return reported(encoded.select("tile_id", "bits", "span", "exceptions", "max_err", err.alias("sse"), F.size("values").alias("n")))


def reported(groups: DataFrame) -> DataFrame:
    """The same of groups ``(tile_id, bits, span, exceptions, max_err, sse, n)``."""
    by_bits = groups.groupBy("tile_id", "bits").agg(F.count("*").alias("groups"), F.sum("span").alias("span"), F.sum("exceptions").alias("exceptions"), F.max("max_err").alias("max_err"), F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    return by_bits.groupBy("tile_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bits", "groups")))).alias("groups_by_bits"), F.sum("span").alias("span_bits"), F.ceil(F.sum("span") / 8).alias("packed_bytes"), F.sum("exceptions").alias("exceptions"), F.sum(F.when(F.col("bits") == 32, F.col("n")).otherwise(0)).alias("raw_values"), F.max("max_err").alias("max_err"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


def ordinals_of(encoded: DataFrame) -> DataFrame:
    """``(tile_id, ordinal)`` of every one of the payload of encoded groups: planes, then a mask and the exact words of exceptions."""
    kind = encoded.schema["tile_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, r in enumerate(batch.select(["offset", "bits", "values", "codes", "minimum", "step", "exceptions", "back"]).to_pylist()):
                v = np.asarray(r["values"], np.float32)
                n, words = len(v), v.view(np.uint32).astype(np.int64)
                code = words if r["bits"] == 32 else np.asarray(r["codes"], np.int64)
                own = [np.flatnonzero((code[None, :] >> np.arange(r["bits"])[:, None]) & 1)]
                if r["exceptions"]:
                    plain = (r["minimum"] + r["step"] * code).astype(np.float32)
                    kept = (code == 0) & (plain.view(np.uint32) != np.asarray(r["back"], np.float32).view(np.uint32))
                    exact = ((words[kept][:, None] >> np.arange(32)) & 1).reshape(-1)
                    own += [n * r["bits"] + np.flatnonzero(kept), n * r["bits"] + n + np.flatnonzero(exact)]
                own = np.concatenate(own) + r["offset"]
                found.append(own)
                rows.append(np.full(len(own), i))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("tile_id").take(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["tile_id", "ordinal"])

    columns = ["tile_id", "offset", "bits", "values", "codes", "minimum", "step", "exceptions", "back"]
    return encoded.select(*columns).mapInArrow(run, f"tile_id {kind}, ordinal bigint")


def descriptor_errors(groups: DataFrame, ordinals: DataFrame) -> DataFrame:
    """``(tile_id, error)`` of tiles whose descriptors ``(grp, offset, bits, minimum, step, exceptions, n)`` cannot be right, or whose payload goes beyond them."""
    order = Window.partitionBy("tile_id").orderBy("grp")
    span = F.col("n") * F.col("bits") + F.when(F.col("exceptions") > 0, F.col("n") + 32 * F.col("exceptions")).otherwise(0)
    rows = groups.withColumn("span", span).withColumn("due", F.coalesce(F.sum("span").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    fine = (F.col("offset") == F.col("due")) & F.col("bits").isin(2, 4, 8, 32) & finite(F.col("minimum")) & finite(F.col("step")) & (F.col("step") >= 0)
    fine = fine & F.col("exceptions").between(0, F.col("n")) & ~((F.col("bits") == 32) & (F.col("exceptions") != 0))
    each = rows.groupBy("tile_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"), F.sum("span").alias("end"))
    last = ordinals.groupBy("tile_id").agg(F.max("ordinal").alias("last"), F.min("ordinal").alias("first"))
    both = each.join(last, "tile_id", "full_outer")
    error = F.when(~F.coalesce("fine", F.lit(False)), "Corrupt: descriptor").when((F.col("last") >= F.col("end")) | (F.col("first") < 0), "Corrupt: payload beyond the descriptors")
    return both.select("tile_id", error.alias("error")).where("error is not null")


def decode(groups: DataFrame, ordinals: DataFrame) -> DataFrame:
    """``(tile_id, grp, values)`` from descriptors and payload; raises what :func:`descriptor_errors` finds.

    Each ordinal goes to the last group that begins at or before it, by one sort of a tile's marks; a group's bits are
    then turned into values by themselves.  A wrong exception mask makes values null, see :func:`decoded_groups`.
    """
    if not descriptor_errors(groups, ordinals).isEmpty():
        raise Corrupt("a tile's descriptors and payload do not fit")
    out = decoded_groups(groups, ordinals)
    if not out.where("values is null").isEmpty():
        raise Corrupt("an exception mask or a value is wrong")
    return out


def _group_values(box: np.ndarray, n: int, b: int, e: int, minimum: float, step: float) -> np.ndarray | None:
    """Values of a group's own bits; None if they are wrong."""
    code = (box[: n * b].reshape(b, n).astype(np.int64) << np.arange(b)[:, None]).sum(0)
    if b == 32:
        values = code.astype(np.uint32).view(np.float32)
    else:
        with np.errstate(over="ignore"):
            values = (minimum + step * code).astype(np.float32)
    if e:
        mask = box[n * b : n * b + n]
        if mask.sum() != e or code[mask].any():
            return None
        words = (box[n * b + n :].reshape(e, 32).astype(np.int64) << np.arange(32)).sum(1)
        values[mask] = words.astype(np.uint32).view(np.float32)
    return values if np.isfinite(values).all() else None


def decoded_groups(groups: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The same without checks of the whole; null values for a group whose own bits are wrong."""
    kind, grp = (groups.schema[c].dataType.simpleString() for c in ("tile_id", "grp"))
    marks = groups.select("tile_id", F.col("offset").alias("at"), F.lit(0).alias("what"), "grp").unionByName(ordinals.select("tile_id", F.col("ordinal").alias("at"), F.lit(1).alias("what"), F.lit(None).cast(grp).alias("grp")))
    order = Window.partitionBy("tile_id").orderBy("at", "what", "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.withColumn("grp", F.last("grp", ignorenulls=True).over(order)).where("what = 1")
    bits = placed.groupBy("tile_id", "grp").agg(F.collect_list("at").alias("ones"))
    rows = groups.join(bits, ["tile_id", "grp"], "left").select("tile_id", "grp", "offset", "bits", "minimum", "step", "exceptions", "n", F.coalesce("ones", F.array().cast("array<bigint>")).alias("ones"))

    def one(r: dict) -> np.ndarray | None:
        n, b, e = r["n"], r["bits"], r["exceptions"]
        box = np.zeros(n * b + (n + 32 * e if e else 0), bool)
        box[np.asarray(r["ones"], np.int64) - r["offset"]] = True
        return _group_values(box, n, b, e, r["minimum"], r["step"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("tile_id"), batch.column("grp"), pa.array([one(r) for r in batch.to_pylist()], pa.list_(pa.float32()))], ["tile_id", "grp", "values"])

    return rows.mapInArrow(run, f"tile_id {kind}, grp {grp}, values array<float>")


#: Values of tiles that are encoded or decoded at once; a larger tile is alone, and its groups are tried by so many.
AT_ONCE = 1 << 16
#: A group of a whole tile: its stored descriptor and what a report says of it.
GROUPS = pa.struct([("grp", pa.int64()), ("offset", pa.int64()), ("bits", pa.int32()), ("minimum", pa.float64()), ("step", pa.float64()), ("exceptions", pa.int32()), ("n", pa.int64()), ("span", pa.int64()), ("max_err", pa.float64()), ("sse", pa.float64())])


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` together."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(sizes) > first:
        yield first, len(sizes)


def _lines(values: np.ndarray, shape: list[int], at: int) -> np.ndarray:
    """The tile as lines along an axis, in the order of their groups."""
    return values.reshape(math.prod(shape[:at]), shape[at], -1).transpose(0, 2, 1).reshape(-1, shape[at])


def _widths(width: int, size: int) -> np.ndarray:
    """Lengths of a line's groups."""
    return np.diff(np.append(np.arange(0, width, size), width))


def _packed(parts: Iterable[np.ndarray]) -> bytes:
    """Bits one after the other as bytes, low bit first."""
    out, waiting, n = [], [], 0
    for part in parts:
        waiting.append(part)
        n += len(part)
        if n >= 1 << 20:
            bits = np.concatenate(waiting)
            out.append(np.packbits(bits[: n - n % 8], bitorder="little").tobytes())
            waiting, n = [bits[n - n % 8 :]], n % 8
    return b"".join([*out, np.packbits(np.concatenate(waiting), bitorder="little").tobytes()]) if waiting else b""


def _encoded_tiles(tiles: list[tuple[np.ndarray, list[int], list[str]]], policy: Policy, token_axis: str) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """Columns of ``GROUPS`` of some tiles ``(values, shape, axes)``, the number of each tile's groups, and payloads."""
    found: dict[int, list] = {}
    counts, first = [], 0
    for values, shape, axes in tiles:
        at = axes.index(policy.axis)
        lines, late = _lines(values, shape, at), None
        if policy.tail and token_axis in axes:
            token = axes.index(token_axis)
            tail = (np.arange(shape[token]) >= shape[token] - policy.tail).reshape([-1 if k == token else 1 for k in range(len(shape))])
            late = _lines(np.broadcast_to(tail, shape), shape, at)
        widths = _widths(shape[at], policy.group_size)
        full, blocks = shape[at] // policy.group_size, len(widths)
        numbers = first + np.arange(len(lines) * blocks).reshape(len(lines), blocks)
        for n, a, own in ((policy.group_size, 0, numbers[:, :full]), (int(widths[-1]), full * policy.group_size, numbers[:, full:])):
            if own.size:
                cut = lambda x: x[:, a : a + own.shape[1] * n].reshape(-1, n)  # noqa: B023, E731
                found.setdefault(n, []).append((own.reshape(-1), cut(lines), np.zeros(own.size, bool) if late is None else cut(late).any(1)))
        counts.append(numbers.size)
        first += numbers.size
    columns = [np.zeros(first, t.type.to_pandas_dtype()) for t in GROUPS]
    bits_of: list = [None] * first
    for n, parts in found.items():
        own, v, forced = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns[6][own] = n
        for i in range(0, len(own), step := max(1, AT_ONCE // n)):
            some, x, f = own[i : i + step], v[i : i + step], forced[i : i + step]
            done = _all_trials(x, policy)
            pick = _ranked(done, f).argmin(0)  # the first of equals is the earlier trial
            words = x.view(np.uint32).astype(np.int64)
            for at, (_, b, low, size, code, back, e, err, _, _, span) in enumerate(done):
                mine = np.flatnonzero(pick == at)
                if not len(mine):
                    continue
                for k, column in ((2, b), (3, low[mine]), (4, size[mine]), (5, e[mine]), (7, span[mine]), (8, err[mine]), (9, np.square(back[mine].astype(np.float64) - x[mine]).sum(1))):
                    columns[k][some[mine]] = column
                planes = np.packbits((((words if b == 32 else code)[mine][:, None, :] >> np.arange(b)[:, None]) & 1).reshape(len(mine), -1).astype(bool), axis=1, bitorder="little")
                for j, m in enumerate(mine):
                    kept = None
                    if e[m]:
                        plain = (low[m] + size[m] * code[m]).astype(np.float32)
                        kept = (code[m] == 0) & (plain.view(np.uint32) != back[m].view(np.uint32))
                    bits_of[some[m]] = (planes[j], n * b, kept, None if kept is None else words[m][kept])

    def bits(a: int, b: int) -> Iterator[np.ndarray]:
        for planes, count, kept, exact in bits_of[a:b]:
            yield np.unpackbits(planes, count=count, bitorder="little").astype(bool)
            if kept is not None:  # a mask of positions and the exact words follow the planes
                yield kept
                yield ((exact[:, None] >> np.arange(32)) & 1).reshape(-1).astype(bool)

    payloads, ends = [], np.cumsum(counts).tolist()
    for a, b in zip([0, *ends], ends, strict=False):
        columns[0][a:b] = np.arange(b - a)
        columns[1][a:b] = np.cumsum(columns[7][a:b]) - columns[7][a:b]
        payloads.append(_packed(bits(a, b)))
    return columns, np.asarray(counts), payloads


def encode_whole(tiles: DataFrame, policy: Policy, token_axis: str = "token") -> DataFrame:
    """Valid tiles ``(shape, axes, values)`` with ``groups`` and ``payload`` for their values; other columns stay.

    A tile is one row before and after, so nothing is shuffled: the same groups, trials and bits as of :func:`encode` and :func:`ordinals_of`.
    """
    keep = [c for c in tiles.columns if c != "values"]
    kinds = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(batch.column("values").value_lengths().to_numpy(zero_copy_only=False), AT_ONCE):
                part = batch.slice(a, b - a)
                rows = [(v.values.to_numpy(zero_copy_only=False).astype(np.float32), s, x) for v, s, x in zip(part.column("values"), part.column("shape").to_pylist(), part.column("axes").to_pylist(), strict=True)]
                columns, counts, payloads = _encoded_tiles(rows, policy, token_axis)
                groups = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, GROUPS, strict=True)], fields=list(GROUPS))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), groups)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists, pa.array(payloads, pa.binary())], [*keep, "groups", "payload"])

    group = "grp:bigint,offset:bigint,bits:int,minimum:double,step:double,exceptions:int,n:bigint,span:bigint,max_err:double,sse:double"
    return tiles.select(*keep, "values").mapInArrow(run, f"{kinds}, groups array<struct<{group}>>, payload binary")


def _decoded_tile(shape: list[int], at: int, size: int, groups: dict[str, np.ndarray], payload) -> tuple[np.ndarray | None, str | None]:
    """A tile's values, or the class of the error in its descriptors and bits."""
    widths = np.tile(_widths(shape[at], size), math.prod(shape) // shape[at])
    bits, e, n, low, step = (groups[c] for c in ("bits", "exceptions", "n", "minimum", "step"))
    if len(n) != len(widths) or (n != widths).any() or (groups["grp"] != np.arange(len(n))).any():
        return None, "Corrupt: descriptor"
    span = n * bits + np.where(e > 0, n + 32 * e, 0)
    due = np.cumsum(span) - span
    fine = (groups["offset"] == due) & np.isin(bits, (2, 4, 8, 32)) & np.isfinite(low) & np.isfinite(step) & (step >= 0) & (e >= 0) & (e <= n) & ~((bits == 32) & (e != 0))
    if not fine.all():
        return None, "Corrupt: descriptor"
    data, end = np.frombuffer(payload, np.uint8), int(span.sum())
    if len(data) != -(-end // 8) or end % 8 and data[-1] >> end % 8:
        return None, "Corrupt: payload beyond the descriptors"
    out, done = np.zeros(int(n.sum()), np.float32), 0
    for o, s, k, b, x, lo, st in zip(due.tolist(), span.tolist(), n.tolist(), bits.tolist(), e.tolist(), low.tolist(), step.tolist(), strict=True):
        box = np.unpackbits(data[o // 8 : -(-(o + s) // 8)], bitorder="little")[o % 8 : o % 8 + s].astype(bool)
        values = _group_values(box, k, b, x, lo, st)
        if values is None:
            return None, "Corrupt: exception mask or value"
        out[done : done + k] = values
        done += k
    inner = math.prod(shape[at + 1 :])
    return out.reshape(-1, inner, shape[at]).transpose(0, 2, 1).reshape(-1), None


def decode_whole(rows: DataFrame) -> DataFrame:
    """``values`` and ``error`` of encoded tiles ``(shape, axes, axis, group_size, groups, payload)`` in place of the last four; other columns stay."""
    gone = ("axis", "group_size", "groups", "payload")
    keep = [c for c in rows.columns if c not in gone]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    names = ("grp", "offset", "bits", "minimum", "step", "exceptions", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray([math.prod(s) for s in batch.column("shape").to_pylist()], np.int64)
            for a, b in _runs(sizes, AT_ONCE):
                part, values, errors = batch.slice(a, b - a), [], []
                for shape, axes, axis, size, groups, payload in zip(*(part.column(c).to_pylist() for c in ("shape", "axes", "axis", "group_size")), part.column("groups"), part.column("payload"), strict=True):
                    v, error = None, "Corrupt: descriptor"
                    if groups.is_valid and payload.is_valid and not groups.values.null_count:
                        own = dict(zip((f.name for f in groups.values.type), groups.values.flatten(), strict=True))
                        if not any(own[c].null_count for c in names):
                            v, error = _decoded_tile(shape, axes.index(axis), size, {c: own[c].to_numpy(zero_copy_only=False) for c in names}, payload.as_buffer())
                    values.append(v)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())], [*keep, "values", "error"])

    return rows.select(*keep, *gone).mapInArrow(run, f"{kinds}, values array<float>, error string")


def estimate(tiles_groups: DataFrame, policy: Policy) -> DataFrame:
    """The report of groups that are encoded for it and not kept, with the payload's portable size."""
    from .bitset import roaring_size_of_rows

    encoded = encode(tiles_groups, policy)
    size = roaring_size_of_rows(ordinals_of(encoded), ["tile_id"]).select("tile_id", F.col("bytes").alias("payload_roaring_bytes"))
    return report(encoded).join(size, "tile_id", "left").withColumn("payload_roaring_bytes", F.coalesce("payload_roaring_bytes", F.lit(8)))


def choices(groups: DataFrame, pool: str, widths: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """``(pool, item, j, bits, bytes, packed_bytes, score)`` for groups ``(tile_id, pool, values)``: each width with its sizes and squared error."""
    options = []
    for j, b in enumerate(widths):
        groups = with_quantised(groups, "values", b, 0, f"q{b}")
        back = decoded(F.col(f"q{b}"), F.col("values"))
        sse = F.aggregate(F.zip_with(back, "values", lambda a, v: F.pow(a.cast("double") - v.cast("double"), F.lit(2.0))), F.lit(0.0).cast("double"), lambda s, x: s + x)
        packed = F.ceil(F.size("values") * b / 8).cast("bigint")
        options.append(F.struct(F.lit(j).alias("j"), F.lit(b).alias("bits"), (packed + DESCRIPTOR).alias("bytes"), packed.alias("packed_bytes"), sse.alias("score")))
    return groups.select(F.col(pool).alias("pool"), F.col("tile_id").alias("item"), F.explode(F.array(*options)).alias("o")).select("pool", "item", "o.*")
