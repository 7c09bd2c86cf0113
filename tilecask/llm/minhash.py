"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so a signature of 96 values takes 48 hash evaluations a shingle.  Bands of
four values make 24 buckets a document; at a similarity of 0.8 a pair shares none of
them with a probability of (1 - 0.8**4)**24 = 3e-6.

Documents with equal shingle sets form one class and go on as one row.  Classes of a bucket
are compared by signature, ``TILE`` by ``TILE``; those whose estimate is not too far below the threshold form a
cluster, directly or by way of others, and every link lies within one.  Sharing a bucket alone does not
join clusters, so passages that many documents have do not make them grow.

A cluster's sets are brought together in cells of ``BLOCK`` classes or ``CELL_BYTES``.  Where there are
more, each class is first held against its cluster's pivot; those linked to it are one component already, and
only the rest is compared with all, block by block.  Within a cell signatures estimate the similarity of
every pair, and pairs whose estimate is not too far below the threshold are confirmed on their full
sets, the likeliest first, unless their classes are in one component already.  What comes out
are the links that join components, at most one for each class and cell.

Null or empty texts have an empty set and no link.  Rows with a null id keep a null
component unless they are linked.  Repeated rows are copies.  Further columns are left
out.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import FEW, connected, reached
from .frames import heavy_keys, modest_batches, pieces_of, settle, spread_join, stored, utf8
from .shingles import POWERS, mix, shingle_sets

PERMUTATIONS, BAND, BLOCK = 48, 4, 1024
#: Classes of a bucket that are compared by signature at once, and bytes of sets in a block.
TILE, CELL_BYTES = 2048, 48 << 20
#: So many groups of more than one block are told to every task; of more, rows go to their groups' places.
GROUPS = 4096
_rng = np.random.default_rng(52)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, side by side."""
    out = np.empty(2 * PERMUTATIONS, np.uint64)
    low, high = out[::2], out[1::2]
    low[:], high[:] = np.iinfo(np.uint64).max, 0
    for at in range(0, len(shingles), 1024):
        permuted = shingles[at : at + 1024, None] * _A + _B
        np.minimum(low, permuted.min(0), out=low)
        np.maximum(high, permuted.max(0), out=high)
    return out


def short_signature(shingles: np.ndarray) -> bytes | None:
    """The last 16 bits of each signature value; None for an empty set."""
    return signature(shingles).astype("<u2").tobytes() if len(shingles) else None


def resemblance(a: bytes | None, b: bytes | None) -> float:
    """The share of equal values of two short signatures, which estimates the similarity of their sets."""
    if a is None or b is None:
        return 0.0
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def buckets(values: np.ndarray) -> np.ndarray:
    """One bucket key for each band of a signature."""
    bands = values.reshape(-1, BAND)
    keys = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for j in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return keys.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``(id, n, key, buckets, sign)`` of every row of ``(id, text)``; no key for an empty set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", keep=POWERS):
            n, keys, bands, signs = [], [], [], []
            for own in shingle_sets(utf8(batch.column("text")), width):
                values = signature(own) if len(own) else None
                n.append(len(own))
                keys.append(None if values is None else set_key(own))
                bands.append(None if values is None else buckets(values))
                signs.append(None if values is None else values.astype("<u2").tobytes())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "key", "buckets", "sign"])

    return docs.mapInArrow(run, f"id {kind}, n bigint, key binary, buckets array<bigint>, sign binary")


def _sets(found: DataFrame, width: int) -> DataFrame:
    """The rows without their text and with the set's ``hashes``, packed 64-bit words in order."""
    names = [c for c in found.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # repeated rows of an id come to one task
        for batch in pieces_of(batches, "text", 1 << 20, keep=POWERS):
            own = list(shingle_sets(utf8(batch.column("text")), width))
            same = [k not in seen and set_key(s) == k and not seen.add(k) for s, k in zip(own, batch.column("key").to_pylist(), strict=True)]
            hashes = pa.array([s.tobytes() for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), hashes], [*names, "hashes"]).filter(pa.array(same, pa.bool_()))

    return found.mapInArrow(run, f"{kinds}, hashes binary")


def _least(percent: int, width: int) -> float:
    """The share of equal values that a pair at the threshold falls below in three of a million cases: four and a half standard deviations."""
    t = percent / 100
    return t - 4.5 * (t * (1 - t) / width) ** 0.5


def _whole_groups(batches: Iterable[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values of ``by``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if held and ids[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last, at = ids[at], end
    if held:
        yield pa.Table.from_batches(held)


def resembling(signs: np.ndarray, sizes: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each row the first one that it reaches by pairs whose estimate is near enough; with ``side`` only pairs from both sides."""
    least = _least(percent, signs.shape[1]) * signs.shape[1]
    near = np.zeros((len(signs), len(signs)), bool)
    for a in range(len(signs) - 1):
        y = np.arange(a + 1, len(signs))
        if side is not None:
            y = y[side[y] != side[a]]
        y = y[100 * np.minimum(sizes[y], sizes[a]) >= percent * np.maximum(sizes[y], sizes[a])]
        y = y[(signs[y] == signs[a]).sum(1) >= least]
        near[a, y] = near[y, a] = True
    return reached(near)


def _likely(cells: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` from whole cells of rows ``(grp, low, high, block, key, n, sign)``: ties between all keys that resemble each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], []]
        for part in _whole_groups(batches, ["grp", "low", "high"]):
            if part.num_rows < 2:
                continue
            keys = part["key"].to_pylist()
            signs = np.frombuffer(b"".join(part["sign"].to_pylist()), "<u2").reshape(len(keys), -1)
            side = part["block"].to_numpy() if part["low"][0].as_py() != part["high"][0].as_py() else None
            root = resembling(signs, part["n"].to_numpy(), side, percent)
            own = np.flatnonzero(root != np.arange(len(keys))).tolist()
            out[0] += [keys[i] for i in own]
            out[1] += [keys[root[i]] for i in own]
            if len(out[0]) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])
                out = [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], ["a", "b"])

    return cells.mapInArrow(run, "a binary, b binary")


def likely_pairs(signs: np.ndarray, sizes: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (x, y) of rows with ``other[x] < other[y]`` whose estimate is near enough, likeliest first."""
    width = signs.shape[1]
    least = _least(percent, width)
    found = []
    for a in range(len(signs)):
        y = np.flatnonzero(other > other[a])
        y = y[(100 * np.minimum(sizes[y], sizes[a]) >= percent * np.maximum(sizes[y], sizes[a]))]
        agree = (signs[y] == signs[a]).sum(1)
        near = agree >= least * width
        found.append(np.stack([np.full(near.sum(), a), y[near], agree[near]]))
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return every[:2, np.argsort(-every[2], kind="stable")].T


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    both = int((s[at] == t).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def joined(sets: list[np.ndarray], other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between rows that no earlier link has brought together."""
    if len(sets) == 2:
        pairs = [(0, 1)] if other[0] != other[1] else []
    else:
        signs = np.array([signature(s) for s in sets]).astype(np.uint16)
        pairs = likely_pairs(signs, np.array([len(s) for s in sets]), other, percent).tolist()
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a == b:
            continue
        if linked(sets[x], sets[y], percent):
            root[b] = a
            links.append((x, y))
    return links


def _links(cells: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` from whole cells of rows ``(grp, low, high, block, key, hashes)``: links between sets."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in part["hashes"]]
        block = part["block"].to_numpy()
        low, high = part["low"][0].as_py(), part["high"][0].as_py()
        other = np.arange(len(sets)) if low == high else (block == high).astype(int)
        links = joined(sets, other, percent)
        keys = part["key"].to_pylist()
        return pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in links], pa.binary()), pa.array([keys[y] for _, y in links], pa.binary())], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ["grp", "low", "high"]):
            yield solve(part)

    return cells.mapInArrow(run, "a binary, b binary")


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")


def _cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Cells ``(grp, low, high, block, names)`` of groups that are one block."""
    return _dealt(rows.select("grp", *(F.lit(0).alias(c) for c in ("low", "high", "block")), *names))


def _of_groups(rows: DataFrame, groups: DataFrame, many: int) -> DataFrame:
    """Rows of the groups of more than one block, of which there are ``many``, with what ``groups`` has of them; a few thousand go to every task."""
    if many <= GROUPS:
        return rows.join(F.broadcast(groups), "grp")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("m"))
    return spread_join(rows, groups, ["grp"], heavy_keys(sizes, ["grp"], "m"), ["key"])


def near_sign(part: pa.Table, at: int, percent: int) -> np.ndarray:
    """Which rows' estimates are near enough to that of row ``at``."""
    signs = np.frombuffer(b"".join(part["sign"].to_pylist()), "<u2").reshape(part.num_rows, -1)
    sizes = part["n"].to_numpy()
    fits = 100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at])
    return fits & ((signs == signs[at]).sum(1) >= _least(percent, signs.shape[1]) * signs.shape[1])


def linked_set(part: pa.Table, at: int, percent: int) -> np.ndarray:
    """Which rows' sets are linked with that of row ``at``."""
    sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in part["hashes"]]
    return np.array([linked(sets[at], s, percent) for s in sets], bool)


def _met_pivot(rows: DataFrame, names: list[str], near: Callable[[pa.Table, int], np.ndarray]) -> DataFrame:
    """Rows ``(grp, pivot, blocks, home, names, held)``, each once: ``held`` tells those that are linked with their group's pivot, itself included.

    The pivot is repeated for every block.
    """
    home = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    meets = F.when(F.col("key") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home"))
    cells = rows.withColumn("home", home).withColumn("block", F.explode(meets)).repartition("grp", "block").sortWithinPartitions("grp", "block")
    out = ["grp", "pivot", "blocks", "home", *names]
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, ["grp", "block"]):
            at = pc.index(part["key"], part["pivot"][0]).as_py()
            held = np.zeros(part.num_rows, bool)
            if at >= 0:  # a pivot without an id has no set here
                held = near(part, at)
                held[at] = True
            own = part.select(out).append_column("held", pa.array(held)).filter(pc.equal(part["home"], part["block"]))
            yield from own.to_batches()

    return cells.mapInArrow(run, f"{kinds}, held boolean")


def _ties(rows: DataFrame, names: list[str], near: Callable[[pa.Table, int], np.ndarray], compare: Callable[[DataFrame], DataFrame], many: int) -> DataFrame:
    """Ties ``(a, b)`` that join what ``compare`` finds within the ``many`` groups of more than one block, from ``(grp, pivot, blocks, names)``.

    Each block meets the pivot first.  What is not tied to it meets all blocks; what is need not meet the
    like of it, being joined already.
    """
    rows = settle(_met_pivot(rows, names, near))
    ties = rows.where("held AND key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("m"), F.sum(F.when(F.col("held"), 0).otherwise(1)).alias("rest"), F.first("blocks").alias("b"))
    parts = settle(sizes.where("rest > 0").select("grp", F.ceil(F.col("rest") * F.col("b") / F.col("m")).cast("int").alias("parts")), FEW)
    if parts.isEmpty():
        return ties
    # the low side of a cell is a part of the rest, the high side another one or, counted on from there, a block of those held
    block = F.when(F.col("held"), F.col("parts") + F.col("home")).otherwise(F.pmod(F.xxhash64("key", F.lit("rest")), "parts").cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") + F.when(F.col("held"), 0).otherwise(F.col("blocks")) - 1)
    met = _of_groups(rows, parts, many).withColumn("block", block).withColumn("other", F.explode(others))
    return ties.union(compare(_dealt(met.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *names))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row."""
    modest_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = settle(signed(docs, width))
    classes = stored(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("n", "buckets", "sign"))))
    copies = heavy_keys(classes, ["key"], "m")
    entries = classes.select("key", F.explode("buckets").alias("grp"))
    signs = classes.select("key", "n", "sign")
    shared = entries.groupBy("grp").agg(F.count("*").alias("m"), F.min("key").alias("pivot")).where("m > 1")
    shared = settle(shared.withColumn("blocks", F.ceil(F.col("m") / min(block, TILE)).cast("int")), FEW)
    small, large = shared.where("blocks = 1").select("grp"), shared.where("blocks > 1").select("grp", "pivot", "blocks")
    names, many = ["key", "n", "sign"], large.count()
    likely = _likely(_cells(entries.join(small, "grp").join(signs, "key"), names), percent)
    if many:
        met = classes.select(*names, F.explode("buckets").alias("grp")) if many <= GROUPS else entries
        met = _of_groups(met, large, many) if many <= GROUPS else _of_groups(met, large, many).join(signs, "key")
        likely = likely.union(_ties(met, names, lambda part, at: near_sign(part, at, percent), lambda cells: _likely(cells, percent), many))

    clusters = settle(connected(likely, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("grp")).join(classes.select("key", "id", "n"), "key"), FEW)
    bounds = clusters.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("hashes"), F.min("key").alias("pivot"))
    bounds = settle(bounds.withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("hashes") * 8 / CELL_BYTES)).cast("int")), FEW)
    small, large = bounds.where("blocks = 1").select("grp"), bounds.where("blocks > 1").select("grp", "pivot", "blocks")
    names, many, wanted = ["key", "hashes"], large.count(), clusters.select("key", "id", "grp")

    def sets(wanted: DataFrame) -> DataFrame:
        return _sets(docs.join(wanted, "id").drop("id"), width)

    links = _links(_cells(sets(wanted.join(small, "grp")), names), percent)
    if many:
        links = links.union(_ties(sets(_of_groups(wanted, large, many)), names, lambda part, at: linked_set(part, at, percent), lambda cells: _links(cells, percent), many))
    roots = connected(links, "a", "b")

    least = settle(classes.select("key", "id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), FEW)
    first = least.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("m"))
    least = spread_join(least, first.drop("m"), ["root"], heavy_keys(first, ["root"], "m"), ["key"]).select("key", "component_id")
    out = spread_join(rows.select("id", F.col("n").alias("n_shingles"), "key"), least, ["key"], copies, ["id"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
