"""Near-duplicate vectors by Euclidean p-stable hashing.

A normalised vector is projected on Gaussian directions, shifted and cut into steps of
``STEP``; ``EACH`` of these numbers make its bucket in each of ``TABLES`` tables.  Two unit
vectors of cosine 0.93 lie 0.374 apart and agree on one such number with a probability of
0.80, so they meet in some table with 1 - (1 - 0.8**8)**24 = 0.988; closer ones more surely.
Vectors that meet are compared by their cosine in double precision.

Equal vectors of a label are one class with a count.  A bucket of more than ``BLOCK``
classes is compared block by block in tasks of their own.  A pair is counted only in the
first table in which it meets.  Links are not listed: each comparison yields a count for
each vector and ties each to the least of those it reaches.

Null, zero, empty or non-finite vectors and those with a null label link with nothing and
are their own component.  Vectors of different widths link with nothing.  Repeated rows are
copies.  Further columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import FEW, connected, reached
from .frames import heavy_keys, modest_batches, settle, spread_join
from .shingles import mix
from .vectors import by_width

TABLES, EACH, STEP, BLOCK = 24, 8, 1.5, 2048
#: Rows of a cell that are compared with all of it at once.
TILE = 256


def _directions(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([width, 93])
    return rng.standard_normal((width, TABLES * EACH)), rng.uniform(0, STEP, TABLES * EACH)


def buckets(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A key for each unit vector and table; keys of different labels or widths differ."""
    along, shift = _directions(vectors.shape[1])
    cells = np.floor((vectors @ along + shift) / STEP).astype(np.int64).view(np.uint64).reshape(len(vectors), TABLES, EACH)
    keys = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1))[:, None] + np.arange(TABLES, dtype=np.uint64) + np.uint64(vectors.shape[1] << 20)
    for j in range(EACH):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return keys.view(np.int64)


def _hashed(rows: DataFrame) -> DataFrame:
    """``(id, key, vector, buckets)`` of ``(id, vector, label)``; no key where nothing can be linked."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys: list = [None] * n
            units: list = [None] * n
            found: list = [None] * n
            labelled = np.asarray(batch.column("label").is_valid())
            labels = batch.column("label").fill_null(0).to_numpy(zero_copy_only=False)
            for own, values in by_width(batch.column("vector")):
                scale = np.abs(values).max(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    values = values / scale[:, None]  # so that no square leaves the range of doubles
                    unit = values / np.sqrt((values * values).sum(1))[:, None]
                fine = labelled[own] & (scale > 0)
                own, unit = own[fine], unit[fine]
                if not len(own):
                    continue
                every = buckets(unit, labels[own])
                for i, u, b in zip(own.tolist(), unit, every, strict=True):
                    data = u.tobytes()
                    keys[i] = hashlib.blake2b(data, digest_size=16, salt=int(labels[i]).to_bytes(8, "little", signed=True)).digest()
                    units[i], found[i] = data, b
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "key", "vector", "buckets"])

    return rows.mapInArrow(run, f"id {kind}, key binary, vector binary, buckets array<bigint>")


def linked(unit: np.ndarray, tables: np.ndarray, table: int, n: np.ndarray, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a cell its links, whether it has a near one, and the first row that it reaches.

    ``n`` counts the copies of each; pairs that met in one of the first ``table`` tables are not counted again.  With
    ``side`` only pairs from both sides are compared.  Rows are taken ``TILE`` at a time, so no list of pairs is made.
    """
    rows = len(unit)
    near, links = np.empty((rows, rows), bool), np.empty(rows, np.int64)
    for at in range(0, rows, TILE):
        own = slice(at, at + TILE)
        part = near[own]
        np.greater_equal(unit[own] @ unit.T, cosine, out=part)
        if side is not None:
            part &= side[own, None] != side[None, :]
        part[np.arange(len(part)), np.arange(at, at + len(part))] = False
        first = part.copy()
        for t in range(table):
            first &= tables[own, t, None] != tables[None, :, t]
        links[own] = first @ n
    return links, near.any(1), reached(near, TILE)


def _compared(cells: DataFrame, cosine: float) -> DataFrame:
    """``(key, links, least)`` from rows ``(bucket, low, high, block, key, n, vector, buckets)`` of whole cells."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        part = part.take(pa.array(np.argsort(np.array(part["key"].to_pylist(), "S16").view("S16"), kind="stable")))
        width = len(part["vector"][0].as_buffer()) // 8
        unit = np.frombuffer(b"".join(part["vector"].to_pylist()), np.float64).reshape(-1, width)
        tables = part["buckets"].combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        table = int(np.flatnonzero(tables[0] == part["bucket"][0].as_py())[0])
        side = part["block"].to_numpy() if part["low"][0].as_py() != part["high"][0].as_py() else None
        links, some, root = linked(unit, tables, table, part["n"].to_numpy(), side, cosine)
        key = part["key"].combine_chunks()
        return pa.RecordBatch.from_arrays([key, pa.array(links), key.take(pa.array(root))], ["key", "links", "least"]).filter(pa.array(some))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(ids[:, a]):
                    if sum(h.num_rows for h in held) > 1:
                        yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(ids[:, a])
        if held and sum(h.num_rows for h in held) > 1:
            yield solve(pa.Table.from_batches(held))

    return cells.mapInArrow(run, "key binary, links bigint, least binary")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row."""
    modest_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    hashed = _hashed(rows)
    classes = settle(hashed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("vector").alias("vector"), F.first("buckets").alias("buckets")))
    entries = classes.select("key", F.explode("buckets").alias("bucket"))
    shared = settle(entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), FEW)
    met = settle(spread_join(entries, shared, ["bucket"], heavy_keys(shared, ["bucket"], "c"), ["key"]).select("bucket", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    cells = met.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("bucket", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cells = cells.join(classes.drop("id"), "key").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    compared = settle(_compared(cells.select("bucket", "low", "high", "block", "key", "n", "vector", "buckets"), cosine))
    links = compared.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected(compared.select("key", "least"), "key", "least")
    known = classes.select("key", "n", "id").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = settle(known.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("m")), FEW)
    known = spread_join(known, first.drop("m"), ["root"], heavy_keys(first, ["root"], "m"), ["key"])
    known = known.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component_id")
    out = spread_join(hashed.select("id", "key"), known, ["key"], heavy_keys(classes, ["key"], "n"), ["id"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
