"""Connected components of a table of links: forests of what each task has, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import HEAVY, settle, spread_join

#: Links take few bytes each, so this many shuffle partitions of them make one.
FEW = 8
#: Links that a task holds at once, of keys of 16 bytes about what Spark itself puts in one.  So few in all need no rounds.
LINKS = 1 << 17


def reached(near: np.ndarray, tile: int = 256) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    n = len(near)
    root = np.arange(n)
    while True:
        before = root.copy()
        for at in range(0, n, tile):
            root[at : at + tile] = np.minimum(root[at : at + tile], np.where(near[at : at + tile], root, n).min(1))
        root = root[root]
        if (root == before).all():
            return root


def forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Every node of the links in order, and the least node of its component."""
    found = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    x, y = np.split(place[found.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while True:
        before = root.copy()
        low = np.minimum(before[x], before[y])
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            nodes = found.dictionary.take(order)
            return nodes, nodes.take(pa.array(root))


def _forests(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Links ``(u, v)`` of each task's nodes to the least one they reach there, ``LINKS`` at a time; with ``whole`` all at once, and roots with themselves."""
    kind = edges.schema["u"].dataType.simpleString()

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        nodes, roots = forest(*(table[c].chunk(0) for c in ("u", "v")))
        out = pa.RecordBatch.from_arrays([nodes, roots], ["u", "v"])
        return out if whole else out.filter(pc.not_equal(nodes, roots))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if not whole and sum(b.num_rows for b in held) >= LINKS:
                yield links(held)
                held = []
        if held:
            yield links(held)

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(both: DataFrame, hubs: list[int], larger: bool) -> DataFrame:
    """Tie each node's larger (or smaller) neighbours to the least node about it; the links of hubs are dealt to many tasks."""
    own = both.groupBy("u").agg(F.min("v").alias("m"))
    ties = spread_join(both, own, ["u"], hubs, ["v"]).select("u", "v", F.least("u", "m").alias("m"))
    if larger:
        return ties.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.where("v < u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.where("m < u").select("u", F.col("m").alias("v")))


def _state(edges: DataFrame, many: int) -> tuple[int, int | None, list[int]]:
    """Ends of links, a checksum, and hashes of the nodes with more than ``many`` links."""
    each = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.when(F.col("u") > F.col("v"), F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("s"))
    row = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.collect_list(F.when(F.col("n") > many, F.xxhash64("u")))).first()
    return row[0], row[1], row[2]


def connected(links: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """``(node, root)`` of every node with a link; the root is the least node of its component.

    Repeated links go and each task turns what it then has into a forest; where ``LINKS`` or fewer are left in all, one more forest
    is the result.  The exchange comes first because links are made by Python workers, and a task that went on with
    them in another one would keep two.
    Of more, each round is two groupings by node with partial minima.  What reaches the driver is a count, a checksum and
    the hubs, of which there are some hundreds at most: each has more than a 256th of the links of the round before.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    edges = settle(_forests(edges.distinct()), FEW)
    ends = 2 * edges.count()
    if ends <= 2 * LINKS:
        return settle(_forests(edges.coalesce(1), whole=True)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    before, hubs = None, _state(edges, max(64, int(ends * HEAVY)))[2] if ends else []
    for _ in range(most if ends else 0):
        edges = _star(_both(edges), hubs, True).where("u != v").distinct()
        edges = settle(_star(edges, [], False).where("u != v").distinct(), FEW)
        ends, checksum, hubs = _state(edges, max(64, int(ends * HEAVY)))
        if (ends, checksum) == before:
            break
        before = ends, checksum
    else:
        if ends:
            raise RuntimeError(f"components still change after {most} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
