"""Best-fit packing by large-item matching, decided on the histogram of lengths.

How many sequences a packing needs depends only on how many pieces there are of each
length, and there are at most ``capacity`` lengths.  So the tasks count, the driver
lays out at most ``capacity`` classes (pieces above a third of the capacity are matched
greedily, two to a sequence at most, the rest go best-fit into the gaps, largest first),
and every piece then finds its own place from its rank among those of its length.  The
layout has runs of equal sequences instead of pieces, so its size does not grow with
the data, and no length, however common, has its rows gathered in one task.

Null texts count as empty; an empty document is the one closing id.  Repeated rows are
packed each.  Columns other than the id and the text are left out.  An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .frames import pieces_of, settle

Run = tuple[int, int, int, int, int]
#: Shuffle partitions of small rows that make one.
FEW = 8


def layout(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs ``(length, first rank, how many, first sequence, offset)``: rank r of a run sits in sequence first + r."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    n_sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= min(a, capacity - a) and left[b] > (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, n_sequences, 0)
            if b is not None:
                put(b, n, n_sequences, a)
            keep(capacity - a - (b or 0), n_sequences, n)
            n_sequences += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=0)
            if gap:
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, first, n = capacity, n_sequences, -(-left[length] // (capacity // length))
                n_sequences += n
            each = gap // length
            full = min(n, left[length] // each)
            rest = min(left[length] - full * each, each) if full < n else 0
            for k in range(each):
                if full:
                    put(length, full, first, capacity - gap + k * length)
            for k in range(rest):
                put(length, 1, first + full, capacity - gap + k * length)
            keep(gap - each * length, first, full)
            if rest:
                keep(gap - rest * length, first + full, 1)
            keep(gap, first + full + bool(rest), n - full - bool(rest))
    return runs


def cut_table(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each document's ids and the closing one, cut only where longer than ``capacity``."""
    key = docs.schema[id_col].dataType.simpleString()
    close = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(tokenizer)
        for batch in pieces_of(batches, "text", keep=bpe._codecs):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = b"".join([b"".join(some) for some in own.encode(text or "")]) + close
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            cols = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` added; ``pieces`` must have a ``length`` from 1 to ``capacity``."""
    # ranks hold only while partitions and their order stay as they are; rows of some bytes each need few files
    few = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FEW)
    pieces = settle(pieces.repartition(few, *pieces.columns[:2], "length"))
    fields = pieces.schema

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(lengths), np.int64)
            rank[order] = np.arange(len(lengths)) - first + seen[ordered]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "_rank"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    by_part = pieces.groupBy(F.spark_partition_id().alias("_part"), "length").agg(F.count("*").alias("_n"))
    by_part = settle(by_part, FEW)
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    runs = sorted(layout(counts, capacity))
    lengths, ranks, _, firsts, offsets = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
    starts = np.searchsorted(lengths, np.arange(capacity + 2))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + batch.column("_before").to_numpy()
            run = np.empty(len(length), np.int64)
            for one in np.unique(length):
                own, a, b = length == one, starts[one], starts[one + 1]
                run[own] = a + np.searchsorted(ranks[a:b], rank[own], side="right") - 1
            kept = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(firsts[run] + rank - ranks[run]), pa.array(offsets[run])], [*fields.names, "sequence_id", "offset"])

    before = by_part.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    local = pieces.mapInArrow(ranked, f"{names}, _rank bigint").withColumn("_part", F.spark_partition_id())
    return local.join(before, ["_part", "length"]).mapInArrow(placed, f"{names}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return place(cut_table(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ``ids`` of each sequence, from placed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
