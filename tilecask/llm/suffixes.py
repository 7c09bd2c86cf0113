"""Removal of every byte that lies in a repeated string of a fixed length.

The strings that have to be compared are first brought together.  In every window of
``length`` bytes the least hash of its ``GRAM``-byte strings names an anchor, so two equal
windows hold the same anchor at the same place.  Anchors that occur once are dropped; each
other one stands for a piece of text, its surroundings, which holds every window that can
be anchored there.  Equal pieces are counted before anything is moved, so thousands of
copies of a passage arrive as one piece with a count.

Pieces that share an anchor are then held against each other by a suffix array, built
in two stages: suffixes smaller than their successors are sorted directly, the others are
induced from these by scanning the buckets of first bytes in order.  Adjacent entries
whose common prefix reaches ``length`` are equal windows; they are repeated if their pieces' counts
make two.

An anchor with more than ``GROUP`` different surroundings is split: windows that start in the same
``STEP`` places about the anchor have all but a few bytes in common, so they can only be equal if these are, and
each such core makes a group of its own that is sorted like others.  Of a core with more than ``GROUP`` different
surroundings of a few bytes, single windows are counted by digest.

Null texts count as empty; texts shorter than ``length`` lose nothing; repeated rows repeat
each other's strings; further columns of any name stay as they are; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import heavy_keys, modest_batches, pieces_of, spread_join, stored, utf8
from .shingles import mix

GRAM = 32
GROUP = 32768
STEP = 8
SEGMENT = 1 << 20
#: Window starts that are sorted at once.
AT_ONCE = 200_000
#: Room for a place within a segment.
_PLACE = np.uint64((1 << 21) - 1)
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and the first and last start of the windows it stands for.

    The anchor of a window is the first of its ``GRAM``-byte strings of least hash, so a window's own
    bytes tell it, and each window has one.
    """
    span, out = length - GRAM + 1, [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = np.frombuffer(data, np.uint8, min(len(data) - at, SEGMENT + length - 1), at)
        h, base, size = _CODES[part], 0x9E3779B97F4A7C15, 1
        while size < GRAM:
            h = h[:-size] * np.uint64(base) + h[size:]
            base, size = base * base % (1 << 64), 2 * size
        h = mix(h)
        ordered = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (_slide(ordered, span, np.minimum) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.append(first[1:], len(place)) - 1
        for column, values in zip(out, (h[place[first]], place[first] + at, first + at, last + at), strict=True):
            column.append(values)
    return tuple(np.concatenate(column) for column in out)


def piece_key(data: bytes, at: int, first: int, last: int) -> bytes:
    return hashlib.blake2b(data[first:last], digest_size=16, salt=(at - first).to_bytes(8, "little")).digest()


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes' first ``depth`` bytes.

    ``text`` ends with at least ``depth`` zero bytes.  A suffix that is greater than its
    successor is placed by the successor's rank, so its chain of successors up to the next
    smaller one takes part as well.
    """
    n = len(text)
    step = np.flatnonzero(text[1:] != text[:-1])
    following = np.searchsorted(step, np.arange(n))
    rises = np.zeros(n, bool)
    inner = following < len(step)
    turn = step[following[inner]]
    rises[inner] = text[turn + 1] > text[turn]
    rises[n - 1] = False
    up = np.append(np.flatnonzero(rises), n - 1)
    needed = np.zeros(n + 1, np.int32)
    np.add.at(needed, starts, 1)
    np.add.at(needed, up[np.searchsorted(up, starts)] + 1, -1)
    member = np.cumsum(needed[:n]) > 0
    # first stage: direct
    raw = text.tobytes()
    direct = np.flatnonzero(member & rises)
    keys = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    by_byte = np.searchsorted(text[direct], np.arange(257))
    # second stage: induced, a bucket of first bytes after the other
    falling = member & ~rises
    falling[n - 1] = False
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    if member[n - 1]:
        queues[text[n - 1]].append(np.array([n - 1]))  # the end comes before all that begins with its byte
    order = []

    def induce(entries: np.ndarray, byte: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[falling[before]]
        if not len(before):
            return before
        to = text[before]
        by = np.argsort(to, kind="stable")
        before, to = before[by], to[by]
        cuts = np.flatnonzero(np.diff(to)) + 1
        own = before[:0]
        for part in np.split(before, cuts):
            b = int(text[part[0]])
            if b == byte:
                own = part
            else:
                queues[b].append(part)
        return own

    for byte in range(256):
        if queues[byte]:
            fresh = np.concatenate(queues[byte])
            queues[byte] = []
            while len(fresh):
                order.append(fresh)
                fresh = induce(fresh, byte)
        smaller = direct[by_byte[byte] : by_byte[byte + 1]]
        if len(smaller):
            order.append(smaller)
            induce(smaller, byte)
    sa = np.concatenate(order) if order else direct
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return sa[wanted[sa]]


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each entry shares with the one before it, ``depth`` at most; none for the first."""
    out = np.zeros(len(sa), np.int64)
    live = np.arange(1, len(sa))
    for d in range(depth):
        if not len(live):
            break
        live = live[text[sa[live] + d] == text[sa[live - 1] + d]]
        out[live] = d + 1
    return out


def _common_words(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Whether each entry shares ``depth`` bytes with the one before it."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    same, live = np.zeros(len(sa), bool), np.arange(1, len(sa))
    for d in [*range(0, depth - 7, 8), depth - 8]:
        if not len(live):
            break
        live = live[(words[sa[live] + d] == words[sa[live - 1] + d]).all(1)]
    same[live] = True
    return same


def repeats(group: np.ndarray, left: np.ndarray, pieces: list[bytes], length: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the first and last window that occurs twice in its group, whose pieces occur ``n`` times.

    Windows are counted from the earliest that can hold the anchor, which lies ``left`` bytes
    into its piece; a high below the low where there is none.
    """
    reach = length - GRAM
    low, high = np.full(len(pieces), reach + 1), np.full(len(pieces), -1)
    sizes = np.array([len(p) for p in pieces])
    block = max(1, min(reach + 1, AT_ONCE // max(1, len(pieces))))
    for r in range(0, reach + 1, block):
        first = np.maximum(0, left - reach + r)
        last = np.minimum(np.minimum(left - reach + r + block - 1, left), sizes - length)
        own = np.flatnonzero(first <= last)
        if not len(own):
            continue
        parts = [pieces[i][first[i] : last[i] + length] for i in own.tolist()]
        text = np.frombuffer(b"".join([*parts, bytes(length + 8)]), np.uint8)
        begin = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        count = last[own] - first[own] + 1
        of = np.repeat(np.arange(len(own)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        starts = begin[of] + within
        sa = suffix_array(text, starts, length)
        at = np.searchsorted(starts, sa)
        run = np.cumsum(~_common_words(text, sa, length))
        piece = own[of[at]]
        window = within[at] + first[piece] - left[piece] + reach
        _, label = np.unique(group, return_inverse=True)
        key = (run * (label.max() + 1) + label[piece]) * (reach + 1) + window
        _, inverse, found = np.unique(key, return_inverse=True, return_counts=True)
        twice = (found if n is None else np.bincount(inverse, n[piece]))[inverse] > 1
        np.minimum.at(low, piece[twice], window[twice])
        np.maximum.at(high, piece[twice], window[twice])
    return low, high


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """``(anchor, piece, tid, first, left, windows)`` of every anchor of every ``(tid, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            rows, keys, out = [], [], [[], [], [], []]
            for i, data in enumerate(utf8(batch.column("text"))):
                h, at, first, last = anchors(data, length)
                rows.append(np.full(len(at), i))
                for column, values in zip(out, (h.view(np.int64), first, (at - first).astype(np.int32), (last - first + 1).astype(np.int32)), strict=True):
                    column.append(values)
                keys += [piece_key(data, a, f, t + length) for a, f, t in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)]
            tids = batch.column("tid").take(pa.array(np.concatenate(rows)))
            h, first, left, windows = (pa.array(np.concatenate(c)) for c in out)
            yield pa.RecordBatch.from_arrays([h, pa.array(keys, pa.binary()), tids, first, left, windows], ["anchor", "piece", "tid", "first", "left", "windows"])

    return texts.mapInArrow(run, "anchor bigint, piece binary, tid binary, first bigint, left int, windows int")


def _anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """``anchor`` of every anchor, without its place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", 1 << 20):
            found = [anchors(data, length)[0] for data in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["anchor"])

    return texts.select("text").mapInArrow(run, "anchor bigint")


#: A piece to be sorted: its group, what it is a part of and from which byte on, how often it occurs, where the anchor lies in it.
_PIECE = "grp bigint, anchor bigint, piece binary, base bigint, n bigint, left bigint, bytes binary"
_PIECE_NAMES = ["grp", "anchor", "piece", "base", "n", "left", "bytes"]


def _cut(found: DataFrame, text_col: str, length: int) -> DataFrame:
    """The pieces of rows of a text with the list of anchors wanted of it, each grouped by its anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # copies of a text come to one task
        for batch in pieces_of(batches, text_col, 1 << 20):
            out: list[list] = [[] for _ in _PIECE_NAMES]
            for tid, data, wanted in zip(batch.column("tid").to_pylist(), utf8(batch.column(text_col)), batch.column("wanted").to_pylist(), strict=True):
                wanted = () if tid in done else wanted
                done.add(tid)
                for w in wanted:
                    piece = data[w["first"] : w["first"] + w["windows"] - 1 + length]
                    for column, value in zip(out, (w["anchor"], w["anchor"], w["piece"], 0, w["n"], w["left"], piece), strict=True):
                        column.append(value)
            yield _piece_batch(out)

    return found.mapInArrow(run, _PIECE)


def _piece_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _PIECE_NAMES)


def _split(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces cut to the windows of each ``STEP`` places about the anchor, grouped by what these have in common."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for batch in pieces_of(batches, "bytes", 1 << 18):
            out: list[list] = [[] for _ in _PIECE_NAMES]
            for row in batch.drop_columns(["grp", "base"]).to_pylist():
                data, left = row["bytes"], row["left"]
                origin = left - reach  # where the earliest window that can hold the anchor would start
                for block in range(max(0, -origin) // STEP, (len(data) - length - origin) // STEP + 1):
                    low = max(0, origin + block * STEP)
                    high = min(len(data) - length, origin + (block + 1) * STEP - 1)
                    core = data[origin + (block + 1) * STEP - 1 : origin + block * STEP + length]
                    group = hashlib.blake2b(core, digest_size=8, salt=row["anchor"].to_bytes(8, "little", signed=True), person=block.to_bytes(8, "little")).digest()
                    if low <= high:
                        for column, value in zip(out, (int.from_bytes(group, "little", signed=True), row["anchor"], row["piece"], low, row["n"], left - low, data[low : high + length]), strict=True):
                            column.append(value)
            yield _piece_batch(out)

    return pieces.mapInArrow(run, _PIECE)


def _sorted_groups(pieces: DataFrame, length: int) -> DataFrame:
    """``(anchor, piece, low, high)`` of pieces with a repeated window: the first and last such from the whole piece's own first."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        same = list(zip(*(t[c].to_pylist() for c in ("grp", "piece", "base")), strict=True))
        once = [i for i in range(len(same)) if not i or same[i] != same[i - 1]]  # equal texts bring equal pieces
        t = t.take(pa.array(once)).combine_chunks()
        left = t["left"].to_numpy()
        low, high = repeats(t["grp"].to_numpy(), left, t["bytes"].to_pylist(), length, t["n"].to_numpy())
        shift = left - (length - GRAM) + t["base"].to_numpy()
        out = [t["anchor"].combine_chunks(), t["piece"].combine_chunks(), pa.array(low + shift), pa.array(high + shift)]
        return pa.RecordBatch.from_arrays(out, ["anchor", "piece", "low", "high"]).filter(pa.array(high >= low))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("grp").to_numpy()
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            if held and group[0] != held[-1].column("grp")[-1].as_py():
                cuts = np.append(0, cuts)
            done = 0
            for c in cuts.tolist():  # a group ends here
                if rows + c - done >= 4096:
                    if c > done:
                        held.append(batch.slice(done, c - done))
                    yield solve(held)
                    held, rows, done = [], 0, c
            if done < batch.num_rows:
                held.append(batch.slice(done))
                rows += batch.num_rows - done
        if held:
            yield solve(held)

    return pieces.repartition(F.col("grp")).sortWithinPartitions("grp", "piece", "base").mapInArrow(run, "anchor bigint, piece binary, low bigint, high bigint")


def _counted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same by digests of single windows, counted before they meet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "bytes", 1 << 16):
            rows, windows, keys = [], [], []
            for i, (left, base, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "base", "bytes")), strict=True)):
                for s in range(len(data) - length + 1):
                    rows.append(i)
                    windows.append(base + s)
                    keys.append(hashlib.blake2b(data[s : s + length], digest_size=16, salt=(left - s).to_bytes(8, "little", signed=True)).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("anchor", "piece", "n")), pa.array(windows, pa.int64()), pa.array(keys, pa.binary())], ["anchor", "piece", "n", "window", "key"])

    every = stored(pieces.dropDuplicates(["grp", "piece", "base"]).mapInArrow(run, "anchor bigint, piece binary, n bigint, window bigint, key binary"))
    counts = stored(every.groupBy("anchor", "key").agg(F.sum("n").alias("n")))
    found = spread_join(every.drop("n"), counts.where("n > 1").drop("n"), ["anchor", "key"], heavy_keys(counts, ["anchor", "key"], "n"), ["piece", "window"])
    return found.select("anchor", "piece", F.col("window").alias("low"), F.col("window").alias("high"))


def repeated_spans(docs: DataFrame, length: int = 200, text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The rows with ``spans``: where each text holds strings that start elsewhere too.

    Only the names ``tid``, ``spans`` and ``_salt`` may not be taken.  ``spans`` are pairs ``(low, high)``
    that may overlap; null for none.
    """
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("tid", F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, 16), F.lit(b"")))
    texts = rows.select("tid", F.col(text_col).alias("text")).where(F.octet_length("text") >= length)

    known = stored(_anchor_counts(texts, length).groupBy("anchor").count().where("count > 1"), 8)
    frequent = heavy_keys(known, ["anchor"], "count")
    places = stored(spread_join(_anchor_table(texts, length), known.select("anchor"), ["anchor"], frequent, ["tid", "first"], "left_semi"))
    kinds = stored(places.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.min(F.struct("tid", "first", "left", "windows")).alias("where")))
    # an anchor with one kind of surroundings has nothing to be compared: all of them are repeated
    sizes = kinds.groupBy(F.col("anchor").alias("grp")).count()
    several = sizes.where("count > 1").select(F.col("grp").alias("anchor"))
    compared = spread_join(kinds, several, ["anchor"], heavy_keys(sizes, ["grp"], "count"), ["piece"], "left_semi")
    wanted = compared.groupBy("where.tid").agg(F.collect_list(F.struct("anchor", "piece", "n", "where.first", "where.left", "where.windows")).alias("wanted"))
    copies = heavy_keys(texts.groupBy("tid").count(), ["tid"], "count")
    by = [f"`{f.name}`" for f in docs.schema if f.name != text_col and f.dataType.typeName() != "map"] or ["tid"]
    pieces = _cut(spread_join(rows, wanted, ["tid"], copies, by), text_col, length)
    alone = sizes.where("count = 1").select(F.col("grp").alias("anchor"))
    single = kinds.join(alone, "anchor", "left_semi").select("anchor", "piece", F.lit(0).cast("bigint").alias("low"), (F.col("where.windows") - 1).cast("bigint").alias("high"))
    met = None
    # anchors, and then cores, of too many surroundings are split further
    for narrower in (lambda p: _split(p, length), None):
        hot = sizes.where(F.col("count") > group).select("grp")
        if hot.isEmpty():
            break
        pieces = stored(pieces)
        own = pieces.join(hot, "grp", "left_anti")
        met = _sorted_groups(own, length) if met is None else met.union(_sorted_groups(own, length))
        pieces = pieces.join(hot, "grp", "left_semi")
        if narrower is None:
            met, pieces = met.union(_counted_windows(pieces, length)), None
            break
        pieces = stored(narrower(pieces))
        sizes = pieces.groupBy("grp").count()
    if pieces is not None:
        met = _sorted_groups(pieces, length) if met is None else met.union(_sorted_groups(pieces, length))
    spans = spread_join(places, met.union(single), ["anchor", "piece"], heavy_keys(kinds, ["anchor", "piece"], "n"), ["tid", "first"])
    spans = spans.select("tid", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + length).alias("high"))
    spans = spans.groupBy("tid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    return spread_join(rows, spans, ["tid"], copies, by, "left")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in removed:
        parts.append(data[at:low])
        at = high
    return b"".join([*parts, data[at:]])


def digest_table(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    found = repeated_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), length)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            out: list[list] = [[], [], [], []]
            for data, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                removed = merged(spans)
                kept = hashlib.sha256(kept_bytes(data, removed)).hexdigest()
                for column, value in zip(out, (len(data), sum(b - a for a, b in removed), len(removed), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """The table with each text cut to what is left; characters that lost a byte go as a whole, null stays null.

    Of texts that are equal as a whole one cannot be told from the other, so all lose everything.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    text = own[names.index(text_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            kept = []
            for data, spans in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept.append(None if data is None else kept_bytes(data, merged(spans)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == text else batch.column(c) for c in own], own)

    found = repeated_spans(docs.toDF(*own), length, text)
    return found.mapInArrow(run, ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))).toDF(*names)
