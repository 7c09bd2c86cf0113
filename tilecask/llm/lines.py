"""Removal of lines by pairwise alignment.

Two documents overlap where they share a rare line hash.  What counts as one is a window: a line of
``min_words`` words or a shortest run of lines that has them together, which is seldom
shared by chance, while a short line alone is.  Each later document is paired with the first
one that has the window, which gives one pair for each window and document, however often
it occurs.  Windows cover every line of a block of ``min_words`` words, so a later
document meets a first owner for each line of a block that it shares with any earlier one.  A pair is aligned with patience
diff: lines that are unique in both documents, in their longest common order, hold the
alignment, and the gaps between them are aligned likewise.  A maximal block of aligned
lines is deleted from the later document if it has ``min_words`` words or more.  Judgements
rest on the input; what one pair deletes does not change another.

With ``versions``, a pair whose shingle sets are estimated to resemble each other that far deletes nothing:
they are versions of one document, and which of them stays whole is for near-duplicate removal to say.  What
both share with others goes from both, so that they still resemble each other.

Lines are compared without outer white space; blank lines take no part and go with the
block that surrounds them.  Two different lines of one pair of documents count as equal if their 64-bit hashes
are, once in 10**19 such comparisons.  Documents are ordered by id; rows with a null id or a null or
empty text stay as they are, as does each first document.  Rows of one id with different texts
are documents of their own, in the order of their texts' digests; rows of one id and text are one
document.  Further columns of any name stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .frames import heavy_keys, modest_batches, pieces_of, spread_join, stored, utf8
from .shingles import POWERS, shingle_sets


def line_keys(text: str) -> list[tuple[int, int] | None]:
    """Hash and number of words of each line; None for a blank one."""
    out: list[tuple[int, int] | None] = []
    for line in text.split("\n"):
        line = line.strip()
        out.append((int.from_bytes(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(line.split())) if line else None)
    return out


def spans(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """The shortest runs of lines that have ``min_words`` words, from each line on and up to each line.

    Those inside a block of enough words hold all of its lines.
    """
    out, least = set(), max(1, min_words)
    end = total = 0
    for start, own in enumerate(words):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        out.add((start, end))
        total -= own
    start = total = 0
    for end, own in enumerate(words, 1):
        total += own
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            out.add((start, end))
    return out


def windows(own: list[tuple[int, int]], min_words: int) -> set[int]:
    """A key for each of these runs; a line alone keeps its hash."""
    out = set()
    for a, b in spans([w for _, w in own], min_words):
        run = b"".join(k.to_bytes(8, "little", signed=True) for k, _ in own[a:b])
        out.add(own[a][0] if b == a + 1 else int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little", signed=True))
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by their first, whose second rises: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        n, m = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if m[x] == 1 and n.get(x) == 1}
        held = _rising([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place])
        if not held:  # no line is unique in both: the k-th of a kind meets the k-th
            seen: Counter[int] = Counter()
            nth = {}
            for j in range(b0, b1):
                seen[b[j]] += 1
                nth[b[j], seen[b[j]]] = j
            seen.clear()
            for i in range(a0, a1):
                seen[a[i]] += 1
                if (j := nth.get((a[i], seen[a[i]]))) is not None:
                    held.append((i, j))
            out += _rising(held)
            continue
        edges = [(a0 - 1, b0 - 1), *held, (a1, b1)]
        out += held
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def deleted(first: list[int], later: list[int], words: list[int], min_words: int) -> list[int]:
    """Places of the later document's lines in aligned blocks of enough words."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(first, later), (-2, -2)]:
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = i, j
    return out


def _lines(docs: DataFrame, min_words: int, width: int | None) -> DataFrame:
    """``(id, lines, words, windows, sign)`` of every document: the hashes of its lines that are not blank, the keys of its windows once each, and a signature of its shingles if ``width`` is given."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", keep=POWERS):
            keys = [[k for k in line_keys(t or "") if k] for t in batch.column("text").to_pylist()]
            lines = pa.array([[k[0] for k in own] for own in keys], pa.list_(pa.int64()))
            words = pa.array([[k[1] for k in own] for own in keys], pa.list_(pa.int32()))
            held = pa.array([list(windows(own, min_words)) for own in keys], pa.list_(pa.int64()))
            signs = [minhash.short_signature(x) for x in shingle_sets(utf8(batch.column("text")), width)] if width else [None] * len(keys)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lines, words, held, pa.array(signs, pa.binary())], ["id", "lines", "words", "windows", "sign"])

    return docs.mapInArrow(run, f"id {kind}, lines array<bigint>, words array<int>, windows array<bigint>, sign binary")


def _aligned(pairs: DataFrame, min_words: int, versions: float | None) -> DataFrame:
    """``(id, gone)`` of pairs ``(id, lines, words, sign, other, other_sign)``: places of deleted lines."""
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pairs_of(batches):
            gone = []
            for o, n, w, a, b in zip(*(batch.column(c).to_pylist() for c in ("other", "lines", "words", "sign", "other_sign")), strict=True):
                same = versions is not None and minhash.resemblance(a, b) >= versions
                gone.append([] if same else deleted(o, n, w, min_words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(gone, pa.list_(pa.int32()))], ["id", "gone"])

    def pairs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "lines", 1 << 19):
            yield from pieces_of([batch], "other", 1 << 19)

    return pairs.mapInArrow(run, f"id {kind}, gone array<int>")


def without(text: str, gone: set[int]) -> str:
    """The text without its lines at those places, counted without blank ones, and without blank lines inside a deleted block."""
    out, pending, at, cut = [], [], 0, False
    for line in text.split("\n"):
        if not line.strip():
            pending.append(line)
            continue
        drop = at in gone
        at += 1
        if not (drop and cut):
            out += pending
        pending = []
        if not drop:
            out.append(line)
        cut = drop
    return "\n".join([*out, *([] if cut else pending)])


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, versions: float | None = None, width: int = 5) -> DataFrame:
    """The table with shared blocks deleted from later texts, and ``n_lines_removed``."""
    modest_batches(docs.sparkSession)
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*own)
    key, text = own[names.index(id_col)], own[names.index(text_col)]

    # a document is known by its id and the digest of its text; the order is that of the pair
    name = F.struct(F.col(key).alias("id"), F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16).alias("tid"))
    known = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(name.alias("id"), F.col(text).alias("text"))
    lines = stored(_lines(known, min_words, width if versions is not None else None).where(F.size("lines") > 0).dropDuplicates(["id"]))
    # a document counts once for each window: repeats within it are dropped before the shuffle
    single = lines.select("id", F.explode("windows").alias("line"))
    seen = stored(single.groupBy("line").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), 8)
    met = spread_join(single, seen.drop("n"), ["line"], heavy_keys(seen, ["line"], "n"), ["id"]).where(F.col("id") != F.col("first"))
    pairs = stored(met.select("id", "first").distinct(), 8)
    firsts = heavy_keys(pairs.groupBy("first").count(), ["first"], "count")
    other = lines.select(F.col("id").alias("first"), F.col("lines").alias("other"), F.col("sign").alias("other_sign"))
    pairs = spread_join(pairs.join(lines.select("id", "lines", "words", "sign"), "id"), other, ["first"], firsts, ["id"]).select("id", "lines", "words", "sign", "other", "other_sign")
    gone = _aligned(pairs, min_words, versions).where(F.size("gone") > 0).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"))
    gone = gone.select(F.col("id").alias("gone_of"), "gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text):
            texts, n = [], []
            for value, cut in zip(batch.column(text).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                texts.append(value if value is None or not cut else without(value, set(cut)))
                n.append(len(cut) if value is not None and cut else 0)
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == text else batch.column(c) for c in own), pa.array(n, pa.int32())], [*own, "n"])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))
    out = rows.join(gone, F.when(F.col(key).isNotNull() & F.col(text).isNotNull(), name) == F.col("gone_of"), "left").select(*own, "gone").mapInArrow(run, f"{kinds}, n int")
    return out.toDF(*names, "n_lines_removed")
