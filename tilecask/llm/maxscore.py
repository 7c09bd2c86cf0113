"""Exact top-k by inner product with MaxScore.

A vector's components are its terms: a posting list holds one component of all vectors of
a shard, together with its least and greatest value.  For a query every list has a least and
greatest contribution; counted from the least ones, all contributions are positive and the
greatest are the usual score bounds.  The lists with the largest bounds, those without which
no vector could reach the k-th best score so far, are essential and are traversed for all
vectors; the others are probed, larger bounds first, only for vectors that can still compete.

Shards of vectors meet blocks of queries in cells, a task each; the best of each cell are merged by query.
In a cell the queries go ``TOGETHER``: in an order of lists that is theirs in common, the essential lists of any of them
are traversed as one product of matrices, together with others where too many places could still compete, and a comparison with each
query's k-th best of the shard's first vectors leaves few places to be probed and sorted.  Every query still meets every vector, so the work grows as the product of both numbers.

Scores are exact whatever the size of components.  Where doubles could round, vectors are scaled by powers
of two, the search keeps all that come within its rounding error of the k-th best, and these are
scored again with whole numbers.  A score outside 64 bits is shown as the nearest 64-bit number and
still ranks by its true value.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows
with a null id.  Equal scores go to the smaller id.  Every row of ``queries`` is asked for itself, repeated
ones too, so such an id has as many rows of each rank.  A query's own row in ``vectors`` is no candidate; other
rows of its id are.  The own row of a query that is not taken from ``vectors`` is the first unused
one of equal id and vector, if there is one.  Vectors of another width than the query's are no
candidates.  Further columns are left out.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import modest_batches, settle
from .vectors import by_width

SHARD, QUERIES_AT_ONCE, TOGETHER, PROBES = 8192, 4096, 256, 8
#: Probing one place costs as much as so many places in a product of matrices.
PRODUCTS = 64
#: Up to this size a component may be an exact double in scores that doubles hold exactly.
SMALL = 2.0**20
#: Whole numbers up to this size, and sums of them that stay below it, are exact in single precision.
SINGLE = 2.0**24


def best_of(scores: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """Places of the k greatest scores, smaller ids first among equals; with ``slack`` all within it of the k-th."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack)
    else:
        at = np.arange(len(scores))
    at = at[np.lexsort((ids[at], -scores[at]))]
    return at if slack else at[:k]


def search(query: np.ndarray, lists: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int, sample: int = 256, able: np.ndarray | None = None, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of the k best of a shard, of those that are ``able``; ``lists`` has a row for each component.

    With ``slack``, which must be twice the error of a score or more, all that come within it of the k-th.
    """
    a, b = query * low, query * high
    least, bound = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-bound, kind="stable")
    after = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the lists from here on can add
    base = least.sum()
    if able is None:
        able = np.full(len(ids), True)
    first = np.flatnonzero(able[:sample])
    scores = (query @ lists[:, :sample])[first]
    found = best_of(scores, ids[first], k, slack)
    top_at, top = first[found], scores[found]
    if lists.shape[1] <= sample:
        return top_at, top
    rest = np.arange(sample, lists.shape[1])
    floor = top[k - 1] - slack if len(top) >= k else -np.inf
    essential = max(1, int(np.argmax(base + after < floor))) if (base + after < floor).any() else len(order)
    partial = (query[order[:essential]] @ lists[order[:essential], sample:]) - least[order[:essential]].sum()
    rest, partial = rest[able[sample:]], partial[able[sample:]]
    done = essential
    while True:
        still = base + partial + after[done] >= floor
        rest, partial = rest[still], partial[still]
        if done == len(order) or not len(rest):
            break
        some = order[done : done + PROBES]
        partial = partial + query[some] @ lists[np.ix_(some, rest)] - least[some].sum()
        done += len(some)
    scores = np.concatenate((top, base + partial))
    every = np.concatenate((top_at, rest))
    found = best_of(scores, ids[every], k, slack)
    return every[found], scores[found]


def search_many(queries: np.ndarray, lists: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, sample: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows of queries, places, scores)`` of each query's k best of a shard but for the place ``own``, -1 where there is none.

    Components are whole numbers and their scores exact doubles.
    """
    sizes = [np.sqrt((x.astype(np.float64) ** 2).sum(axis).max(initial=0)) for x, axis in ((queries, 1), (lists, 0))]
    kind = np.float32 if sizes[0] * sizes[1] < SINGLE else np.float64  # no sum of products is larger than that
    queries, lists = queries.astype(kind, copy=False), lists.astype(kind, copy=False)
    low, high = lists.min(1).astype(np.float64), lists.max(1).astype(np.float64)
    found = [_search_some(queries[at : at + TOGETHER], lists, low, high, ids, own[at : at + TOGETHER], k, sample) for at in range(0, len(queries), TOGETHER)]
    asked = [q + at for at, (q, _, _) in zip(range(0, len(queries), TOGETHER), found, strict=True)]
    return np.concatenate(asked), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


def _competing(scores: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Flat places of a matrix of scores that reach their row's least one, which may be rounded down."""
    rounded = least.astype(scores.dtype)
    rounded = np.where(rounded > least, np.nextafter(rounded, np.array(-np.inf, scores.dtype)), rounded)
    return np.flatnonzero(scores >= rounded[:, None])


def _search_some(queries: np.ndarray, lists: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = queries.astype(np.float64)[:, :, None] * np.stack([low, high], axis=1)
    least, most = ends.min(2), ends.max(2)
    order = np.argsort(-(most - least).sum(0), kind="stable")
    least, most = least[:, order], most[:, order]
    rest = np.append(np.cumsum(most[:, ::-1], axis=1)[:, ::-1], np.zeros((len(queries), 1)), axis=1)  # at most from the lists from here on
    some = queries @ lists[:, :sample]
    mine = np.flatnonzero((own >= 0) & (own < some.shape[1]))
    some[mine, own[mine]] = -np.inf
    floor = np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k].astype(np.float64) if some.shape[1] >= k else np.full(len(queries), -np.inf)
    without = np.append(np.zeros((len(queries), 1)), np.cumsum(least, axis=1), axis=1) + rest < floor[:, None]
    done = max(1, int(np.where(without.any(1), without.argmax(1), len(order)).max()))
    if 2 * done > len(order):  # the product of all costs less than probing for what half of them leave
        done = len(order)
    scores = queries @ lists if done == len(order) else queries[:, order[:done]] @ lists[order[:done]]
    at = _competing(scores, floor - rest[:, done])
    if done < len(order) and len(at) * PRODUCTS > scores.size:
        scores += queries[:, order[done:]] @ lists[order[done:]]
        done = len(order)
        at = _competing(scores, floor)
    q, place = np.divmod(at, lists.shape[1])
    still = place != own[q]
    q, place = q[still], place[still]
    score = scores[q, place].astype(np.float64)
    while done < len(order) and len(q):
        probed = order[done : done + PROBES]
        score = score + (queries[np.ix_(q, probed)].astype(np.float64) * lists[np.ix_(probed, place)].T).sum(1)
        done += len(probed)
        still = score + rest[q, done] >= floor[q]
        q, place, score = q[still], place[still], score[still]
    at = np.lexsort((ids[place], -score, q))
    at = at[np.arange(len(at)) - np.searchsorted(q[at], q[at]) < k]
    return q[at], place[at], score[at]


def whole_numbers(values: np.ndarray, scale: float) -> list[int]:
    """``floor(scale * x)`` of each value, exactly; ``scale`` is a power of two."""
    up, down = float(scale).as_integer_ratio()
    return [n * up // (d * down) for n, d in (float(x).as_integer_ratio() for x in values)]


def search_exactly(query: np.ndarray, lists: np.ndarray, ids: np.ndarray, k: int, scale: float, able: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The same for vectors before ``floor`` that need not give exact doubles."""
    parts, sizes = [query[:, None], lists], []
    for i, x in enumerate(parts):
        with np.errstate(over="ignore"):
            x = np.where(np.abs(x) < 2.0**52 / scale, np.floor(x * scale) / scale, x)
        _, exponent = np.frexp(np.abs(x).max())
        parts[i] = np.ldexp(x, -exponent)  # below one
        sizes.append(np.abs(parts[i]).sum(0).max())
    near, own = parts[1], parts[0][:, 0]
    slack = 2.0**-40 * (sizes[0] + sizes[1])
    at, _ = search(own, near, near.min(1), near.max(1), ids, k, able=able, slack=slack)
    asked = whole_numbers(query, scale)
    scores = [sum(a * b for a, b in zip(asked, whole_numbers(lists[:, i], scale), strict=True)) for i in at.tolist()]
    order = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]]))[:k]
    return at[order], [scores[i] for i in order]


def ordered_bytes(n: int) -> bytes:
    """Bytes of a whole number that sort as numbers do."""
    size = (abs(n).bit_length() + 7) // 8
    return (0x8000 + size).to_bytes(2) + n.to_bytes(size) if n >= 0 else (0x8000 - size).to_bytes(2) + ((1 << 8 * size) + n).to_bytes(size)


def _blocks(rows: DataFrame, rows_each: int, name: str, scale: float) -> tuple[DataFrame, int]:
    """Packed blocks ``(name, width, big, ids, rows, places, values)`` of about ``rows_each`` vectors, and the number of block names.

    ``rows`` are a checkpoint, whose order is fixed, so that a row's place can deal it to a block
    however often its id or vector is repeated.  Longer vectors come first in a block, since they tend to have the
    greater scores.
    """
    n = max(1, -(-rows.count() // rows_each))
    numbers = ("id", "row", "place")

    def pack(table: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        known = [table[c].to_numpy() for c in numbers]
        for own, values in by_width(table["vector"].combine_chunks()):
            with np.errstate(over="ignore"):
                size = np.abs(values).max(1)
                large = size * scale * np.sqrt(values.shape[1] / 4096) > SMALL
                order = np.argsort(-((values / np.maximum(size.max(), 1e-300)) ** 2).sum(1), kind="stable")
            for big in (False, True):
                some = order[large[order] == big]
                if len(some):
                    part = values[some].T if big else np.floor(scale * values[some].T)
                    kind = "<f8" if big or np.abs(part).max() > SINGLE else "<f4"
                    packed = (table["at"][0].as_py(), values.shape[1], big, *(x[own[some]].astype("<i8").tobytes() for x in known), part.astype(kind).tobytes())
                    for column, value in zip(out, packed, strict=True):
                        column.append(value)
        kinds = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["at", "width", "big", "ids", "rows", "places", "values"])

    at = F.pmod(F.xxhash64("place"), F.lit(n)).cast("int").alias("at")
    packed = rows.select(at, *numbers, "vector").groupBy("at").applyInArrow(pack, "at int, width int, big boolean, ids binary, rows binary, places binary, values binary")
    return packed.select(F.col("at").alias(name), "width", *(F.col(c).alias(f"{name}_{c}") for c in ("big", "ids", "rows", "places", "values"))), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``(query_id, rank, id, score)``; components are ``floor(scale * x)`` for a power of two, and scores integers."""
    if np.frexp(scale)[0] != 0.5:
        raise ValueError("the scale must be a power of two")
    modest_batches(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        number = F.col(f"`{vector_col}`")
        finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        fine = df.where(F.col(id_col).isNotNull() & number.isNotNull() & (F.size(number) > 0) & finite)
        return settle(fine.select(F.col(id_col).cast("bigint").alias("id"), F.transform(number, lambda x: x.cast("double")).alias("vector")))

    every = whole(vectors).withColumn("place", F.monotonically_increasing_id())
    asked = whole(queries).withColumn("place", F.monotonically_increasing_id())
    # the n-th query of an id and vector is the n-th row that has them
    key, nth = F.xxhash64("vector").alias("key"), F.row_number().over(Window.partitionBy("id", "key").orderBy("place")).alias("nth")
    rows = every.join(asked.select("id").distinct(), "id", "left_semi").select("id", key, "place").select("id", "key", nth, F.col("place").alias("row"))
    asked = settle(asked.select("id", "vector", "place", key).select("*", nth).join(rows, ["id", "key", "nth"], "left").select("id", "vector", "place", F.coalesce("row", F.lit(-1)).alias("row")))
    shards, n_shards = _blocks(every.withColumn("row", F.col("place")), SHARD, "shard", scale)
    questions, n = _blocks(asked, QUERIES_AT_ONCE, "asked", scale)

    names = ["query_id", "query", "id", "score", "beyond"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind="<i8", row=row, batch=batch: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
                width, big = batch.column("width")[row].as_py(), [batch.column(c)[row].as_py() for c in ("shard_big", "asked_big")]
                ids, places, asked_ids, asked_rows, asked_places = (get(c) for c in ("shard_ids", "shard_rows", "asked_ids", "asked_rows", "asked_places"))
                lists, asked = (get(f"{c}_values", "<f4" if len(batch.column(f"{c}_values")[row].as_buffer()) == 4 * width * n else "<f8").reshape(width, n) for c, n in (("shard", len(ids)), ("asked", len(asked_ids))))
                asked = np.ascontiguousarray(asked.T)
                if not any(big):
                    by_place = np.argsort(places)
                    own = by_place[np.minimum(np.searchsorted(places, asked_rows, sorter=by_place), len(places) - 1)]
                    q, found, scores = search_many(asked, lists, ids, np.where(places[own] == asked_rows, own, -1), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked_ids[q], asked_places[q], ids[found], scores.astype(np.int64))] + [pa.nulls(len(q), pa.binary())], names)
                    continue
                # a side that has its floor comes back to the other's scale, which is exact
                lists, asked = (x.astype(np.float64) if own else x.astype(np.float64) / scale for x, own in zip((lists, asked), big, strict=True))
                out: list[list] = [[] for _ in range(5)]
                for own, at, place, query in zip(asked_ids.tolist(), asked_rows.tolist(), asked_places.tolist(), asked, strict=True):
                    found, exact = search_exactly(query, lists, ids, k, scale, places != at)
                    scores = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)
                    for column, value in zip(out, (np.full(len(found), own), np.full(len(found), place), ids[found], scores), strict=False):
                        column.append(value)
                    out[4] += [ordered_bytes(s) if abs(s) >> 62 else None for s in exact]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out[:4]), pa.array(out[4], pa.binary())], names)

    # a cell is much work in one row, so each gets a task where there are not too many
    cells = shards.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(questions, ["asked", "width"]).repartition(min(n_shards * n, 1 << 14))
    best = cells.mapInArrow(run, "query_id bigint, query bigint, id bigint, score bigint, beyond binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
