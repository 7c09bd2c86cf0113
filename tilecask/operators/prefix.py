"""Longest published prefix of a request's tokens."""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Published lengths of one scope.
MOST_LENGTHS = 4096
#: Bits of a digest by which most of those that are not published are told: a map of 4 MB, whatever the number of prefixes.
TOLD_BY = 25
#: Places of one of Spark's bitmaps.
BITMAP = 4096 * 8


@pandas_udf(ArrayType(StructType([StructField("n", IntegerType()), StructField("digest", StringType())])))
def digests_at(seed: pd.Series, tokens: pd.Series, lengths: pd.Series) -> pd.Series:
    """One pass of the digest chain over each row's tokens, kept at the wanted lengths."""

    def one(s, t, n):
        if s is None or t is None or n is None:
            return []
        wanted, digest, out = set(n), bytes.fromhex(s), []
        last = max((k for k in wanted if k <= len(t)), default=0)
        for k, token in enumerate(t[:last], 1):
            digest = hashlib.sha256(digest + struct.pack("<I", token)).digest()
            if k in wanted:
                out.append({"n": k, "digest": digest.hex()})
        return out

    return pd.Series([one(*row) for row in zip(seed, tokens, lengths, strict=True)])


def published_lengths(published: DataFrame, scope: list[str]) -> DataFrame:
    """The ascending lengths of each scope; ``valid`` is false for lengths below one or too many of them."""
    own = F.sort_array(F.collect_set("prefix_tokens"))
    return published.groupBy(*scope).agg(own.alias("lengths")).withColumn("valid", (F.size("lengths") <= MOST_LENGTHS) & ~F.exists("lengths", lambda n: n < 1))


def candidates(requests: DataFrame, lengths: DataFrame, scope: list[str], seed: Column) -> DataFrame:
    """A row for each request and published length it is long enough for, with the digest there."""
    rows = requests.join(lengths.where("valid"), scope)
    found = F.explode(digests_at(seed, F.col("tokens"), F.col("lengths")))
    return rows.select("request_id", *scope, found.alias("c")).select("request_id", *scope, F.col("c.n").alias("prefix_tokens"), F.col("c.digest").alias("digest"))


def published_map(published: DataFrame) -> bytes:
    """A bit for each beginning of a digest, set if a published one has it; put together by Spark in 1,024 parts of 4 KB."""
    place = F.shiftright(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), 32 - TOLD_BY) + 1
    parts = published.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = bytearray((1 << TOLD_BY) // 8)
    for row in parts.collect():
        at = (row["part"] - 1) * BITMAP // 8
        out[at : at + BITMAP // 8] = row["bits"]
    return bytes(out)


def likely(requests: DataFrame, published: DataFrame, scope: list[str], seed: Column) -> DataFrame:
    """A row for each request and number of tokens, with the digest there, if some published digest may be the same.

    All published ones are among them, and few others, instead of a row for each published length; what joins them by
    digest decides.
    """
    known = requests.sparkSession.sparkContext.broadcast(published_map(published))

    @pandas_udf(ArrayType(StructType([StructField("n", IntegerType()), StructField("digest", StringType())])))
    def told(seed: pd.Series, tokens: pd.Series) -> pd.Series:
        there = known.value

        def one(s, t):
            if s is None or t is None:
                return []
            digest, out = bytes.fromhex(s), []
            for k, token in enumerate(t.tolist(), 1):
                digest = hashlib.sha256(digest + token.to_bytes(4, "little")).digest()
                place = int.from_bytes(digest[:4]) >> 32 - TOLD_BY
                if there[place >> 3] >> (place & 7) & 1:
                    out.append({"n": k, "digest": digest.hex()})
            return out

        return pd.Series([one(*row) for row in zip(seed, tokens, strict=True)])

    rows = requests.select("request_id", *scope, F.explode(told(seed, F.col("tokens"))).alias("c"))
    return rows.select("request_id", *scope, F.col("c.n").alias("prefix_tokens"), F.col("c.digest").alias("digest"))


def longest(requests: DataFrame, published: DataFrame, scope: list[str], seed: Column) -> DataFrame:
    """The longest published prefix of each request that has one: metadata only, no payload column is read."""
    every = candidates(requests, published_lengths(published, scope), scope, seed)
    hits = every.join(published.select(*scope, "prefix_tokens", "digest", "owner"), [*scope, "prefix_tokens", "digest"])
    return hits.groupBy("request_id").agg(F.max("prefix_tokens").alias("prefix_tokens"), F.max_by(F.col("owner"), F.struct("prefix_tokens", -F.col("owner"))).alias("owner"))
