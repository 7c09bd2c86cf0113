"""Bundles of state pages: cutting, completeness, reassembly and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, MOST_STATE, MOST_PARTS = 8 << 20, 2 << 30, 4096
#: States up to this size are put together in one value.
WHOLE = 256 << 20


def bundle_error(tokens: Column, prefix_tokens: Column, state: Column, parts: Column) -> Column:
    bad = (F.size(tokens) < 1) | (F.size(tokens) != prefix_tokens) | ~F.octet_length(state).between(1, MOST_STATE) | (parts > MOST_PARTS)
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("Invalid"))


def cut_pages(state: DataFrame, keys: list[str], bytes_col: str, page: int = PAGE) -> DataFrame:
    """A row for each page: ``(keys, page_no, bytes)``."""
    n = F.ceil(F.octet_length(bytes_col) / page).cast("int")
    rows = state.where(F.octet_length(bytes_col) > 0).select(*keys, bytes_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    return rows.select(*keys, "page_no", F.expr(f"substring({bytes_col}, page_no * {page} + 1, {page})").alias("bytes"))


def missing_pages(headers: DataFrame, pages: DataFrame, keys: list[str], page: int = PAGE) -> DataFrame:
    """Each bundle's pages that are absent or of a wrong length; headers have ``state_bytes``."""
    n = F.ceil(F.col("state_bytes") / page).cast("int")
    wanted = headers.where("state_bytes > 0").select(*keys, "state_bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_no"))
    wanted = wanted.withColumn("expected", F.least(F.lit(page), F.col("state_bytes") - F.col("page_no") * page))
    there = pages.select(*keys, "page_no", F.octet_length("bytes").alias("found"))
    return wanted.join(there, [*keys, "page_no"], "left").where(F.col("found").isNull() | (F.col("found") != F.col("expected"))).select(*keys, "page_no", "expected", "found")


def page_digests(state: Column, page: int = PAGE) -> Column:
    """The digest of each page of a state, in order."""
    n = F.ceil(F.octet_length(state) / page).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.sha2(F.substring(state, i * page + 1, F.lit(page)), 256))


def assembled(pages: DataFrame, keys: list[str], most: int = WHOLE) -> DataFrame:
    """``(keys, bytes)``: pages in order, as many as there are; null for states above ``most`` bytes, which stay in pages."""
    sizes = pages.groupBy(*keys).agg(F.sum(F.octet_length("bytes")).alias("n"))
    small = pages.join(sizes.where(F.col("n") <= most).select(*keys), keys, "left_semi")
    parts = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "bytes"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    return sizes.select(*keys).join(parts, keys, "left").select(*keys, whole.alias("bytes"))


def verified(headers: DataFrame, pages: DataFrame, keys: list[str], full: bool = True) -> DataFrame:
    """``(keys, ok)``: whether each page of a header ``(keys, page_sha256)`` is there with its digest, and no other.

    Pages are looked at one by one, so a state of any size is.  Without ``full`` the header has ``state_bytes`` and only
    lengths are read.
    """
    if full:
        wanted = headers.select(*keys, F.posexplode_outer("page_sha256").alias("page_no", "expected"))
        both = wanted.join(pages.select(*keys, "page_no", F.sha2("bytes", 256).alias("found")), [*keys, "page_no"], "full_outer")
        each = both.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("found") == F.col("expected"), F.col("found").isNull() & F.col("expected").isNull())).alias("ok"))
        return headers.select(*keys).join(each, keys, "left").select(*keys, F.coalesce("ok", F.lit(False)).alias("ok"))
    sizes = pages.groupBy(*keys).agg(F.sum(F.octet_length("bytes")).alias("found"))
    return headers.join(sizes, keys, "left").select(*keys, F.coalesce(F.col("found") == F.col("state_bytes"), F.lit(False)).alias("ok"))
