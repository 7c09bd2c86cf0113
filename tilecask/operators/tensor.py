"""Tensor tiles as rows ``(tile_id, shape, axes, values)`` and their axis groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ELEMENTS = 16 << 20


def tile_error(shape: Column, axes: Column, values: Column) -> Column:
    """Null for a valid tile, else the class of its error."""
    product = F.aggregate(shape, F.lit(1).cast("bigint"), lambda p, n: p * n)
    bad = ~F.size(shape).between(1, 8) | (F.size(shape) != F.size(axes)) | (F.size(F.array_distinct(axes)) != F.size(axes))
    bad = bad | F.exists(shape, lambda n: n <= 0) | F.exists(axes, lambda a: a == "")
    bad = bad | (product > MOST_ELEMENTS) | (product != F.size(values)) | F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(True)), F.lit("Invalid"))


def long_form(tiles: DataFrame) -> DataFrame:
    """A row for each element: ``(tile_id, idx, v)`` with the tile's shape and axes."""
    return tiles.select("tile_id", "shape", "axes", F.posexplode("values").alias("idx", "v"))


def with_groups(long: DataFrame, axis: str, size: int) -> DataFrame:
    """Adds outer, inner and block position, the group's ordinal and the place along the axis."""
    at = F.array_position("axes", axis).cast("int")
    width = F.element_at("shape", at)
    inner_n = F.aggregate(F.slice("shape", at + 1, F.size("shape")), F.lit(1).cast("bigint"), lambda p, n: p * n)
    out = long.withColumn("width", width.cast("bigint")).withColumn("inner_n", inner_n)
    out = out.withColumn("outer", F.expr("idx div (width * inner_n)")).withColumn("inner", F.expr("idx % inner_n")).withColumn("along", F.expr("(idx div inner_n) % width"))
    out = out.withColumn("block", F.expr(f"along div {size}"))
    return out.withColumn("grp", F.expr(f"(outer * inner_n + inner) * cast(ceil(width / {size}) as bigint) + block"))


def grouped_values(long: DataFrame, axis: str, size: int) -> DataFrame:
    """A row for each group: its elements in order as one array."""
    parts = F.array_sort(F.collect_list(F.struct("along", "v")))
    rows = with_groups(long, axis, size).groupBy("tile_id", "grp", "outer", "inner", "block", "width").agg(parts.alias("p"))
    return rows.select("tile_id", "grp", "outer", "inner", "block", "width", F.transform("p", lambda x: x["v"]).alias("values"))


def head_slice(long: DataFrame, axis: str, at: int) -> DataFrame:
    """The elements of one place along an axis."""
    return with_groups(long, axis, 1).where(F.col("along") == at).select("tile_id", "shape", "axes", "idx", "v")


def head_replace(long: DataFrame, part: DataFrame) -> DataFrame:
    """The same with some elements replaced."""
    new = part.select("tile_id", "idx", F.col("v").alias("new"))
    return long.join(new, ["tile_id", "idx"], "left").select("tile_id", "shape", "axes", "idx", F.coalesce("new", "v").alias("v"))
