"""Quantised tiles in the store, in batches: put with a report, get through the strict decoder, remove, and estimate without writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from ..functions.address import FIELDS
from ..operators import affine, tensor
from ..operators.running import settled
from .store import Reader, Writer

KEYS = list(FIELDS)
GROUP = ("grp", "offset", "bits", "minimum", "step", "exceptions", "n")
#: What can be wrong with a stored tile, and what is said of it.
ERRORS = {
    "payload": "a tile's payload is not the one published",
    "Corrupt: descriptor": "a tile's descriptors and payload do not fit",
    "Corrupt: payload beyond the descriptors": "a tile's descriptors and payload do not fit",
    "Corrupt: exception mask or value": "an exception mask or a value is wrong",
}


def _named(tiles: DataFrame) -> DataFrame:
    """Tiles known by their address."""
    return tiles.withColumn("layer", F.col("layer").cast("bigint")).withColumn("tile_id", F.to_json(F.struct(*KEYS)))


def groups_of(tiles: DataFrame, policy: affine.Policy, token_axis: str = "token") -> DataFrame:
    """Groups with ``raw`` set where one of their members is in the tail of the token axis."""
    long = tensor.long_form(tiles)
    at = F.array_position("axes", token_axis).cast("int")
    stride = F.aggregate(F.slice("shape", at + 1, F.size("shape")), F.lit(1).cast("bigint"), lambda p, n: p * n)
    width = F.element_at("shape", at)
    token = F.when(at > 0, F.pmod(F.floor(F.col("idx") / stride), width.cast("bigint")))
    long = tensor.with_groups(long, policy.axis, policy.group_size).withColumn("late", F.coalesce(token >= width - policy.tail, F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("along", "v")))
    rows = long.groupBy("tile_id", "grp").agg(parts.alias("p"), F.bool_or("late").alias("raw"))
    return rows.select("tile_id", "grp", F.transform("p", lambda x: x["v"]).alias("values"), "raw")


def put_tiles(store: Writer, tiles: DataFrame, policy: affine.Policy, token_axis: str = "token") -> DataFrame:
    """Encode and insert or replace ``(address fields, shape, axes, values)``, all or none; the report of each tile."""
    bad = tensor.tile_error(F.col("shape"), F.col("axes"), F.col("values")).isNotNull() | ~F.array_contains("axes", policy.axis)
    if not tiles.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise Invalid("a tile's shape, axes and values do not fit")
    encoded = settled(affine.encode_whole(tiles.select(*KEYS, "shape", "axes", "values"), policy, token_axis))
    groups = F.transform("groups", lambda g: F.struct(*[g[c].alias(c) for c in GROUP]))
    store.upsert("tiles", encoded.select(*KEYS, "shape", "axes", F.lit(policy.axis).alias("axis"), F.lit(policy.group_size).alias("group_size"), groups.alias("groups"), "payload", F.sha2("payload", 256).alias("payload_sha256")))
    return affine.reported(_named(encoded).select("tile_id", F.explode("groups").alias("g")).select("tile_id", "g.*"))


def get_tiles(store: Reader, asked: DataFrame, full: bool = True) -> DataFrame:
    """``(address fields, shape, axes, values)`` of the asked tiles that are there, decoded strictly.

    Another digest (if ``full``), descriptors that cannot be right and stray bits are corrupt.
    """
    known = store.table("tiles")
    if known is None:
        return asked.select(*KEYS).limit(0).select(*KEYS, F.lit(None).cast("array<int>").alias("shape"), F.lit(None).cast("array<string>").alias("axes"), F.lit(None).cast("array<float>").alias("values"))
    rows = known.join(asked.select(*KEYS).distinct(), KEYS, "left_semi")
    changed = F.coalesce(F.sha2("payload", 256) != F.col("payload_sha256"), F.lit(False)) if full else F.lit(False)
    found = affine.decode_whole(rows.select(*KEYS, "shape", "axes", "axis", "group_size", "groups", "payload", changed.alias("changed")))
    found = settled(found.withColumn("error", F.when(F.col("changed"), F.lit("payload")).otherwise(F.col("error"))))
    wrong = {r["error"] for r in found.where("error is not null").select("error").distinct().limit(len(ERRORS)).collect()}
    for error, said in ERRORS.items():
        if error in wrong:
            raise Corrupt(said)
    return found.select(*KEYS, "shape", "axes", "values")


def remove_tiles(store: Writer, asked: DataFrame) -> int:
    return store.remove(["tiles"], asked)


def estimate_tiles(tiles: DataFrame, policy: affine.Policy, token_axis: str = "token") -> DataFrame:
    """The report of tiles and their payloads' exact portable sizes, without writing."""
    tiles = _named(tiles)
    bad = tensor.tile_error(F.col("shape"), F.col("axes"), F.col("values")).isNotNull()
    if not tiles.where(bad).isEmpty():
        raise Invalid("a tile's shape, axes and values do not fit")
    return affine.estimate(groups_of(tiles, policy, token_axis), policy)
