"""Session generations: heads, append deltas against a full base, restore and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAIL, WORKFLOW = 64 << 20, 1 << 20


def heads(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """The checkpoint of the greatest generation of each session."""
    rest = [c for c in checkpoints.columns if c not in key]
    return checkpoints.groupBy(*key).agg(F.max_by(F.struct(*rest), "generation").alias("h")).select(*key, "h.*")


def accepted(offers: DataFrame, key: list[str], order: str) -> DataFrame:
    """Offers in arrival order with ``ok``: a generation must be above every accepted one, so above all before it."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return offers.withColumn("ok", (F.col("generation") >= 1) & (F.col("generation") > F.coalesce(F.max("generation").over(before), F.lit(0))))


def with_base(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``base_generation``: a full checkpoint is its own, a delta has the last full one before it."""
    order = Window.partitionBy(*key).orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checkpoints.withColumn("base_generation", F.max(F.when(~F.col("is_append"), F.col("generation"))).over(order))


def extends(tokens: Column, base: Column) -> Column:
    """Whether tokens are strictly more than those of the base and begin with them."""
    return (F.size(tokens) > F.size(base)) & (F.slice(tokens, 1, F.size(base)) == base)


def deltas(checkpoints: DataFrame, key: list[str], bytes_col: str) -> DataFrame:
    """Each checkpoint against its base: ``ok`` if the base is a prefix, and the tail."""
    rows = with_base(checkpoints, key)
    base = rows.where("generation = base_generation").select(*key, "base_generation", F.octet_length(bytes_col).alias("base_bytes"), F.sha2(bytes_col, 256).alias("base_sha256"))
    joined = rows.join(base, [*key, "base_generation"])
    head = F.expr(f"substring({bytes_col}, 1, base_bytes)")
    tail = F.expr(f"substring({bytes_col}, base_bytes + 1, octet_length({bytes_col}) - base_bytes)")
    return joined.withColumn("ok", F.sha2(head, 256) == F.col("base_sha256")).withColumn("tail", tail).withColumn("ok", F.col("ok") & (F.octet_length("tail") <= TAIL))


def restored(full: DataFrame, tails: DataFrame, key: list[str], bytes_col: str) -> DataFrame:
    """Every generation's bytes from its base and tail."""
    base = full.select(*key, F.col("generation").alias("base_generation"), F.col(bytes_col).alias("_base"))
    return tails.join(base, [*key, "base_generation"]).select(*key, "generation", F.concat("_base", "tail").alias(bytes_col))


def prunable(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """Generations that are neither their session's head nor the base that the head lives on."""
    rows = with_base(checkpoints, key).select(*key, "generation", "base_generation")
    last = Window.partitionBy(*key)
    head = F.max("generation").over(last)
    base = F.max_by("base_generation", "generation").over(last)
    return rows.withColumn("head", head).withColumn("live", base).where("generation != head and generation != live").select(*key, "generation")
