"""Quality of restored state from logits held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda s, x: s + x)


def log_z(logits: Column) -> Column:
    """Stable logarithm of the sum of exponentials."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))

    def step(s: Column, v: Column) -> Column:
        x = v.cast("double")
        return F.when(x > s["top"], F.struct(x.alias("top"), (s["sum"] * F.exp(s["top"] - x) + 1.0).alias("sum"))).otherwise(F.struct(s["top"].alias("top"), (s["sum"] + F.exp(x - s["top"])).alias("sum")))

    return F.aggregate(logits, start, step, lambda s: s["top"] + F.ln(s["sum"]))


def top(logits: Column) -> Column:
    """Place of the greatest logit, the last among equals."""
    return F.array_max(F.transform(logits, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def with_kl(df: DataFrame, p: str, q: str, name: str = "kl") -> DataFrame:
    """Adds the divergence of the second distribution from the first; both normalisers are found once a row."""
    zp, zq = f"_{name}_p", f"_{name}_q"
    df = df.withColumn(zp, log_z(F.col(p))).withColumn(zq, log_z(F.col(q)))
    part = F.zip_with(p, q, lambda a, b: F.exp(a.cast("double") - F.col(zp)) * ((a.cast("double") - F.col(zp)) - (b.cast("double") - F.col(zq))))
    return df.withColumn(name, _sum(part)).drop(zp, zq)


def nll(logits: Column, target: Column) -> Column:
    return log_z(logits) - F.element_at(logits, target + 1).cast("double")


def max_abs(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
