"""Strict JSON requests: an address, a tile and a policy."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Invalid

ADDRESS = "namespace string, model_fingerprint string, prefix_fingerprint string, layer bigint, slot string"
TENSOR = "shape array<int>, axes array<string>, values array<float>"
POLICY = "axis string, group_size int, candidate_bits array<int>, max_abs_error double, max_outlier_fraction double, residual_tokens int, token_axis string"
SCHEMA = f"address struct<{ADDRESS}>, tensor struct<{TENSOR}>, policy struct<{POLICY}>".replace(": ", ":")
KNOWN = {
    "": {"address", "tensor", "policy"},
    "address": {"namespace", "model_fingerprint", "prefix_fingerprint", "layer", "slot"},
    "tensor": {"shape", "axes", "values"},
    "policy": {"axis", "group_size", "candidate_bits", "max_abs_error", "max_outlier_fraction", "residual_tokens", "token_axis"},
}


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One request for each file; a field that the schema lacks is an error, which Spark alone would drop."""
    raw = spark.read.option("wholetext", True).text(path)
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, sorted(KNOWN[""]))))
    for part in ("address", "tensor", "policy"):
        own = F.json_object_keys(F.get_json_object("value", f"$.{part}"))
        extra = F.concat(extra, F.array_except(F.coalesce(own, F.array().cast("array<string>")), F.array(*map(F.lit, sorted(KNOWN[part])))))
    rows = raw.select(F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("r"), extra.alias("extra"))
    checked = F.when(F.size("extra") > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join("extra", ", ")))).otherwise(F.col("r"))
    return rows.select(checked.alias("r")).select("r.*")


def parse_request(text: str) -> dict:
    """The same check for a single request on the driver."""
    value = json.loads(text)
    for part, known in KNOWN.items():
        own = value if not part else value.get(part, {})
        if extra := set(own) - known:
            raise Invalid(f"unknown fields: {', '.join(sorted(extra))}")
    return value
