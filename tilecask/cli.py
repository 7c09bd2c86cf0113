"""``python -m tilecask.cli put|get|remove|demo``: thin verbs over the store."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.address import FIELDS
from .operators import affine
from .sources import tiles
from .sources.requests import parse_request
from .sources.store import Reader, Writer

ADDRESS = "namespace string, model_fingerprint string, prefix_fingerprint string, layer bigint, slot string"


def _one(spark: SparkSession, address: dict) -> DataFrame:
    return spark.createDataFrame([tuple(address[f] for f in FIELDS)], ADDRESS)


def policy_of(request: dict) -> affine.Policy:
    p = request["policy"]
    return affine.Policy(p["axis"], p["group_size"], tuple(p["candidate_bits"]), p["max_abs_error"], p.get("max_outlier_fraction", 0.0), p.get("residual_tokens", 0))


def put(spark: SparkSession, root: str, request: dict) -> dict:
    t, address = request["tensor"], request["address"]
    row = (*(address[f] for f in FIELDS), t["shape"], t["axes"], [float(v) for v in t["values"]])
    tile = spark.createDataFrame([row], f"{ADDRESS}, shape array<int>, axes array<string>, values array<float>")
    with Writer(spark, root) as store:
        return tiles.put_tiles(store, tile, policy_of(request)).first().asDict()


def get(spark: SparkSession, root: str, address: dict) -> dict | None:
    row = tiles.get_tiles(Reader(spark, root), _one(spark, address)).first()
    return None if row is None else {"shape": row["shape"], "axes": row["axes"], "values": row["values"]}


def remove(spark: SparkSession, root: str, address: dict) -> bool:
    with Writer(spark, root) as store:
        rows = store.table("tiles")
        if rows is None or rows.join(_one(spark, address), list(FIELDS), "left_semi").isEmpty():
            return False
        tiles.remove_tiles(store, _one(spark, address))
    return True


def demo(spark: SparkSession, root: str) -> list[dict]:
    """Two synthetic tiles written, read again and held against their bound."""
    out = []
    for shape, axes in (([64, 2, 64], ["token", "head", "channel"]), ([3, 96, 32], ["head", "token", "channel"])):
        n = shape[0] * shape[1] * shape[2]
        values = [30.0 if i % 251 == 0 else ((i * 17 % 101) - 50) / 50 for i in range(n)]
        for slot, axis in (("key", "token"), ("value", "channel")):
            address = dict(zip(FIELDS, ("demo", f"model-{len(shape)}-{shape[0]}", "prefix", 0, slot), strict=True))
            policy = {"axis": axis, "group_size": 32, "candidate_bits": [2, 4, 8], "max_abs_error": 0.08, "max_outlier_fraction": 0.02, "residual_tokens": 16}
            report = put(spark, root, {"address": address, "tensor": {"shape": shape, "axes": axes, "values": values}, "policy": policy})
            back = get(spark, root, address)["values"]
            worst = max(abs(a - b) for a, b in zip(values, back, strict=True))
            if worst > 0.08 + 1e-6:
                raise RuntimeError(f"{address}: error {worst}")
            out.append({"slot": slot, "shape": shape, "max_err": worst, "span_bits": report["span_bits"]})
    return out


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("put", "get", "remove", "demo"):
        print("usage: put|get|remove STORE FILE, or demo STORE", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tilecask").getOrCreate()
    verb, root = args[0], args[1]
    if verb == "demo":
        print(json.dumps(demo(spark, root), default=str))
        return 0
    with open(args[2], encoding="utf-8") as f:
        text = f.read()
    if verb == "put":
        print(json.dumps(put(spark, root, parse_request(text)), default=str))
    elif verb == "get":
        print(json.dumps(get(spark, root, json.loads(text))))
    else:
        print(json.dumps(remove(spark, root, json.loads(text))))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
