"""The codec against plain Python over the fixtures of the reference's own tests."""

import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilecask.errors import Corrupt, Invalid
from tilecask.functions import bits as bit_functions
from tilecask.operators import affine, bitset, compact, tensor
from tilecask.sources.tiles import groups_of

TILE = "tile_id string, shape array<int>, axes array<string>, values array<float>"


def tile(spark, shape, axes, values, name="t"):
    return spark.createDataFrame([(name, shape, axes, [float(v) for v in values])], TILE)


def encoded(spark, shape, axes, values, policy, token_axis="token"):
    return affine.encode(groups_of(tile(spark, shape, axes, values), policy, token_axis), policy).orderBy("grp").collect()


def test_policies_and_shapes(spark):
    for bad in (dict(group_size=0), dict(bits=(32,)), dict(error=float("nan")), dict(error=-1.0), dict(outliers=0.2)):
        with pytest.raises(Invalid):
            affine.Policy("token", **bad)
    rows = [([2, 2], ["a", "b"], [1.0] * 4), ([2, 2], ["a", "a"], [1.0] * 4), ([2, 2], ["a", "b"], [1.0] * 3), ([0], ["a"], []), ([2], ["a"], [1.0, float("nan")]), ([2], ["a"], [1.0, float("inf")]), (None, ["a"], [1.0])]
    df = spark.createDataFrame([("t", *r) for r in rows], TILE)
    got = [r[0] for r in df.select(tensor.tile_error(F.col("shape"), F.col("axes"), F.col("values"))).collect()]
    assert got == [None] + ["Invalid"] * 6


def test_groups_follow_the_axis(spark):
    long = tensor.long_form(tile(spark, [3, 2, 2], ["token", "head", "channel"], range(12)))
    for axis, n in (("token", 4), ("head", 6), ("channel", 6)):
        g = tensor.grouped_values(long, axis, 8).orderBy("grp").collect()
        assert len(g) == n
        want = np.moveaxis(np.arange(12.0).reshape(3, 2, 2), ["token", "head", "channel"].index(axis), -1).reshape(n, -1)
        assert [list(r["values"]) for r in g] == want.tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 20), st.floats(0, 0.4), st.integers(0, 2**31), st.sampled_from(["token", "channel"]))
def test_bound_holds(spark, rows, cols, size, error, seed, axis):
    r = random.Random(seed)
    values = [np.float32(r.uniform(-3, 3)) for _ in range(rows * cols)]
    for g in encoded(spark, [rows, cols], ["token", "channel"], values, affine.Policy(axis, size, (2, 4, 8), error, 0.05)):
        worst = max(abs(float(np.float32(a)) - float(np.float32(b))) for a, b in zip(g["values"], g["back"], strict=True))
        assert worst <= error or worst == 0
        assert worst == g["max_err"]


def test_exact_bits_and_zeros(spark):
    r = random.Random(5)
    values = np.array([r.getrandbits(32) for _ in range(100)], np.uint32).view(np.float32)
    values = values[np.isfinite(values)]
    g = encoded(spark, [len(values), 1], ["token", "channel"], values, affine.Policy("token", 32, (2, 4, 8), 0.0))
    assert np.array([x for r in g for x in r["back"]], np.float32).view(np.uint32).tolist() == values.view(np.uint32).tolist()
    negative = encoded(spark, [8, 1], ["token", "channel"], [-0.0] * 8, affine.Policy("token", 8, (2,), 0.0))
    assert [r["bits"] for r in negative] == [32]


def test_tail_outlier_fallback_and_mixed(spark):
    for shape, axes in (([12, 5], ["token", "channel"]), ([5, 12], ["channel", "token"])):
        values = np.array([math.sin(0.137 * i) for i in range(60)], np.float32)
        policy = affine.Policy("token", 4, (2, 4, 8), 1.0, 0.0, 3)
        groups = groups_of(tile(spark, shape, axes, values), policy).where("raw")
        kept = {float(np.float32(v)) for r in groups.collect() for v in r["values"]}
        late = values.reshape(shape)[9:] if axes[0] == "token" else values.reshape(shape)[:, 9:]
        assert {float(v) for v in late.ravel()} <= kept
        assert all(r["bits"] == 32 for r in affine.encode(groups, policy).collect())
    values = [float(i % 4) for i in range(256)]
    values[100] = 10000.0
    g = encoded(spark, [256, 1], ["token", "channel"], values, affine.Policy("token", 256, (2,), 0.01, 0.05))
    assert g[0]["exceptions"] > 0 and g[0]["back"][100] == 10000.0 and g[0]["bits"] == 2
    zeros, waves = [0.0] * 256, [math.sin(i) for i in range(256)]
    g = encoded(spark, [512, 1], ["token", "channel"], zeros + waves, affine.Policy("token", 256, (2, 4, 8), 0.0))
    assert [r["bits"] for r in g] == [2, 32]
    assert [r["offset"] for r in g] == [0, 512]


def test_container_crossing(spark):
    values = [float(i % 4) for i in range(65540)]
    g = encoded(spark, [65540, 1], ["token", "channel"], values, affine.Policy("token", 4096, (2, 4, 8), 0.0))
    assert [v for r in g for v in r["back"]] == values


def portable(ordinals):
    """Size by the public format, container after container."""
    total, halves = 8, {}
    for o in ordinals:
        halves.setdefault(o >> 32, {}).setdefault(o >> 16, []).append(o)
    for boxes in halves.values():
        body, by_runs = 0, 0
        for own in boxes.values():
            runs = sum(1 for i, o in enumerate(own) if i == 0 or o != own[i - 1] + 1)
            plain = 2 * len(own) if len(own) <= 4096 else 8192
            body += min(plain, 2 + 4 * runs)
            by_runs += 2 + 4 * runs < plain
        n = len(boxes)
        total += 4 + body + (4 + -(-n // 8) + 4 * n + (4 * n if n >= 4 else 0) if by_runs else 8 + 8 * n)
    return total


def test_roaring_sizes(spark):
    r = random.Random(1)
    sets = [[], [0], list(range(5000)), list(range(0, 20000, 2)), sorted(r.sample(range(300000), 9000)), [1, 2, 3, 70000, 140000, 210001, 1 << 33], list(range(65530, 65550))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<bigint>")
    got = dict(df.select("i", bitset.roaring_size("s")).collect())
    assert [got[i] for i in range(len(sets))] == [portable(s) for s in sets]
    rows = df.select("i", F.explode("s").alias("ordinal"))
    by_rows = dict(bitset.roaring_size_of_rows(rows, ["i"]).collect())
    assert all(by_rows[i] == portable(s) for i, s in enumerate(sets) if s)
    masks = np.zeros((3, 70000), bool)
    masks[0, sets[2]] = masks[1, sets[3]] = masks[2, sets[6]] = True
    assert affine._sizes(masks).tolist() == [portable(sets[k]) for k in (2, 3, 6)]


def test_bytes_and_planes(spark):
    data = [b"", b"\x00", b"\x55\x00\xff\x00\x00", bytes(range(256))]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d binary").withColumn("o", bitset.bytes_to_ordinals("d"))
    assert [bytes(r[0]) for r in df.select(bitset.ordinals_to_bytes("o")).collect()] == data
    bad = spark.createDataFrame([([1, 9],), ([],), (None,)], "o array<bigint>")
    assert [r[0] for r in bad.select(bitset.ordinals_to_bytes("o")).collect()] == [None] * 3


def test_ordinals_of_many_bytes_are_not_held_at_once(spark):
    """A batch of pages takes the ordinals of a step, whatever its size; they are 32 times as large as the bytes here."""
    data = pd.Series([bytes(range(256)) * 64] * 256 + [None, b""])
    tracemalloc.start()
    parts = 0
    for part in bitset.bytes_to_ordinals.func(iter([data])):
        parts += len(part)
        del part
    whole = bytes(range(256)) * (1 << 14)
    assert parts == 258 and bitset._there_and_back(memoryview(whole)) == (4 * len(whole), 8 * len(whole), True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # 128 MB of ordinals in both cases
    df = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(b"\x03")), (3, None)], "k bigint, d binary")
    assert sorted(map(tuple, bitset.byte_round_trips(df, "k", "d").collect())) == [(1, 4 * len(whole), 8 * len(whole), True), (2, 2, 8, True), (3, None, None, None)]


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("axis", ["token", "channel"])
def test_compact(spark, bits, axis):
    values = np.array([math.sin(0.37 * i) for i in range(70)], np.float32)
    shape, axes = [7, 2, 5], ["token", "head", "channel"]
    g = tensor.grouped_values(tensor.long_form(tile(spark, shape, axes, values)).where("idx < 50"), axis, 1 << 20)
    e = compact.encode(g, compact.CompactPolicy(axis, bits, 2)).withColumn("back", compact.decoded(F.col("codes"), F.col("p"), bits))
    e = e.withColumn("again", bit_functions.unpack_codes("packed", F.lit(bits), F.size("codes"))).orderBy("grp").collect()
    assert sum(len(r["codes"]) for r in e) == 50
    for r in e:
        assert list(r["again"]) == list(r["codes"]) and len(r["packed"]) == r["packed_bytes"]
        width = max(r["values"]) - min(r["values"])
        assert bits == 1 or max(abs(a - b) for a, b in zip(r["values"], r["back"], strict=True)) <= width / ((1 << bits) - 1) / 2 + 1e-6


def test_bf16(spark):
    df = spark.createDataFrame([("a", [1.0, -2.0, 3.0, 4.0, 5.0, -0.0, 7.0, 8.0]), ("b", [0.1])], "tile_id string, tail array<float>")
    assert dict(compact.tail_dtype(df).collect()) == {"a": "bf16-le", "b": "f32-le"}
    words = spark.createDataFrame([([0x3F80, 0xC000],)], "w array<bigint>")
    assert words.select(bit_functions.padded(bit_functions.bf16_decode("w"), 4)).first()[0] == [1.0, -2.0, 0.0, 0.0]


def test_head_slice(spark):
    long = tensor.long_form(tile(spark, [2, 2, 2], ["token", "head", "channel"], range(1, 9)))
    part = tensor.head_slice(long, "head", 1)
    assert sorted(r["v"] for r in part.collect()) == [3, 4, 7, 8]
    back = tensor.head_replace(long, part.withColumn("v", F.col("v") * 10)).orderBy("idx").collect()
    assert [r["v"] for r in back] == [1, 2, 30, 40, 5, 6, 70, 80]


def test_decode_refuses_what_does_not_fit(spark):
    r = random.Random(7)
    values = [np.float32(r.uniform(-3, 3)) for _ in range(90)]
    values[7], values[50] = 1000.0, -77.5
    for policy in (affine.Policy("token", 30, (2, 4, 8), 0.05, 0.1), affine.Policy("token", 9, (4,), 0.0), affine.Policy("token", 9, (8,), 0.5, 0.0, 4)):
        e = affine.encode(groups_of(tile(spark, [30, 3], ["token", "channel"], values), policy), policy)
        e = spark.createDataFrame(e.collect(), e.schema)
        groups = e.select("tile_id", "grp", "offset", "bits", "minimum", "step", "exceptions", F.size("values").cast("bigint").alias("n"))
        ones = affine.ordinals_of(e)
        ones = spark.createDataFrame(ones.collect(), ones.schema)
        got = {x["grp"]: x["values"] for x in affine.decode(groups, ones).collect()}
        assert got == {x["grp"]: x["back"] for x in e.collect()}
        end = e.agg(F.max(F.col("offset") + F.col("span"))).first()[0]
        extra = ones.union(spark.createDataFrame([("t", end)], ones.schema))
        for wrong in (groups.withColumn("offset", F.col("offset") + F.when(F.col("grp") == 1, 1).otherwise(0)), groups.withColumn("bits", F.lit(3)), groups.withColumn("step", F.lit(float("nan"))), groups.withColumn("exceptions", F.col("n") + 1)):
            with pytest.raises(Corrupt):
                affine.decode(wrong, ones)
        with pytest.raises(Corrupt):
            affine.decode(groups, extra)
        if e.where("exceptions > 0").count():
            first = e.where("exceptions > 0").first()
            mask = first["offset"] + len(first["values"]) * first["bits"]
            with pytest.raises(Corrupt):
                affine.decode(groups, ones.where(~F.col("ordinal").between(mask, mask + len(first["values"]) - 1)))
        size = affine.estimate(groups_of(tile(spark, [30, 3], ["token", "channel"], values), policy), policy).first()
        assert size["payload_roaring_bytes"] == spark.range(1).select(bitset.roaring_size(F.array(*[F.lit(x).cast("bigint") for x in sorted(o["ordinal"] for o in ones.collect())]))).first()[0]


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("axis", ["token", "channel"])
def test_compact_tiles(spark, bits, axis):
    r = random.Random(bits)
    exact = [np.float32(r.randrange(-64, 64) / 8) for _ in range(15)]  # brain floats
    cases = [([9, 5], ["token", "channel"], [np.float32(r.uniform(-2, 2)) for _ in range(45)], 3), ([5, 3], ["channel", "token"], exact, 2), ([2, 4, 3], ["token", "head", "channel"], [np.float32(1.5)] * 24, 2), ([2, 2], ["token", "channel"], exact[:4], 9)]
    for shape, axes, values, tail in cases:
        policy = compact.CompactPolicy(axis, bits, tail)
        stored = compact.encode_tiles(tile(spark, shape, axes, values), policy)
        stored = spark.createDataFrame(stored.collect(), stored.schema)
        row = stored.first()
        token = np.arange(len(values)).reshape(shape)
        late = np.isin(np.arange(len(values)), np.moveaxis(token, axes.index("token"), 0)[max(0, shape[axes.index("token")] - tail) :])
        brain = all(int(np.float32(v).view(np.uint32)) & 0xFFFF == 0 for v, k in zip(values, late, strict=True) if k)
        assert row["tail_dtype"] == ("bf16-le" if brain else "f32-le") and len(row["tail"]) == late.sum() * (2 if brain else 4)
        back = compact.decode_tiles(stored, policy).first()
        assert back["error"] is None and all(a == b for a, b, k in zip(back["values"], values, late, strict=True) if k)
        groups = np.moveaxis(token, axes.index(axis), -1).reshape(-1, shape[axes.index(axis)])
        for g in groups:
            own = [i for i in g if not late[i]]
            if own and bits > 1:
                low, high = min(values[i] for i in own), max(values[i] for i in own)
                step = np.float32((float(high) - float(low)) / ((1 << bits) - 1))
                assert all(abs(back["values"][i] - values[i]) <= step / 2 + 1e-5 for i in own)
            elif own:
                assert len({back["values"][i] for i in own}) <= 2
        broken = [("codes", row["codes"] + b"\0"), ("parameters", row["parameters"][:-1] if row["parameters"] else b"1234"), ("tail", row["tail"] + b"\0"), ("tail_dtype", "u8")]
        if len(row["parameters"]):
            broken.append(("parameters", np.full(len(row["parameters"]) // 4, np.inf, "<f4").tobytes()))
        if (~late).sum() * bits % 8:
            broken.append(("codes", bytes(row["codes"][:-1]) + bytes([row["codes"][-1] | 0x80])))
        for column, value in broken:
            value = F.lit(bytearray(value)) if isinstance(value, bytes | bytearray) else F.lit(value)
            bad = compact.decode_tiles(stored.withColumn(column, value), policy).first()
            assert bad["values"] is None and bad["error"].startswith("Corrupt")


def test_layout_sizes(spark):
    """The sizes that the ordinals have, from one step over the codes."""
    r = random.Random(4)
    arrays = [[r.randrange(256) for _ in range(n)] for n in (64, 64, 3, 9000)] + [[0] * 64, []]
    df = spark.createDataFrame([(a,) for a in arrays], "codes array<int>")
    mixed = [portable([8 * i + b for i, c in enumerate(a) for b in range(8) if c >> b & 1]) for a in arrays]
    planes = [portable([b * len(a) + i for b in range(8) for i, c in enumerate(a) if c >> b & 1]) for a in arrays]
    sizes = bitset.layout_sizes(df, "codes", 8)
    assert sorted(map(tuple, sizes.collect())) == sorted(zip(mixed, planes, strict=True))
    assert sizes._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0
