"""Caches over the store, after the reference's own integration tests."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecask.errors import Busy, Corrupt, Invalid
from tilecask.functions import address
from tilecask.operators import affine, bitset, packed, prefix
from tilecask.sources import caches, tiles
from tilecask.sources.store import Reader, Writer

ADDRESS = "namespace string, model_fingerprint string, prefix_fingerprint string, layer bigint, slot string"


def test_tokens(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("input", [0, 1, 258, 4294967295, 0, 37])], "text string, ids array<bigint>")
    with Writer(spark, root) as w:
        caches.put_token_ids(w, rows, "tok")
        with pytest.raises(Invalid):
            caches.put_token_ids(w, spark.createDataFrame([("x", [])], rows.schema), "tok")
    r = Reader(spark, root)
    asked = spark.createDataFrame([("input",), ("other",)], "text string")
    assert dict(caches.get_token_ids(r, asked, "tok").collect()) == {"input": [0, 1, 258, 4294967295, 0, 37], "other": None}
    assert all(x["ids"] is None for x in caches.get_token_ids(r, asked, "another").collect())


def test_bundles(spark, tmp_path):
    root, page = f"file://{tmp_path}/b", 1024
    a = ("n", "m", "p", 0, "s")
    rows = spark.createDataFrame([(*a, [17, 0, 4294967295, 23], "f", bytearray(b"\x55" * 2065))], f"{ADDRESS}, tokens array<bigint>, state_format string, state binary")
    with Writer(spark, root) as w:
        caches.put_bundles(w, rows, page)
        with pytest.raises(Invalid):
            caches.put_bundles(w, rows, page)
        with pytest.raises(Invalid):
            caches.put_bundles(w, rows.withColumn("slot", F.lit("z")).withColumn("tokens", F.array().cast("array<bigint>")), page)
        got = caches.get_bundles(w, rows, page=page).first()
        assert bytes(got["state"]) == b"\x55" * 2065 and got["tokens"] == [17, 0, 4294967295, 23]
        with pytest.raises(Invalid):
            caches.get_bundles(w, rows, state_format="g", page=page)
        pages = w.table("state_pages")
        assert pages.count() == 3
        w.commit({"state_pages": pages.where("page_no != 1")})
        with pytest.raises(Corrupt):
            caches.get_bundles(w, rows, page=page)
        w.commit({"state_pages": pages.withColumn("bytes", F.when(F.col("page_no") == 2, F.lit(bytearray(b"y" * 17))).otherwise(F.col("bytes")))})
        with pytest.raises(Corrupt):
            caches.get_bundles(w, rows, page=page)
        assert caches.get_bundles(w, rows, full=False, page=page).count() == 1
        caches.remove_bundles(w, rows)
        assert w.table("state_pages").count() == 0 and caches.get_bundles(w, rows, page=page).count() == 0


def test_prefixes(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    kind = "namespace string, model_fingerprint string, context string, tokens array<bigint>, state_format string, state binary"
    rows = [("n", "m", "c", [10, 20, 30, 40], "f", bytearray(b"four")), ("n", "m", "c", [10, 20, 30, 40, 50, 60, 70], "f", bytearray(b"seven"))]
    asked = spark.createDataFrame([(1, "n", "m", "c", [10, 20, 30, 40, 50, 60, 70, 80]), (2, "n", "m", "c", [10, 20, 30, 40, 99, 60, 70]), (3, "n", "m", "c", [11, 20, 30, 40]), (4, "n", "m", "d", [10, 20, 30, 40])], "request_id bigint, namespace string, model_fingerprint string, context string, tokens array<bigint>")
    with Writer(spark, root) as w:
        caches.publish_prefixes(w, spark.createDataFrame(rows, kind))
        with pytest.raises(Invalid):
            caches.publish_prefixes(w, spark.createDataFrame(rows[:1], kind))
        assert {r["request_id"]: r["prefix_tokens"] for r in caches.find_longest(w, asked).collect()} == {1: 7, 2: 4}
        assert {r["request_id"]: bytes(r["state"]) for r in caches.read_longest(w, asked, "f").collect()} == {1: b"seven", 2: b"four"}


def test_sessions(spark, tmp_path):
    root = f"file://{tmp_path}/s"

    def point(g, tokens, state):
        return spark.createDataFrame([("n", "m", "s", g, tokens, bytearray(state), bytearray(b"w"))], "namespace string, model_fingerprint string, session_id string, generation bigint, tokens array<bigint>, state binary, workflow binary")

    with Writer(spark, root) as w:
        with pytest.raises(Invalid):
            caches.put_checkpoints(w, point(1, [1, 2, 3], b"abc"), append=True)
        caches.put_checkpoints(w, point(1, [1, 2, 3], b"abc"))
        caches.put_checkpoints(w, point(2, [1, 2, 3, 4], b"abcd"), append=True)
        for bad in (point(2, [1, 2, 3, 4, 5], b"abcde"), point(3, [1, 2, 3, 4, 5], b"aXcde"), point(3, [1, 2, 3, 9, 5], b"abcde"), point(3, [1, 2, 3, 4], b"abcd")):
            with pytest.raises(Invalid):
                caches.put_checkpoints(w, bad, append=True)
        caches.put_checkpoints(w, point(3, [1, 2, 3, 4, 5], b"abcde"), append=True)
        got = caches.get_sessions(w, point(1, [1], b"x")).first()
        assert (got["generation"], bytes(got["state"]), got["tokens"]) == (3, b"abcde", [1, 2, 3, 4, 5])
        which = lambda g: point(g, [1], b"x").select(*caches.SESSION, "generation")
        for g in (1, 3):
            with pytest.raises(Invalid):
                caches.prune_checkpoints(w, which(g))
        caches.prune_checkpoints(w, which(2))
        caches.put_checkpoints(w, point(7, [1, 2, 3, 4, 5, 6], b"abcdef"))
        caches.prune_checkpoints(w, which(1))
        assert bytes(caches.get_sessions(w, point(1, [1], b"x")).first()["state"]) == b"abcdef"


def test_experts(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    kind = "fingerprint binary, format string, layer bigint, expert bigint, bytes binary"
    print_ = bytearray(b"\x01" * 32)
    rows = spark.createDataFrame([(print_, "f", 2, 5, bytearray(b"\x55" * 8193)), (print_, "f", 2, 6, bytearray(b"\x80\0\0\0"))], kind)
    with Writer(spark, root) as w:
        caches.put_experts(w, rows)
        for bad in ((bytearray(32), "f", 2, 7, bytearray(b"x")), (print_, "", 2, 7, bytearray(b"x")), (print_, "f", 2, 7, bytearray())):
            with pytest.raises(Invalid):
                caches.put_experts(w, spark.createDataFrame([bad], kind))
        with pytest.raises(Invalid):
            caches.put_experts(w, rows.union(rows))
        one = rows.where("expert = 6").drop("bytes")
        assert bytes(caches.get_experts(w, one).first()["bytes"]) == b"\x80\0\0\0"
        caches.remove_experts(w, one)
        assert caches.get_experts(w, one).first()["bytes"] is None and caches.get_experts(w, rows.where("expert = 5").drop("bytes"), full=False).first()["bytes"] is not None


# records of several buffers ---------------------------------------------------------


def buffers(*parts):
    """``(name, kind, shape, bytes)`` each."""
    return [(n, d, s, bytearray(b)) for n, d, s, b in parts]


def snapshots(spark, rows):
    return spark.createDataFrame(rows, f"{ADDRESS}, format string, buffers {packed.BUFFERS}")


def test_packed_records(spark, tmp_path):
    root = f"file://{tmp_path}/k"
    a, b = ("n", "m", "p", 0, "k"), ("n", "m", "p", 1, "k")
    whole = buffers(("codes", "u8", [3, 2], b"abcdef"), ("scale", "f32-le", [2], b"12345678"), ("tail", "bf16-le", [1], b"zz"))
    rows = snapshots(spark, [(*a, "f1", whole), (*b, "f1", buffers(("one", "u8", [1], b"x")))])
    asked = spark.createDataFrame([a, b, ("n", "m", "p", 2, "k")], ADDRESS)
    with Writer(spark, root) as w:
        assert caches.get_packed(w, asked, "f1").where("buffers is null").count() == 3
        caches.put_packed(w, rows)
        got = {r["layer"]: r["buffers"] for r in caches.get_packed(w, asked, "f1").collect()}
        assert [(x["name"], x["dtype"], x["shape"], bytes(x["bytes"])) for x in got[0]] == [(n, d, s, bytes(x)) for n, d, s, x in whole] and got[2] is None
        with pytest.raises(Invalid):
            caches.get_packed(w, asked, "f2")
        wrong = [
            buffers(("codes", "u8", [3, 2], b"abcde")),
            buffers(("codes", "i8", [1], b"a")),
            buffers(("codes", "u8", [0], b"")),
            buffers(("codes", "u8", [], b"a")),
            buffers(("", "u8", [1], b"a")),
            buffers(("x", "u8", [1], b"a"), ("x", "u8", [1], b"b")),
            buffers(("x", "f32-le", [1 << 62, 4], b"a")),
            [],
        ]
        for bad in wrong:
            with pytest.raises(Invalid):
                caches.put_packed(w, snapshots(spark, [(*b, "f1", bad)]))
        with pytest.raises(Invalid):
            caches.put_packed(w, rows.union(rows))
        assert w.version == 1
        caches.put_packed(w, snapshots(spark, [(*b, "f1", buffers(("two", "u8", [2], b"yz")))]))
        assert bytes({r["layer"]: r["buffers"] for r in caches.get_packed(w, asked, "f1").collect()}[1][0]["bytes"]) == b"yz"
        assert "payload" not in caches.describe_packed(w, asked).columns and caches.describe_packed(w, asked).count() == 2
        table = w.table("packed")
        w.commit({"packed": table.withColumn("payload", F.lit(bytearray(b"0123456789abcdef")))})
        with pytest.raises(Corrupt):
            caches.get_packed(w, asked.where("layer = 0"), "f1")
        assert caches.get_packed(w, asked.where("layer = 0"), "f1", full=False).count() == 1
        with pytest.raises(Corrupt):
            caches.get_packed(w, asked.where("layer = 1"), "f1", full=False)
        w.commit({"packed": table})
        caches.remove_packed(w, asked.where("layer = 0"))
        assert {r["layer"] for r in caches.get_packed(w, asked, "f1").collect() if r["buffers"]} == {1}


def test_estimates(spark):
    data = [b"", b"a", bytes(8), bytes(range(256)) * 300, b"\xff" * 20000, bytes(9000) + b"\1"]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, d binary")
    both = df.select(bitset.roaring_size_of_bytes("d").alias("a"), bitset.roaring_size(bitset.bytes_to_ordinals("d")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    r = packed.estimated(snapshots(spark, [("n", "m", "p", 0, "k", "f", buffers(("a", "u8", [8], bytes(8)), ("b", "u8", [1], b"\1")))]), list(caches.KEYS)).first()
    assert r["packed_bytes"] == 9 and r["total_roaring_bytes"] == r["payload_roaring_bytes"] + r["metadata_roaring_bytes"]


def attention(spark_rows):
    return [(layer, slot, fmt, buffers(*parts)) for layer, slot, fmt, parts in spark_rows]


BUNDLE = f"{ADDRESS}, tokens array<bigint>, state_format string, state binary, attention {packed.ATTENTION}"


def test_bundles_with_attention(spark, tmp_path):
    root, page = f"file://{tmp_path}/ba", 1024
    a, b = ("n", "m", "p", 0, "s"), ("n", "m", "q", 0, "s")
    parts = attention([(3, "key", "f", [("k", "bf16-le", [2], b"abcd"), ("s", "u8", [1], b"e")]), (0, "value", "g", [("v", "u8", [3], b"xyz")])])
    rows = spark.createDataFrame([(*a, [1, 2], "f", bytearray(b"state" * 500), parts), (*b, [9], "f", bytearray(b"z"), [])], BUNDLE)
    plain = lambda found: [(e["layer"], e["slot"], e["format"], [(x["name"], x["dtype"], x["shape"], bytes(x["bytes"])) for x in e["buffers"]]) for e in found]
    with Writer(spark, root) as w:
        caches.put_bundles(w, rows, page)
        got = {r["prefix_fingerprint"]: r for r in caches.get_bundles(w, rows, page=page).collect()}
        assert plain(got["p"]["attention"]) == plain(spark.createDataFrame([(parts,)], f"a {packed.ATTENTION}").first()["a"]) and got["q"]["attention"] == []
        assert bytes(got["p"]["state"]) == b"state" * 500
        light = {r["prefix_fingerprint"]: r for r in caches.describe_bundles(w, rows, "f").collect()}
        assert [x["length"] for x in light["p"]["attention"][0]["layouts"]] == [4, 1]
        for bad in (attention([(3, "key", "f", [("k", "u8", [2], b"abc")])]), [parts[0], parts[0]]):
            with pytest.raises(Invalid):
                caches.put_bundles(w, spark.createDataFrame([("n", "m", "r", 0, "s", [1], "f", bytearray(b"z"), bad)], BUNDLE), page)
        kept = w.table("attention")
        for broken in (kept.where("entry_no = 0"), kept.withColumn("format", F.lit("h")), kept.withColumn("payload", F.lit(bytearray(b"abcdX")).cast("binary"))):
            w.commit({"attention": broken})
            with pytest.raises(Corrupt):
                caches.get_bundles(w, rows.where("prefix_fingerprint = 'p'"), page=page)
        w.commit({"attention": kept})
        assert caches.get_bundle_pages(w, rows, page=page).count() == 4
        caches.remove_bundles(w, rows.where("prefix_fingerprint = 'p'"))
        assert w.table("attention").count() == 0 and w.table("state_pages").count() == 1 and caches.get_bundles(w, rows, page=page).count() == 1


def test_append_of_attention(spark, tmp_path):
    root = f"file://{tmp_path}/sa"
    kind = f"namespace string, model_fingerprint string, session_id string, generation bigint, tokens array<bigint>, state binary, workflow binary, attention {packed.ATTENTION}"

    def point(g, tokens, state, key, value, name="k", slot="key"):
        parts = attention([(1, slot, "f", [(name, "u8", [len(key)], key), ("s", "u8", [1], b"!")]), (2, "value", "f", [("v", "u8", [len(value)], value)])])
        return spark.createDataFrame([("n", "m", "s", g, tokens, bytearray(state), bytearray(b"w"), parts)], kind)

    with Writer(spark, root) as w:
        caches.put_checkpoints(w, point(1, [1, 2], b"first", b"ab", b"xy"))
        caches.put_checkpoints(w, point(2, [1, 2, 3], b"other state", b"abc", b"xyz"), append="attention")
        for bad in (point(3, [1, 2, 3, 4], b"t", b"aXcd", b"xyz"), point(3, [1, 2, 3, 4], b"t", b"a", b"xyz"), point(3, [1, 2, 3, 4], b"t", b"abcd", b"xyz", name="j"), point(3, [1, 2, 3, 4], b"t", b"abcd", b"xyz", slot="kex"), point(3, [1, 2, 4, 4], b"t", b"abcd", b"xyz")):
            with pytest.raises(Invalid):
                caches.put_checkpoints(w, bad, append="attention")
        caches.put_checkpoints(w, point(3, [1, 2, 3, 4], b"third", b"abcd", b"xyzzz"), append="attention")
        stored = w.table("checkpoints").where("generation = 3").first()
        assert bytes(stored["tails"]) == b"cdzzz" and stored["attention"] is None and stored["base_generation"] == 1
        got = caches.get_sessions(w, point(1, [1], b"x", b"a", b"b")).first()
        found = [(e["layer"], e["slot"], [(x["name"], x["shape"], bytes(x["bytes"])) for x in e["buffers"]]) for e in got["attention"]]
        assert found == [(1, "key", [("k", [4], b"abcd"), ("s", [1], b"!")]), (2, "value", [("v", [5], b"xyzzz")])] and bytes(got["state"]) == b"third"
        total = w.table("checkpoints").where("generation = 3").select(packed.append_logical_bytes(F.lit(5), F.col("tokens"), F.col("plan"))).first()[0]
        assert total == 5 + 16 + 4 + 1 + 5
        good = w.table("checkpoints")
        for column, value in (("tails", bytearray(b"cdzzX")), ("tails", bytearray(b"cdzz")), ("workflow", bytearray(b"v")), ("checkpoint", "0" * 64)):
            w.commit({"checkpoints": good.withColumn(column, F.when(F.col("generation") == 3, F.lit(value)).otherwise(F.col(column)))})
            with pytest.raises(Corrupt):
                caches.get_sessions(w, point(1, [1], b"x", b"a", b"b"))
        w.commit({"checkpoints": good.withColumn("checkpoint", F.lit("0" * 64))})
        with pytest.raises(Corrupt):
            caches.prune_checkpoints(w, point(2, [1], b"x", b"a", b"b"))
        w.commit({"checkpoints": good})
        caches.prune_checkpoints(w, point(2, [1], b"x", b"a", b"b"))
        assert {r["generation"] for r in w.table("checkpoints").collect()} == {1, 3}
    assert spark.range(1).select(packed.geometry_bytes(F.lit(17), F.lit(2), F.lit(3), F.lit(64))).first()[0] == 32 * 2 * 2 * 3 * 64 * 2
    much = spark.range(1).select(packed.append_logical_bytes(F.lit(2**63 - 1), F.array(F.lit(1)), F.array().cast("array<struct<buffers:array<struct<base_len:bigint,tail_len:bigint>>>>"))).first()[0]
    assert much is None


def test_identities(spark):
    df = spark.range(1).select(address.address(F.lit("n"), F.lit("m"), F.lit("p"), F.lit(0), F.lit("s")).alias("a"), address.address(F.lit("x"), F.lit("y"), F.lit("z"), F.lit(7), F.lit("key")).alias("b"))
    r = df.select(address.remapped(F.col("a"), F.col("b")).alias("r"), address.same_identity(F.col("a"), F.col("b")).alias("no"), address.append_state_slot(F.lit("s"), F.lit(3)).alias("p"), address.append_tails_slot(F.lit("s")).alias("t"), address.index_address(F.lit("n"), F.lit("m"), F.lit("c"))["slot"].alias("i")).first()
    assert tuple(r["r"]) == ("n", "m", "p", 7, "key") and not r["no"] and (r["p"], r["t"], r["i"]) == ("s:append-state:3", "s:append-tails", "prepared-index")


def test_commits_cost_what_changes(spark, tmp_path):
    """Files of earlier commits stay as they are, and removals and replacements hold in any order."""
    root = f"file://{tmp_path}/c"
    rows = lambda ids, value: spark.createDataFrame([("n", "m", "p", i, "k", value) for i in ids], f"{ADDRESS}, payload string")
    state = lambda r: {x["layer"]: x["payload"] for x in r.table("records").collect()}
    with Writer(spark, root) as w:
        w.upsert("records", rows(range(50), "a"))
        first = {n: sorted(p.name for p in (tmp_path / "c" / "data" / n).iterdir()) for n in w.files.names("data")}
        w.upsert("records", rows([3, 60], "b"))
        w.remove(["records"], rows([3, 4], ""))
        w.upsert("records", rows([4], "c"))
        w.upsert("records", rows([4, 5], "d"))
        want = {i: "a" for i in range(50)} | {60: "b", 4: "d", 5: "d"}
        del want[3]
        assert state(w) == state(Reader(spark, root)) == want
        assert all(sorted(p.name for p in (tmp_path / "c" / "data" / n).iterdir()) == files for n, files in first.items())
        added = [p for p in w.tables["records"] if p["kind"] == "rows"][1:]
        assert all(sum(1 for _ in w._read([p["place"]]).collect()) <= 2 for p in added)
        w.compact("records")
        assert len(w.tables["records"]) == 1 and state(w) == want
        before = w.version
        seen = []
        shaky = rows([1], "e").withColumn("payload", F.rand().cast("string"))
        w.upsert("records", shaky)
        seen = state(w)[1]
        assert state(w)[1] == seen == state(Reader(spark, root))[1] and w.version == before + 1
        w.files.claim(f"claims/{w.version + 1:012d}")
        with pytest.raises(Busy):
            w.upsert("records", rows([1], "f"))


def test_snapshot_parts(spark):
    df = spark.createDataFrame([(("n", "m", "p", 3, "s"), "f", buffers(("codes", "u8", [2], b"ab"), ("scale", "f32-le", [1], b"1234"))), (("n", "m", "p", 4, "s"), "f", buffers(("codes", "u8", [1], b"z")))], f"address struct<{ADDRESS.replace(' ', ':').replace(',:', ', ')}>, format string, buffers {packed.BUFFERS}")
    got = df.select(packed.one_buffer(F.col("buffers"), "codes").alias("one"), packed.one_buffer(F.col("buffers"), "other").alias("no"), packed.named_buffer(F.col("buffers"), "scale", "f32-le", "bf16-le").alias("scale"), packed.named_buffer(F.col("buffers"), "scale", "u8").alias("wrong")).collect()
    assert [r["one"] and bytes(r["one"]) for r in got] == [None, b"z"] and all(r["no"] is None and r["wrong"] is None for r in got)
    assert bytes(got[0]["scale"]["bytes"]) == b"1234" and got[1]["scale"] is None
    raw = spark.createDataFrame([(bytearray(b"xyz"),)], "d binary").select(packed.raw_buffers("state", F.col("d")).alias("b")).select(packed.snapshot_error(F.lit("f"), F.col("b")).alias("e"), packed.one_buffer(F.col("b"), "state").alias("x")).first()
    assert raw["e"] is None and bytes(raw["x"]) == b"xyz"
    text = packed.packed(df).select(packed.description(F.col("address"), F.col("format"), F.col("layouts"), F.col("payload_sha256")).alias("t"), "layouts", "payload_sha256")
    back = text.select(packed.described(F.col("t")).alias("d"), packed.described(F.struct(F.concat(F.col("t.body"), F.lit(" ")).alias("body"), F.col("t.sha256").alias("sha256"))).alias("no"), "layouts", "payload_sha256").collect()
    assert all(r["d"]["layouts"] == r["layouts"] and r["d"]["payload_sha256"] == r["payload_sha256"] and r["no"] is None for r in back) and {r["d"]["address"]["layer"] for r in back} == {3, 4}


def test_tiles(spark, tmp_path):
    root = f"file://{tmp_path}/tiles"
    kind = f"{ADDRESS}, shape array<int>, axes array<string>, values array<float>"
    cases = [([6, 4], ["token", "channel"], [0.1 * (i * 7 % 11) - 0.4 for i in range(24)]), ([2, 3, 4], ["token", "head", "channel"], [float(i % 5) for i in range(24)])]
    rows = spark.createDataFrame([("n", "m", "p", i, "k", *c) for i, c in enumerate(cases)], kind)
    exact, loose = affine.Policy("token", 4, (2, 4, 8), 0.0), affine.Policy("channel", 3, (2, 4, 8), 0.05, 0.0, 1)
    with Writer(spark, root) as w:
        assert tiles.get_tiles(w, rows).count() == 0
        report = {r["tile_id"]: r for r in tiles.put_tiles(w, rows, loose).collect()}
        assert len(report) == 2 and all(r["max_err"] <= 0.05 + 1e-6 for r in report.values())
        guess = {r["tile_id"]: r for r in tiles.estimate_tiles(rows, loose).collect()}
        assert all(guess[t]["span_bits"] == r["span_bits"] and guess[t]["payload_roaring_bytes"] > 8 for t, r in report.items())
        tiles.put_tiles(w, rows.where("layer = 1"), exact)
        got = {r["layer"]: r for r in tiles.get_tiles(w, rows).collect()}
        assert got[1]["values"] == cases[1][2] and got[1]["shape"] == [2, 3, 4]
        assert max(abs(a - b) for a, b in zip(got[0]["values"], cases[0][2], strict=True)) <= 0.05 + 1e-6
        with pytest.raises(Invalid):
            tiles.put_tiles(w, rows.withColumn("shape", F.array(F.lit(5))), loose)
        table = w.table("tiles")
        longer = F.concat(F.col("payload"), F.lit(bytearray(b"\1")))
        w.commit({"tiles": table.withColumn("payload", longer)})
        with pytest.raises(Corrupt):
            tiles.get_tiles(w, rows)
        w.commit({"tiles": table.withColumn("payload", longer).withColumn("payload_sha256", F.sha2(longer, 256))})
        with pytest.raises(Corrupt):
            tiles.get_tiles(w, rows)
        w.commit({"tiles": table})
        tiles.remove_tiles(w, rows.where("layer = 0"))
        assert {r["layer"] for r in tiles.get_tiles(w, rows).collect()} == {1}


def test_a_tile_stays_one_row(spark, tmp_path):
    """Whole tiles are encoded and decoded without a shuffle of their elements, with the groups and bits of the long form."""
    r = random.Random(3)
    shapes = [([7, 2, 5], ["token", "head", "channel"]), ([5, 9], ["channel", "token"]), ([1, 64], ["token", "channel"])] * 2
    cases = [("n", "m", str(k), 0, "k", s, a, [r.choice((r.uniform(-2, 2), 500.0)) if r.random() < 0.05 else r.uniform(-2, 2) for _ in range(math.prod(s))]) for k, (s, a) in enumerate(shapes)]
    rows = spark.createDataFrame(cases, f"{ADDRESS}, shape array<int>, axes array<string>, values array<float>")
    for policy in (affine.Policy("channel", 3, (2, 4, 8), 0.05, 0.1, 1), affine.Policy("token", 32, (2, 4, 8), 0.02, 0.1, 2)):
        whole = affine.encode_whole(rows, policy)
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        named = rows.withColumn("tile_id", F.col("prefix_fingerprint"))
        long = affine.encode(tiles.groups_of(named, policy), policy)
        long = spark.createDataFrame(long.collect(), long.schema)
        ones = {x["tile_id"]: x["o"] for x in affine.ordinals_of(long).groupBy("tile_id").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).collect()}
        want = {x["tile_id"]: sorted(tuple(g)) for x in long.groupBy("tile_id").agg(F.collect_list(F.struct("grp", "offset", "bits", "minimum", "step", "exceptions", F.size("values").alias("n"), "span", "max_err")).alias("g")).collect() for g in [x["g"]]}
        for x in whole.collect():
            assert [tuple(g)[:9] for g in x["groups"]] == [tuple(g) for g in want[x["prefix_fingerprint"]]]
            bits = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(x["payload"]), np.uint8), bitorder="little"))
            assert bits.tolist() == ones[x["prefix_fingerprint"]]
        stored = whole.withColumn("axis", F.lit(policy.axis)).withColumn("group_size", F.lit(policy.group_size))
        back = affine.decode_whole(stored)
        assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
        for x in back.collect():
            values = cases[int(x["prefix_fingerprint"])][-1]
            assert x["error"] is None and max(abs(a - b) for a, b in zip(x["values"], values, strict=True)) <= policy.error + 1e-4
        group = lambda k, f: F.transform("groups", lambda g: g.withField(k, f(g[k])))
        for wrong in (stored.withColumn("groups", group("offset", lambda o: o + 1)), stored.withColumn("groups", group("bits", lambda b: F.lit(3))), stored.withColumn("groups", F.slice("groups", 2, 100)), stored.withColumn("payload", F.substring("payload", 2, 10000)), stored.withColumn("groups", group("step", lambda s: F.lit(float("nan"))))):
            assert all(x["error"].startswith("Corrupt") for x in affine.decode_whole(wrong).collect())


def test_requests_are_not_multiplied_by_published_lengths(spark):
    """Of 200 published lengths a request meets the rows of its own beginnings and hardly any other."""
    kind = "request_id bigint, namespace string, model_fingerprint string, context string, tokens array<bigint>"
    scope = ["namespace", "model_fingerprint", "context"]
    seed = address.prefix_seed(*[F.col(c) for c in scope])
    own = spark.createDataFrame([(k, "n", "m", "c", [7 * i + (k if i >= 100 else 0) for i in range(200)]) for k in range(20)] + [(20, "n", "m", "c", [(1 << 32) - 1]), (21, "n", "m", "c", []), (22, "n", "m", "c", None)], kind)
    first = own.where("request_id = 0").withColumn("prefix_tokens", F.explode(F.sequence(F.lit(1), F.lit(200))))
    published = first.select(*scope, "prefix_tokens", F.element_at(prefix.digests_at(seed, F.col("tokens"), F.array("prefix_tokens")), 1)["digest"].alias("digest")).cache()
    got = prefix.likely(own, published, scope, seed).join(published, [*scope, "prefix_tokens", "digest"]).groupBy("request_id").agg(F.count("*"), F.max("prefix_tokens")).collect()
    assert sorted(map(tuple, got)) == [(0, 200, 200), *((k, 100, 100) for k in range(1, 20))]
    assert prefix.likely(own, published, scope, seed).count() < 2100 + 20 and prefix.candidates(own, prefix.published_lengths(published, scope), scope, seed).count() > 4000
