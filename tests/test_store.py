"""Addresses, commits, bundles, sessions, admission and budgets."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tilecask import cli
from tilecask.errors import Busy, Collision, Corrupt, Invalid
from tilecask.functions import address
from tilecask.operators import admission, allocation, bundles, prefix, sessions
from tilecask.sources.requests import parse_request, read_requests
from tilecask.sources.store import Reader, Writer, problems, with_key
from tilecask.streaming.sessions import accept, windowed_counts

ADDRESS = "namespace string, model_fingerprint string, prefix_fingerprint string, layer bigint, slot string"


def records(spark, rows):
    return spark.createDataFrame(rows, f"{ADDRESS}, payload string")


def test_keys(spark):
    odd = ('a"b', "m\\/", "ü漢", 4294967295, "s")
    got = with_key(spark.createDataFrame([odd], ADDRESS)).first()["key"]
    text = json.dumps(dict(zip(address.FIELDS, odd, strict=True)), separators=(",", ":"), ensure_ascii=False).encode()
    want = struct.unpack("<q", hashlib.sha256(text).digest()[:8])[0] & ~1
    assert got == want
    bad = spark.createDataFrame([("", "m", "p", 0, "s"), ("n", "m", "p", -1, "s"), ("n", "m", "p", 1 << 32, "s"), ("n" * 4097, "m", "p", 0, "s"), ("n", None, "p", 0, "s"), ("n", "m", "p", 0, "s")], ADDRESS)
    identity = F.struct(*address.FIELDS)
    assert [r[0] for r in bad.select(address.address_error(identity)).collect()] == ["Invalid"] * 5 + [None]


def test_chain_and_sessions(spark):
    seed = hashlib.sha256(address.PREFIX_DOMAIN.encode() + b"".join(struct.pack("<Q", len(p)) + p for p in (b"n", b"m", b"c"))).digest()
    tokens, want = [0, 1, 258, 4294967295], []
    for t in tokens:
        seed = hashlib.sha256(seed + struct.pack("<I", t)).digest()
        want.append(seed.hex())
    df = spark.createDataFrame([(tokens,)], "t array<bigint>")
    own = address.prefix_seed(F.lit("n"), F.lit("m"), F.lit("c"))
    assert df.select(address.chain_digests(own, F.col("t"))).first()[0] == want
    some = df.select(prefix.digests_at(own, F.col("t"), F.array(F.lit(2), F.lit(4), F.lit(9)))).first()[0]
    assert [(r["n"], r["digest"]) for r in some] == [(2, want[1]), (4, want[3])]
    head = hashlib.sha256(address.SESSION_DOMAIN.encode() + struct.pack("<Q", 1) + b"s").hexdigest()
    check = hashlib.sha256(address.CHECKPOINT_DOMAIN.encode() + head.encode() + struct.pack("<Q", 7) + b"".join(struct.pack("<I", t) for t in tokens)).hexdigest()
    row = df.select(address.session_checkpoint(F.lit("n"), F.lit("m"), F.lit("s"), F.lit(7), F.col("t")).alias("a")).first()["a"]
    assert row["prefix_fingerprint"] == check
    data = spark.createDataFrame([(bytearray(b"".join(struct.pack("<I", t) for t in tokens)),), (bytearray(),)], "d binary")
    assert [r[0] for r in data.select(address.decode_ids(F.col("d"))).collect()] == [tokens, []]


def test_longest_prefix(spark):
    own = address.prefix_seed(F.lit("n"), F.col("scope"), F.lit("c"))
    base = spark.createDataFrame([("x", [10, 20, 30, 40], 1), ("x", [10, 20, 30, 40, 50, 60, 70], 2)], "scope string, tokens array<bigint>, owner bigint")
    published = base.select("scope", "owner", F.explode(prefix.digests_at(own, F.col("tokens"), F.array(F.size("tokens")))).alias("d")).select("scope", "owner", F.col("d.n").alias("prefix_tokens"), F.col("d.digest").alias("digest"))
    asked = spark.createDataFrame([(1, "x", [10, 20, 30, 40, 50, 60, 70, 80]), (2, "x", [10, 20, 30, 40, 99, 60, 70]), (3, "x", [11, 20, 30, 40]), (4, "y", [10, 20, 30, 40])], "request_id bigint, scope string, tokens array<bigint>")
    got = {r["request_id"]: r["prefix_tokens"] for r in prefix.longest(asked, published, ["scope"], own).collect()}
    assert got == {1: 7, 2: 4}


def test_commits(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a, b = ("n", "m", "p", 1, "k"), ("n", "m", "p", 2, "k")
    with Writer(spark, root) as w:
        w.upsert("records", records(spark, [(*a, "1"), (*b, "2")]))
        with pytest.raises(Busy), Writer(spark, root):
            pass
        old = Reader(spark, root)
        w.upsert("records", records(spark, [(*a, "3")]))
        for rows in ([(*a, "x"), (*a, "y")], [("", "m", "p", 1, "k", "z")]):
            with pytest.raises(Invalid):
                w.upsert("records", records(spark, rows))
        assert w.version == 2
        assert sorted(r["payload"] for r in w.table("records").collect()) == ["2", "3"]
        assert sorted(r["payload"] for r in old.table("records").collect()) == ["1", "2"]
        forged = with_key(records(spark, [(*a, "x")])).withColumn("slot", F.lit("other"))
        assert [r["error_class"] for r in problems(forged, w.table("records")).collect()] == ["Collision"]
        assert issubclass(Collision, Exception)
        asked = spark.createDataFrame([a, ("n", "m", "p", 9, "k")], ADDRESS)
        assert sorted(str(r["payload"]) for r in w.lookup("records", asked).collect()) == ["3", "None"]
        w.remove(["records"], spark.createDataFrame([b], ADDRESS))
        assert [r["payload"] for r in Reader(spark, root).table("records").collect()] == ["3"]
        assert w.vacuum(1) == [1, 2]
    with pytest.raises(Corrupt):
        Reader(spark, root, 1)
    dead = Writer(spark, root).__enter__()
    dead.break_lock()
    with Writer(spark, root) as w:
        assert w.version == 3


def test_requests_and_cli(spark, tmp_path):
    value = {"address": dict(zip(address.FIELDS, ("n", "m", "p", 0, "key"), strict=True)), "tensor": {"shape": [4, 4], "axes": ["token", "channel"], "values": [c + 0.1 * t for t in range(4) for c in range(4)]}, "policy": {"axis": "token", "group_size": 4, "candidate_bits": [2, 4, 8], "max_abs_error": 0.02, "max_outlier_fraction": 0.0, "residual_tokens": 0}}
    (tmp_path / "a.json").write_text(json.dumps(value))
    assert read_requests(spark, f"file://{tmp_path}/a.json").first()["tensor"]["shape"] == [4, 4]
    (tmp_path / "b.json").write_text(json.dumps(value | {"more": 1}))
    with pytest.raises(Exception, match="unknown fields"):
        read_requests(spark, f"file://{tmp_path}/b.json").collect()
    with pytest.raises(Invalid):
        parse_request(json.dumps(value | {"tensor": {"extra": 1}}))
    root = f"file://{tmp_path}/tiles"
    assert cli.get(spark, root, value["address"]) is None
    cli.put(spark, root, value)
    back = cli.get(spark, root, value["address"])
    assert max(abs(x - y) for x, y in zip(back["values"], value["tensor"]["values"], strict=True)) <= 0.02 + 1e-6
    assert cli.remove(spark, root, value["address"]) and not cli.remove(spark, root, value["address"])


def test_demo(spark, tmp_path):
    assert all(r["max_err"] <= 0.08 + 1e-6 for r in cli.demo(spark, f"file://{tmp_path}/demo"))


def test_bundles(spark):
    state = bytes(31 * i % 256 for i in range(2 * 1024 + 17))
    df = spark.createDataFrame([(1, bytearray(state)), (2, bytearray(b"x"))], "id bigint, state binary")
    pages = bundles.cut_pages(df, ["id"], "state", 1024)
    assert {(r["id"], r["page_no"], len(r["bytes"])) for r in pages.collect()} == {(1, 0, 1024), (1, 1, 1024), (1, 2, 17), (2, 0, 1)}
    assert {r["id"]: bytes(r["bytes"]) for r in bundles.assembled(pages, ["id"]).collect()} == {1: state, 2: b"x"}
    headers = df.select("id", F.octet_length("state").alias("state_bytes"), bundles.page_digests(F.col("state"), 1024).alias("page_sha256"))
    holes = pages.where("page_no != 1")
    assert [(r["id"], r["page_no"]) for r in bundles.missing_pages(headers, holes, ["id"], 1024).collect()] == [(1, 1)]
    for full in (True, False):
        assert dict(bundles.verified(headers, holes, ["id"], full).collect()) == {1: False, 2: True}


def test_session_rules(spark):
    c = spark.createDataFrame([("s", 1, False, b"abc"), ("s", 2, True, b"abcd"), ("s", 3, True, b"abcde"), ("s", 4, False, b"abcdef"), ("t", 1, False, b"x"), ("t", 2, True, b"yz")], "k string, generation bigint, is_append boolean, state binary")
    assert {(r["k"], r["generation"]) for r in sessions.prunable(c, ["k"]).collect()} == {("s", 1), ("s", 2), ("s", 3)}
    live = c.where("not (k = 's' and generation = 4)")
    assert {(r["k"], r["generation"]) for r in sessions.prunable(live, ["k"]).collect()} == {("s", 2)}
    d = {(r["k"], r["generation"]): (r["ok"], bytes(r["tail"])) for r in sessions.deltas(c, ["k"], "state").collect()}
    assert d["s", 3] == (True, b"de") and d["s", 4] == (True, b"") and not d["t", 2][0]
    offers = spark.createDataFrame([("s", 2, 1), ("s", 2, 2), ("s", 1, 3), ("s", 5, 4), ("u", 0, 1)], "session string, generation bigint, arrival bigint")
    got = {(r["session"], r["arrival"]): r["ok"] for r in sessions.accepted(offers, ["session"], "arrival").collect()}
    assert got == {("s", 1): True, ("s", 2): False, ("s", 3): False, ("s", 4): True, ("u", 1): False}


def test_session_stream(spark, tmp_path):
    offers = spark.createDataFrame([("s", 2, 1), ("s", 2, 2), ("s", 1, 3), ("s", 5, 4), ("u", 0, 1)], "session string, generation bigint, arrival bigint")
    offers.write.parquet(f"{tmp_path}/in")
    stream = accept(spark.readStream.schema(offers.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("accepted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["session"], r["arrival"]): r["ok"] for r in spark.table("accepted").collect()}
    want = {(r["session"], r["arrival"]): r["ok"] for r in sessions.accepted(offers, ["session"], "arrival").collect()}
    assert got == want
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["n"], r["total"]) for r in windowed_counts(events).collect()] == [(2, 3.0)]


def test_admission(spark):
    t = spark.createDataFrame([(80.0, 20.0, 100.0, 200.0, 3), (80.0, 20.0, 100.0, 200.0, 2), (100.0, 120.0, 100.0, 0.0, 9), (20.0, 20.0, 100.0, 0.0, 1)], "a double, b double, r double, p double, h bigint")
    tiers = F.array(F.struct(F.lit("first").alias("tier"), F.col("a").alias("ms")), F.struct(F.lit("second").alias("tier"), F.col("b").alias("ms")))
    got = t.select(admission.choose_hit(tiers, F.col("r"))["tier"], admission.should_publish(tiers, F.col("r"), F.col("p"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("second", True), ("second", False), (None, False), ("first", True)]
    costs = spark.createDataFrame([(1.0,), (float("nan"),), (-1.0,), (float("inf"),), (None,)], "c double")
    assert [r[0] for r in costs.select(admission.cost_error(F.col("c"))).collect()] == [None] + ["Invalid"] * 4


def test_host_tier():
    t = admission.HostTier(10, 2)
    assert t.offer("a", 6, 60.0) and t.offer("b", 4, 4.0) and t.offer("c", 4, 20.0)
    assert set(t.entries) == {"a", "c"} and not t.offer("d", 6, 30.0)
    lru = admission.HostTier(2, 2)
    assert lru.offer(1, 1, 1.0) and lru.offer(2, 1, 1.0) and lru.get(1) and lru.offer(3, 1, 1.0) and set(lru.entries) == {1, 3}
    both = admission.HostTier(14, 2)
    assert both.offer("a", 7, 60.0) and both.offer("b", 7, 60.0) and not both.offer("c", 12, 110.0)
    built = []
    assert not both.offer("z", 20, 9.0, lambda: built.append(1)) and not built and both.invalidate("a") and not both.invalidate("a")
    with pytest.raises(Invalid):
        both.offer("q", 0, 1.0)


def greedy_by_force(options, budget, free=False, even=False):
    """Purchase after purchase, looking at every option of every item each time."""
    allowed = [[j for j in range(len(o)) if not (even and i % 2 == 0 and j == 0)] for i, o in enumerate(options)]
    picked = [min(a, key=lambda j, o=o: (o[j][0], 0 if free else o[j][1], j)) for o, a in zip(options, allowed, strict=True)]
    left = budget - sum(o[j][0] for o, j in zip(options, picked, strict=True))
    while True:
        found = []
        for i, o in enumerate(options):
            for j in allowed[i]:
                extra, drop = o[j][0] - o[picked[i]][0], o[picked[i]][1] - o[j][1]
                if drop > 0 and extra <= left and (extra > 0 or free and extra == 0):
                    found.append((-(drop / extra if extra else float("inf")), extra, i, j))
        if not found:
            return picked
        _, extra, i, j = min(found)
        left, picked[i] = left - extra, j


def choices_of(spark, pools):
    rows = [(p, i, j, b, s) for p, options in pools.items() for i, o in enumerate(options) for j, (b, s) in enumerate(o)]
    return spark.createDataFrame(rows, "pool string, item bigint, j int, bytes bigint, score double")


def picks(df):
    out = {}
    for r in df.orderBy("pool", "item").collect():
        out.setdefault(r["pool"], []).append(r["j"])
    return out


@pytest.mark.parametrize("free,even", [(False, False), (True, False), (True, True)])
def test_budgets(spark, free, even):
    r = random.Random(17 + free)
    pools = {"a": [[(2, 1.0), (4, 0.0)], [(2, 0.4), (4, 0.0)]], "b": [[(2, 4.0), (4, 1.0), (8, 0.0)], [(2, 1.0), (4, 0.5), (8, 0.0)]], "c": [[(4, 3.0), (4, 2.0), (4, 1.0)]]}
    pools |= {f"r{k}": [[(r.randrange(1, 9), float(r.randrange(6))) for _ in range(3)] for _ in range(12)] for k in range(5)}
    pools["t"] = [[(1, 9.0), (5, 5.0), (7, 3.0), (8, 3.0)] for _ in range(9)]  # equal gains all along
    floor = {p: sum(min(b for j, (b, _) in enumerate(o) if not (even and i % 2 == 0 and j == 0)) for i, o in enumerate(x)) for p, x in pools.items()}
    budgets = {p: n + r.randrange(0, 25) for p, n in floor.items()}
    choices = choices_of(spark, pools)
    budget = spark.createDataFrame(list(budgets.items()), "pool string, budget bigint")
    got = picks(allocation.allocate(choices.join(budget, "pool"), "pool", F.col("budget"), free_upgrades=free, even_floor=even))
    assert got == {p: greedy_by_force(o, budgets[p], free, even) for p, o in pools.items()}
    with pytest.raises(Invalid):
        allocation.allocate(choices, "pool", F.lit(1))
    chosen = spark.createDataFrame([(p, i, j) for p, own in got.items() for i, j in enumerate(own)], "pool string, item bigint, j int")
    assert all(x["ok"] and x["bytes"] == sum(pools[x["pool"]][i][j][0] for i, j in enumerate(got[x["pool"]])) for x in allocation.within(choices, chosen, budget).collect())


def test_dispersed(spark):
    r = random.Random(4)
    pools = {f"p{k}": [[(r.randrange(1, 5), 0.0), (r.randrange(1, 12), 0.0)] for _ in range(r.randrange(1, 40))] for k in range(6)}
    budgets = {p: sum(o[0][0] for o in x) + r.randrange(40) for p, x in pools.items()}
    want = {}
    for p, x in pools.items():
        picked, left = [0] * len(x), budgets[p] - sum(o[0][0] for o in x)
        for i in sorted(range(len(x)), key=lambda i, n=len(x): (i * 73 % n, i)):
            extra = x[i][1][0] - x[i][0][0]
            if extra <= left:
                picked[i], left = 1, left - max(extra, 0)
        want[p] = picked
    budget = spark.createDataFrame(list(budgets.items()), "pool string, budget bigint")
    assert picks(allocation.allocate(choices_of(spark, pools).join(budget, "pool"), "pool", F.col("budget"), "dispersed")) == want


def test_swaps(spark):
    r = random.Random(8)
    pools = {"p": [[(r.randrange(1, 8), float(r.randrange(20)) / 4) for _ in range(3)] for _ in range(14)], "q": [[(1, 3.0 - i), (2, 1.0), (3, 0.5)] for i in range(3)]}
    chosen = spark.createDataFrame([(p, i, r.randrange(3)) for p, x in pools.items() for i in range(len(x))], "pool string, item bigint, j int")
    now = {(x["pool"], x["item"]): x["j"] for x in chosen.collect()}
    for most, slack in ((40, 0), (7, 2), (1000, 3)):
        want = []
        for p, x in pools.items():
            moves = [(i, j, o[j][0] - o[now[p, i]][0], o[now[p, i]][1] - o[j][1]) for i, o in enumerate(x) for j in range(3) if j != now[p, i]]
            want += [-g for _, _, b, g in moves if b <= slack]
            want += [-(a[3] + b[3]) for k, a in enumerate(moves) for b in moves[k + 1 :] if a[0] != b[0] and a[2] + b[2] <= slack]
        got = allocation.swaps(chosen, choices_of(spark, pools), most, slack).collect()
        assert [round(-x["gain"], 9) for x in got] == [round(w, 9) for w in sorted(want)[:most]]


def test_refinement_and_shortlists(spark, tmp_path):
    pools = {"p": [[(1, 4.0), (2, 1.5), (4, 1.0)], [(1, 3.0), (2, 2.9), (4, 0.0)], [(2, 1.0), (3, 0.9), (4, 0.8)]]}
    choices = choices_of(spark, pools)
    loss = lambda c: c.join(choices, ["pool", "item", "j"]).agg(F.sum("score")).first()[0]
    size = lambda c: allocation.chosen_bytes(choices, c).first()["bytes"]
    start = spark.createDataFrame([("p", 0, 0), ("p", 1, 0), ("p", 2, 2)], "pool string, item bigint, j int")
    found, best, trials = allocation.refined(start, choices, lambda c: 8 - size(c), loss)
    assert best < loss(start) and size(found) <= 8 and best == loss(found) and trials > 2
    every = spark.createDataFrame([("p", i, 2) for i in range(3)], "pool string, item bigint, j int")
    assert [x["item"] for x in allocation.one_bit_shortlist(every, choices).collect()] == [2, 0, 1]
    sparse, after, trials = allocation.sparse_one_bit(every, choices, loss, extra=0.5)
    assert picks(sparse) == {"p": [2, 2, 0]} and after == loss(sparse) and trials == 3 + 2
    tiles = allocation.chosen_tiles(choices.withColumn("data", F.encode(F.col("j").cast("string"), "UTF-8")), found)
    with Writer(spark, f"file://{tmp_path}/chosen") as w:
        assert allocation.persist_and_verify(w, "tiles", tiles, ["pool", "item"]) == 1 and w.table("tiles").count() == 3


def test_replay(spark):
    r = random.Random(5)
    rows = [(t, k, r.choice(["get", "offer", "offer", "invalidate"]), r.randrange(12), r.randrange(1, 9), float(r.randrange(-2, 30))) for t in range(3) for k in range(200)]
    trace = spark.createDataFrame(rows, "tier int, at bigint, op string, key bigint, bytes bigint, saving double").repartition(5)
    want = {}
    for t in range(3):
        host = admission.HostTier(20, 5)
        for _, _, op, key, size, saving in [x for x in rows if x[0] == t]:
            host.get(key) if op == "get" else host.invalidate(key) if op == "invalidate" else host.offer(key, size, saving)
        want |= {(t, k): (e.bytes, e.saving, e.used) for k, e in host.entries.items()}
    assert {(x["tier"], x["key"]): (x["bytes"], x["saving"], x["used"]) for x in admission.replay(trace, "tier", ["at"], 20, 5).collect()} == want
