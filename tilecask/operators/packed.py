"""Records of several named buffers: one payload, a layout that says where each buffer lies, and append-only growth.

A snapshot is ``(format, buffers)`` with buffers ``array<struct<name, dtype, shape, bytes>>``; stored, it is
``(format, layouts, payload, payload_sha256)``.  A bundle's attention is an array of such snapshots with the
layer and slot of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitset import roaring_size_of_bytes

#: Bytes of one element of each kind.
WIDTHS = {"u8": 1, "bf16-le": 2, "f32-le": 4}
#: Limits of one record.
LIMIT, MOST_BUFFERS, MOST_FORMAT, MOST_NAME = 64 << 20, 4096, 4096, 256
BUFFERS = "array<struct<name:string,dtype:string,shape:array<bigint>,bytes:binary>>"
ATTENTION = f"array<struct<layer:bigint,slot:string,format:string,buffers:{BUFFERS}>>"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _width(dtype: Column) -> Column:
    out = F.lit(None).cast("bigint")
    for name, n in WIDTHS.items():
        out = F.when(dtype == name, F.lit(n).cast("bigint")).otherwise(out)
    return out


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries, one after the other; each byte is copied a fixed number of times."""
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


def added(numbers: Column) -> Column:
    """Their sum; null if it leaves 64 bits."""
    return F.aggregate(numbers, _zero(), lambda s, n: F.try_add(s, n.cast("bigint")))


def snapshot_error(fmt: Column, buffers: Column) -> Column:
    """Null for a valid snapshot, else the class of its error."""

    def bad(b: Column) -> Column:
        size = F.aggregate(b["shape"], _width(b["dtype"]), lambda n, d: F.try_multiply(n, d))
        wrong = ~F.octet_length(b["name"]).between(1, MOST_NAME) | ~F.size(b["shape"]).between(1, 8) | F.exists(b["shape"], lambda d: d <= 0)
        return F.coalesce(wrong | (size != F.octet_length(b["bytes"])), F.lit(True))

    total = added(F.transform(buffers, lambda b: F.octet_length(b["bytes"])))
    wrong = ~F.octet_length(fmt).between(1, MOST_FORMAT) | ~F.size(buffers).between(1, MOST_BUFFERS) | F.exists(buffers, bad)
    wrong = wrong | (F.size(F.array_distinct(F.transform(buffers, lambda b: b["name"]))) != F.size(buffers)) | (total > LIMIT)
    return F.when(F.coalesce(wrong, F.lit(True)), F.lit("Invalid"))


def layouts(buffers: Column) -> Column:
    """Name, kind, shape and length of each buffer."""
    return F.transform(buffers, lambda b: F.struct(b["name"].alias("name"), b["dtype"].alias("dtype"), b["shape"].alias("shape"), F.octet_length(b["bytes"]).cast("bigint").alias("length")))


def payload(buffers: Column) -> Column:
    return joined(F.transform(buffers, lambda b: b["bytes"]))


def starts(lengths: Column) -> Column:
    """Where each of some parts begins if they follow one another."""
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i), _zero(), lambda s, n: s + n))


def raw_buffers(name: str, data: Column) -> Column:
    """One buffer of plain bytes."""
    return F.array(F.struct(F.lit(name).alias("name"), F.lit("u8").alias("dtype"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("bytes")))


def one_buffer(buffers: Column, name: str) -> Column:
    """The bytes of a snapshot's only buffer; null if it has others, another name or another kind."""
    only = F.try_element_at(buffers, F.lit(1))
    return F.when((F.size(buffers) == 1) & (only["name"] == name) & (only["dtype"] == "u8"), only["bytes"])


def named_buffer(buffers: Column, name: str, *dtypes: str) -> Column:
    """``struct(dtype, bytes)`` of the buffer of a name; null if there is none or it is of another kind."""
    found = F.try_element_at(F.filter(buffers, lambda b: b["name"] == name), F.lit(1))
    return F.when(found["dtype"].isin(*dtypes), F.struct(found["dtype"].alias("dtype"), found["bytes"].alias("bytes")))


#: What a description holds beside its address.
DESCRIBED = "format string, layouts array<struct<name:string,dtype:string,shape:array<bigint>,length:bigint>>, payload_sha256 string"


def description(identity: Column, fmt: Column, layout: Column, digest: Column) -> Column:
    """``struct(body, sha256)``: a record's description as canonical text and its digest."""
    body = F.to_json(F.struct(identity.alias("address"), fmt.alias("format"), layout.alias("layouts"), digest.alias("payload_sha256")))
    return F.struct(body.alias("body"), F.sha2(F.encode(body, "UTF-8"), 256).alias("sha256"))


def described(text: Column) -> Column:
    """``struct(address, format, layouts, payload_sha256)`` of such a description; null if its digest is another."""
    kind = f"address struct<namespace:string,model_fingerprint:string,prefix_fingerprint:string,layer:bigint,slot:string>, {DESCRIBED}"
    return F.when(F.sha2(F.encode(text["body"], "UTF-8"), 256) == text["sha256"], F.from_json(text["body"], kind))


def layout_error(layout: Column, data: Column) -> Column:
    """Null if the buffers fill the payload and no more."""
    fits = added(F.transform(layout, lambda b: b["length"])) == F.octet_length(data)
    return F.when(~F.coalesce(fits, F.lit(False)), F.lit("Corrupt"))


def sliced(layout: Column, data: Column) -> Column:
    """The buffers of a payload."""
    at = starts(F.transform(layout, lambda b: b["length"]))
    placed = F.zip_with(layout, at, lambda b, o: F.struct(b.alias("b"), o.alias("o")))
    cut = lambda x: F.substring(data, (x["o"] + 1).cast("int"), x["b"]["length"].cast("int"))
    return F.transform(placed, lambda x: F.struct(x["b"]["name"].alias("name"), x["b"]["dtype"].alias("dtype"), x["b"]["shape"].alias("shape"), cut(x).alias("bytes")))


def packed(rows: DataFrame) -> DataFrame:
    """Snapshots ``(.., format, buffers)`` as they are stored."""
    return rows.withColumn("layouts", layouts(F.col("buffers"))).withColumn("payload", payload(F.col("buffers"))).withColumn("payload_sha256", F.sha2("payload", 256)).drop("buffers")


def estimated(rows: DataFrame, identity: list[str]) -> DataFrame:
    """``(identity, packed_bytes, payload_roaring_bytes, metadata_roaring_bytes, total_roaring_bytes)`` of snapshots, without writing them."""
    stored = packed(rows)
    described = F.encode(F.to_json(F.struct(*identity, "format", "layouts", "payload_sha256")), "UTF-8")
    out = stored.select(*identity, F.octet_length("payload").cast("bigint").alias("packed_bytes"), roaring_size_of_bytes(F.col("payload")).alias("payload_roaring_bytes"), roaring_size_of_bytes(described).alias("metadata_roaring_bytes"))
    return out.withColumn("total_roaring_bytes", F.col("payload_roaring_bytes") + F.col("metadata_roaring_bytes"))


# append-only growth ---------------------------------------------------------------


def append_plan(old: Column, new: Column) -> Column:
    """``struct(ok, plan, tails)`` of attention that extends a base's.

    ``old`` has ``(layer, slot, format, layouts, payload_sha256)``, so the base's payloads are not needed:
    what the new buffers begin with must have the base's digest.  ``ok`` is false if entries, names or kinds differ or bytes
    that were there changed.
    """

    def pair(o: Column, n: Column) -> Column:
        both = F.zip_with(o["layouts"], n["buffers"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        same = F.forall(both, lambda x: (x["a"]["name"] == x["b"]["name"]) & (x["a"]["dtype"] == x["b"]["dtype"]) & (F.octet_length(x["b"]["bytes"]) >= x["a"]["length"]))
        head = joined(F.transform(both, lambda x: F.substring(x["b"]["bytes"], F.lit(1), x["a"]["length"].cast("int"))))
        ok = (o["layer"] == n["layer"]) & (o["slot"] == n["slot"]) & (o["format"] == n["format"]) & (F.size(o["layouts"]) == F.size(n["buffers"])) & same & (F.sha2(head, 256) == o["payload_sha256"])
        tail_len = lambda x: (F.octet_length(x["b"]["bytes"]) - x["a"]["length"]).cast("bigint")
        plan = F.transform(both, lambda x: F.struct(x["b"]["name"].alias("name"), x["b"]["dtype"].alias("dtype"), x["b"]["shape"].alias("shape"), x["a"]["length"].alias("base_len"), tail_len(x).alias("tail_len")))
        tails = joined(F.transform(both, lambda x: F.substring(x["b"]["bytes"], (x["a"]["length"] + 1).cast("int"), F.greatest(tail_len(x), _zero()).cast("int"))))
        entry = F.struct(n["layer"].alias("layer"), n["slot"].alias("slot"), n["format"].alias("format"), plan.alias("buffers"))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), entry.alias("entry"), tails.alias("tails"))

    pairs = F.zip_with(old, new, pair)
    ok = (F.size(old) == F.size(new)) & F.forall(pairs, lambda p: p["ok"])
    return F.struct(ok.alias("ok"), F.transform(pairs, lambda p: p["entry"]).alias("plan"), joined(F.transform(pairs, lambda p: p["tails"])).alias("tails"))


def plan_error(plan: Column, tails: Column, most: int) -> Column:
    """Null if a plan's tails are all of the stored ones and within ``most`` bytes."""
    lengths = F.flatten(F.transform(plan, lambda e: F.transform(e["buffers"], lambda b: b["tail_len"])))
    fine = (added(lengths) == F.octet_length(tails)) & (F.octet_length(tails) <= most) & ~F.exists(lengths, lambda n: n < 0)
    return F.when(~F.coalesce(fine, F.lit(False)), F.lit("Corrupt"))


def grown(base: Column, plan: Column, tails: Column) -> Column:
    """A base's attention with each buffer's tail behind it and its new shape; null where base and plan are of different kinds."""
    entry_at = starts(F.transform(plan, lambda e: added(F.transform(e["buffers"], lambda b: b["tail_len"]))))

    def entry(x: Column) -> Column:
        at = starts(F.transform(x["p"]["buffers"], lambda b: b["tail_len"]))
        both = F.zip_with(F.zip_with(x["b"]["buffers"], x["p"]["buffers"], lambda b, p: F.struct(b.alias("b"), p.alias("p"))), at, lambda y, o: F.struct(y["b"].alias("b"), y["p"].alias("p"), (x["o"] + o).alias("o")))
        tail = lambda y: F.substring(tails, (y["o"] + 1).cast("int"), y["p"]["tail_len"].cast("int"))
        buffers = F.transform(both, lambda y: F.struct(y["p"]["name"].alias("name"), y["p"]["dtype"].alias("dtype"), y["p"]["shape"].alias("shape"), F.concat(y["b"]["bytes"], tail(y)).alias("bytes")))
        return F.struct(x["p"]["layer"].alias("layer"), x["p"]["slot"].alias("slot"), x["p"]["format"].alias("format"), buffers.alias("buffers"))

    def fits(x: Column) -> Column:
        same = F.zip_with(x["b"]["buffers"], x["p"]["buffers"], lambda b, p: (b["name"] == p["name"]) & (b["dtype"] == p["dtype"]) & (F.octet_length(b["bytes"]) == p["base_len"]))
        return (x["b"]["layer"] == x["p"]["layer"]) & (x["b"]["slot"] == x["p"]["slot"]) & (x["b"]["format"] == x["p"]["format"]) & F.forall(same, lambda ok: F.coalesce(ok, F.lit(False)))

    placed = F.zip_with(F.zip_with(base, plan, lambda b, p: F.struct(b.alias("b"), p.alias("p"))), entry_at, lambda x, o: F.struct(x["b"].alias("b"), x["p"].alias("p"), o.alias("o")))
    right = (F.size(base) == F.size(plan)) & F.forall(placed, lambda x: F.coalesce(fits(x), F.lit(False)))
    return F.when(right, F.transform(placed, entry))


def append_logical_bytes(state_bytes: Column, tokens: Column, plan: Column) -> Column:
    """Bytes of the whole checkpoint that a delta stands for; null if they leave 64 bits."""
    each = F.flatten(F.transform(plan, lambda e: F.flatten(F.transform(e["buffers"], lambda b: F.array(b["base_len"], b["tail_len"])))))
    return added(F.concat(F.array(state_bytes.cast("bigint"), F.size(tokens).cast("bigint") * 4), each))


def geometry_bytes(capacity: Column, layers: Column, heads: Column, dim: Column) -> Column:
    """Bytes of 16-bit keys and values of a capacity in tokens, in blocks of sixteen."""
    return F.ceil(capacity / 16).cast("bigint") * 16 * layers * 2 * heads * dim * 2
