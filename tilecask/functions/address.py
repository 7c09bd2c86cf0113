"""Content addresses as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("namespace", "model_fingerprint", "prefix_fingerprint", "layer", "slot")
#: Domains of the digests; pass others to keep two stores apart.
PREFIX_DOMAIN, SESSION_DOMAIN, CHECKPOINT_DOMAIN = "tilecask-prefix/v1", "tilecask-session/v1", "tilecask-checkpoint/v1"


def address(namespace: Column, model: Column, prefix: Column, layer: Column, slot: Column) -> Column:
    """The five parts of an identity; a layer is unsigned 32 bits, hence BIGINT."""
    return F.struct(namespace.alias("namespace"), model.alias("model_fingerprint"), prefix.alias("prefix_fingerprint"), layer.cast("bigint").alias("layer"), slot.alias("slot"))


def reversed_hex(h: Column, n: int) -> Column:
    """The first n bytes of a hex string from last to first."""
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


def le_hex(number: Column, n: int) -> Column:
    """A number's low n bytes, low byte first, as hex."""
    return reversed_hex(F.lpad(F.hex(number.cast("bigint")), 2 * n, "0"), n) if n == 8 else reversed_hex(F.lpad(F.hex(number.cast("bigint").bitwiseAND(F.lit((1 << 8 * n) - 1))), 2 * n, "0"), n)


def record_key(identity: Column) -> Column:
    """First eight bytes of the digest of the compact JSON form, low byte first, even; its successor is the metadata key."""
    digest = F.sha2(F.to_json(F.struct(*[identity[f].alias(f) for f in FIELDS])), 256)
    return F.conv(reversed_hex(digest, 8), 16, -10).cast("bigint").bitwiseAND(F.lit(-2).cast("bigint"))


def address_error(identity: Column) -> Column:
    """Null for a valid identity, else the class of its error."""
    bad = [~F.octet_length(identity[f]).between(1, 4096) | identity[f].isNull() for f in FIELDS if f != "layer"]
    layer = identity["layer"].isNull() | ~identity["layer"].between(0, (1 << 32) - 1)
    for b in bad:
        layer = layer | b
    return F.when(layer, F.lit("Invalid"))


def framed_digest(domain: str, *parts: Column) -> Column:
    """Digest of a domain and of parts that each carry their length, as hex."""
    framed = [F.encode(F.lit(domain), "UTF-8")]
    for p in parts:
        data = F.encode(p, "UTF-8")
        framed += [F.unhex(le_hex(F.octet_length(p), 8)), data]
    return F.sha2(F.concat(*framed), 256)


def prefix_seed(namespace: Column, model: Column, context: Column, domain: str = PREFIX_DOMAIN) -> Column:
    return framed_digest(domain, namespace, model, context)


def chain_step(digest: Column, token: Column) -> Column:
    return F.sha2(F.unhex(F.concat(digest, le_hex(token, 4))), 256)


def chain_digests(seed: Column, tokens: Column) -> Column:
    """Digest after each token; for prompts of some hundred tokens at most, since every step copies the array."""
    start = F.array().cast("array<string>")
    return F.aggregate(tokens, start, lambda done, t: F.concat(done, F.array(chain_step(F.coalesce(F.try_element_at(done, F.lit(-1)), seed), t))))


def token_address(tokenizer: Column, text: Column) -> Column:
    """Identity of the ids of one exact input."""
    return address(F.lit("tilecask-token-cache/v1"), tokenizer, F.sha2(F.encode(text, "UTF-8"), 256), F.lit(0), F.lit("ids"))


def remapped(identity: Column, part: Column) -> Column:
    """A part's address within another identity: its own layer and slot, all else from there."""
    return address(identity["namespace"], identity["model_fingerprint"], identity["prefix_fingerprint"], part["layer"], part["slot"])


def same_identity(identity: Column, part: Column) -> Column:
    """Whether a part belongs to an identity."""
    fields = ("namespace", "model_fingerprint", "prefix_fingerprint")
    return (identity[fields[0]].eqNullSafe(part[fields[0]])) & (identity[fields[1]].eqNullSafe(part[fields[1]])) & (identity[fields[2]].eqNullSafe(part[fields[2]]))


def index_address(namespace: Column, model: Column, context: Column) -> Column:
    """Identity of the list of lengths that a scope has published."""
    return address(namespace, model, prefix_seed(namespace, model, context), F.lit(0), F.lit("prepared-index"))


def append_state_slot(slot: Column, page_no: Column) -> Column:
    return F.concat(slot, F.lit(":append-state:"), page_no.cast("string"))


def append_tails_slot(slot: Column) -> Column:
    return child_slot(slot, "append-tails")


def child_slot(slot: Column, suffix: str) -> Column:
    return F.concat(slot, F.lit(":"), F.lit(suffix))


def session_head(namespace: Column, model: Column, session: Column, domain: str = SESSION_DOMAIN) -> Column:
    return address(namespace, model, framed_digest(domain, session), F.lit(0), F.lit("session-head"))


def session_checkpoint(namespace: Column, model: Column, session: Column, generation: Column, tokens: Column, domain: str = CHECKPOINT_DOMAIN) -> Column:
    head = session_head(namespace, model, session)["prefix_fingerprint"]
    ids = F.unhex(F.array_join(F.transform(tokens, lambda t: le_hex(t, 4)), ""))
    digest = F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.encode(head, "UTF-8"), F.unhex(le_hex(generation, 8)), ids), 256)
    return address(namespace, model, digest, F.lit(0), F.lit("session-checkpoint"))


def expert_address(fingerprint: Column, fmt: Column, layer: Column, expert: Column) -> Column:
    return address(F.lit("tilecask-experts/v1"), F.lower(F.hex(fingerprint)), F.lit("weights"), layer, F.concat(fmt, F.lit(":"), expert.cast("string")))


def decode_ids(data: Column) -> Column:
    """Unsigned 32-bit ids, low byte first, of packed bytes."""
    h = F.hex(data)
    at = F.sequence(F.lit(0), (F.octet_length(data) / 4).cast("int") - 1)
    return F.when(F.octet_length(data) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + 2 * b + 1, F.lit(2)) for b in (3, 2, 1, 0)]), 16, 10).cast("bigint")))
