"""Caches on top of the store: token ids, bundles, prefixes, sessions and experts, in batches.

Each put is one commit of all the tables it touches; each get reads one snapshot.  Payloads
are tables of their own, so lookups of metadata read none of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from ..functions import address
from ..functions.address import FIELDS
from ..operators import bundles, packed, prefix, sessions
from ..operators.running import settled
from .store import Reader, Writer, with_key

KEYS = list(FIELDS)


def _spread(rows: DataFrame, identity) -> DataFrame:
    """The parts of an address struct as columns."""
    return rows.withColumn("_a", identity).select(*[F.col(f"_a.{f}").alias(f) for f in FIELDS], *[c for c in rows.columns if c not in FIELDS])


def _or_none(*tables: DataFrame | None) -> DataFrame | None:
    there = [t for t in tables if t is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there) if there else None


def _refuse_known(store: Reader, name: str, rows: DataFrame, keys: list[str]) -> None:
    old = store.table(name)
    if old is not None and not rows.join(old.select(*keys), keys, "left_semi").isEmpty():
        raise Invalid(f"{name}: published records do not change")


# token ids ------------------------------------------------------------------------


def put_token_ids(store: Writer, rows: DataFrame, tokenizer: str) -> int:
    """``rows`` of ``(text, ids)``: the ids of exact inputs; empty ids are refused."""
    if not rows.where((F.size("ids") < 1) | F.exists("ids", lambda i: (i < 0) | (i >= 1 << 32))).isEmpty():
        raise Invalid("token ids must be there and fit 32 bits")
    return store.upsert("tokens", _spread(rows, address.token_address(F.lit(tokenizer), F.col("text"))).drop("text"))


def get_token_ids(store: Reader, rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with ``ids``; null for inputs that are not cached."""
    asked = _spread(rows, address.token_address(F.lit(tokenizer), F.col("text")))
    known = store.table("tokens")
    if known is None:
        return rows.withColumn("ids", F.lit(None).cast("array<bigint>"))
    return asked.join(known.select(*KEYS, "ids"), KEYS, "left").select(*rows.columns, "ids")


# packed records -------------------------------------------------------------------


def put_packed(store: Writer, rows: DataFrame) -> int:
    """Insert or replace snapshots ``(address fields, format, buffers)``, all or none."""
    if not rows.where(packed.snapshot_error(F.col("format"), F.col("buffers")).isNotNull()).isEmpty():
        raise Invalid("a snapshot needs a format and buffers whose bytes fit their shapes")
    return store.upsert("packed", packed.packed(rows.select(*KEYS, "format", "buffers")))


def get_packed(store: Reader, asked: DataFrame, fmt: str, full: bool = True) -> DataFrame:
    """``(address fields, format, buffers)`` of the asked addresses; nulls where there is no record.

    Another format than ``fmt`` is an error; a layout that does not fit the payload and, if ``full``, another digest
    make a record corrupt.
    """
    known = store.table("packed")
    if known is None:
        return asked.select(*KEYS).withColumn("format", F.lit(None).cast("string")).withColumn("buffers", F.lit(None).cast(packed.BUFFERS))
    found = asked.select(*KEYS).join(known, KEYS, "left")
    if not found.where(F.col("format") != fmt).isEmpty():
        raise Invalid(f"a record is not of format {fmt}")
    bad = packed.layout_error(F.col("layouts"), F.col("payload")).isNotNull()
    if full:
        bad = bad | (F.sha2("payload", 256) != F.col("payload_sha256"))
    if not found.where(F.col("format").isNotNull() & bad).isEmpty():
        raise Corrupt("a record's payload is not the one published")
    return found.select(*KEYS, "format", F.when(F.col("format").isNotNull(), packed.sliced(F.col("layouts"), F.col("payload"))).alias("buffers"))


def describe_packed(store: Reader, asked: DataFrame) -> DataFrame | None:
    """Formats, layouts and digests of the asked records; payloads are not read."""
    return store.described("packed", asked, ["payload"])


def remove_packed(store: Writer, asked: DataFrame) -> int:
    return store.remove(["packed"], asked)


# bundles --------------------------------------------------------------------------

BUNDLE_TABLES = ("bundles", "state_pages", "attention")


def _with_attention(rows: DataFrame) -> DataFrame:
    return rows if "attention" in rows.columns else rows.withColumn("attention", F.array().cast(packed.ATTENTION))


def bundle_tables(rows: DataFrame, page: int = bundles.PAGE) -> dict[str, DataFrame]:
    """Header, page and attention tables of ``(address fields, tokens, state_format, state[, attention])``.

    Attention belongs to the bundle: its records have the bundle's namespace, model and prefix, and a layer and a slot
    of their own, whatever bundle they came from.
    """
    rows = _with_attention(rows)
    entries = F.transform("attention", lambda e: F.struct(e["layer"].alias("layer"), e["slot"].alias("slot"), e["format"].alias("format")))
    sizes = (F.size("tokens").cast("bigint").alias("prefix_tokens"), "tokens", "state_format", F.octet_length("state").cast("bigint").alias("state_bytes"))
    header = rows.select(*KEYS, *sizes, bundles.page_digests(F.col("state"), page).alias("page_sha256"), entries.alias("attention"))
    own = rows.select(*KEYS, F.posexplode("attention").alias("entry_no", "e"))
    own = own.select(*KEYS, "entry_no", F.col("e.layer").alias("part_layer"), F.col("e.slot").alias("part_slot"), F.col("e.format").alias("format"), F.col("e.buffers").alias("buffers"))
    return {"bundles": with_key(header), "state_pages": bundles.cut_pages(rows, KEYS, "state", page), "attention": packed.packed(own)}


def _refuse_bundles(rows: DataFrame) -> None:
    rows = _with_attention(rows)
    bad = bundles.bundle_error(F.col("tokens"), F.size("tokens"), F.col("state"), F.size("attention")).isNotNull()
    names = F.transform("attention", lambda e: F.struct(e["layer"], e["slot"]))
    bad = bad | (F.size(F.array_distinct(names)) != F.size("attention")) | F.exists("attention", lambda e: packed.snapshot_error(e["format"], e["buffers"]).isNotNull())
    if not rows.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise Invalid("a bundle needs tokens, a state and valid attention of distinct layers and slots")


def put_bundles(store: Writer, rows: DataFrame, page: int = bundles.PAGE) -> int:
    """Publish bundles that must be new."""
    _refuse_bundles(rows)
    made = bundle_tables(rows, page)
    _refuse_known(store, "bundles", made["bundles"], KEYS)
    store.refuse(made["bundles"], store.table("bundles"))
    return store.append(made)


def _headers(store: Reader, asked: DataFrame, state_format: str | None) -> DataFrame:
    headers = store.table("bundles")
    if headers is None:
        raise Invalid("no bundles")
    headers = headers.join(asked.select(*KEYS).distinct(), KEYS, "left_semi")
    if state_format is not None and not headers.where(F.col("state_format") != state_format).isEmpty():
        raise Invalid(f"a bundle is not of format {state_format}")
    return headers


def get_bundle_pages(store: Reader, asked: DataFrame, full: bool = True, state_format: str | None = None, page: int = bundles.PAGE) -> DataFrame:
    """The pages ``(address fields, page_no, bytes)`` of the asked bundles, for states of any size.

    A missing page, a wrong length and, if ``full``, a wrong digest make the bundle corrupt; another
    format than the asked one is an error.
    """
    headers = _headers(store, asked, state_format)
    own = store.table("state_pages").join(headers.select(*KEYS), KEYS, "left_semi")
    if not bundles.missing_pages(headers, own, KEYS, page).isEmpty():
        raise Corrupt("a bundle lacks a page")
    if full and not bundles.verified(headers, own, KEYS).where("not ok").isEmpty():
        raise Corrupt("a bundle's state is not the one published")
    return own


def get_attention(store: Reader, headers: DataFrame, full: bool = True) -> DataFrame:
    """``(address fields, attention)`` of bundle headers, in the order of their entries; what is absent or not as the header says is corrupt."""
    own = store.table("attention").join(headers.select(*KEYS), KEYS, "left_semi")
    wanted = headers.select(*KEYS, F.posexplode("attention").alias("entry_no", "e"))
    both = wanted.join(own, [*KEYS, "entry_no"], "left")
    bad = F.col("payload").isNull() | (F.col("format") != F.col("e.format")) | (F.col("part_layer") != F.col("e.layer")) | (F.col("part_slot") != F.col("e.slot")) | packed.layout_error(F.col("layouts"), F.col("payload")).isNotNull()
    if full:
        bad = bad | (F.sha2("payload", 256) != F.col("payload_sha256"))
    if not both.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise Corrupt("a bundle's attention is not the one published")
    entry = F.struct("entry_no", "part_layer", "part_slot", "format", packed.sliced(F.col("layouts"), F.col("payload")).alias("buffers"))
    each = both.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    found = F.transform("parts", lambda e: F.struct(e["part_layer"].alias("layer"), e["part_slot"].alias("slot"), e["format"].alias("format"), e["buffers"].alias("buffers")))
    return headers.select(*KEYS).join(each, KEYS, "left").select(*KEYS, F.coalesce(found, F.array().cast(packed.ATTENTION)).alias("attention"))


def get_bundles(store: Reader, asked: DataFrame, full: bool = True, state_format: str | None = None, page: int = bundles.PAGE) -> DataFrame:
    """The asked bundles that are there, whole: ``(address, tokens, state_format, state, attention)``.

    Checked as in :func:`get_bundle_pages`; the state is null where it is too large for one value.
    """
    headers = _headers(store, asked, state_format)
    state = bundles.assembled(get_bundle_pages(store, asked, full, state_format, page), KEYS)
    return headers.select(*KEYS, "tokens", "state_format").join(state, KEYS).join(get_attention(store, headers, full), KEYS).select(*KEYS, "tokens", "state_format", F.col("bytes").alias("state"), "attention")


def describe_bundles(store: Reader, asked: DataFrame, state_format: str) -> DataFrame:
    """``(address, tokens, attention)`` of bundles without states and payloads: attention has layouts and digests."""
    headers = _headers(store, asked, state_format)
    own = store.table("attention").drop("payload").join(headers.select(*KEYS), KEYS, "left_semi")
    entry = F.struct("entry_no", "part_layer", "part_slot", "format", "layouts", "payload_sha256")
    each = own.groupBy(*KEYS).agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    found = F.transform("parts", lambda e: F.struct(e["part_layer"].alias("layer"), e["part_slot"].alias("slot"), e["format"].alias("format"), e["layouts"].alias("layouts"), e["payload_sha256"].alias("payload_sha256")))
    both = headers.join(each, KEYS, "left")
    if not both.where(F.coalesce(F.size("parts"), F.lit(0)) != F.size("attention")).isEmpty():
        raise Corrupt("a bundle lacks attention")
    return both.select(*KEYS, "tokens", found.alias("attention"))


def remove_bundles(store: Writer, asked: DataFrame) -> int:
    """Headers, pages and attention of the asked bundles in one commit."""
    return store.remove(BUNDLE_TABLES, asked)


# prefixes -------------------------------------------------------------------------


def publish_prefixes(store: Writer, rows: DataFrame, page: int = bundles.PAGE) -> int:
    """Bundles ``(namespace, model_fingerprint, context, tokens, state_format, state)`` found later by their tokens."""
    seed = address.prefix_seed(F.col("namespace"), F.col("model_fingerprint"), F.col("context"))
    last = prefix.digests_at(seed, F.col("tokens"), F.array(F.size("tokens")))
    rows = rows.withColumn("prefix_fingerprint", F.element_at(last, 1)["digest"]).withColumn("layer", F.lit(0).cast("bigint")).withColumn("slot", F.lit("prepared-manifest"))
    rows = settled(rows)  # else each of the tables would go through all chains again
    made = bundle_tables(rows, page)
    _refuse_known(store, "bundles", made["bundles"], KEYS)
    index = rows.select("namespace", "model_fingerprint", "context", F.size("tokens").alias("prefix_tokens"), F.col("prefix_fingerprint").alias("digest"))
    many = _or_none(store.table("prefixes"), index).groupBy("namespace", "model_fingerprint", "context").agg(F.count_distinct("prefix_tokens").alias("n"))
    if not many.where(F.col("n") > prefix.MOST_LENGTHS).isEmpty():
        raise Invalid("too many lengths in a scope")
    return store.append(made | {"prefixes": index})


def find_longest(store: Reader, requests: DataFrame) -> DataFrame:
    """``(request_id, prefix_tokens, address)`` of requests ``(request_id, namespace, model_fingerprint, context, tokens)``: metadata only."""
    scope = ["namespace", "model_fingerprint", "context"]
    seed = address.prefix_seed(F.col("namespace"), F.col("model_fingerprint"), F.col("context"))
    known = store.table("prefixes")
    known = known.join(prefix.published_lengths(known, scope).where("valid").select(*scope), scope)
    hits = prefix.likely(requests, known, scope, seed).join(known, [*scope, "prefix_tokens", "digest"])
    best = hits.groupBy("request_id").agg(F.max_by(F.struct("prefix_tokens", "namespace", "model_fingerprint", F.col("digest").alias("prefix_fingerprint"), F.lit(0).cast("bigint").alias("layer"), F.lit("prepared-manifest").alias("slot")), "prefix_tokens").alias("hit"))
    return best.select("request_id", "hit.*")


def read_longest(store: Reader, requests: DataFrame, state_format: str | None = None, page: int = bundles.PAGE) -> DataFrame:
    """The bundle of each hit; its tokens must be the request's own beginning."""
    hits = settled(find_longest(store, requests))  # each check of the bundles would look for them again
    whole = hits.join(get_bundles(store, hits, True, state_format, page), KEYS).join(requests.select("request_id", F.col("tokens").alias("_asked")), "request_id")
    if not whole.where(F.slice("_asked", 1, F.col("prefix_tokens").cast("int")) != F.col("tokens")).isEmpty():
        raise Corrupt("a published prefix has other tokens than its digest says")
    return whole.drop("_asked")


# sessions -------------------------------------------------------------------------

SESSION = ["namespace", "model_fingerprint", "session_id"]
POINT = [*SESSION, "generation"]


def _checkpoint_digest(generation: str = "generation", tokens: str = "tokens"):
    """The part of a checkpoint's address that its session, generation and tokens make."""
    return address.session_checkpoint(F.col("namespace"), F.col("model_fingerprint"), F.col("session_id"), F.col(generation), F.col(tokens))["prefix_fingerprint"]


def put_checkpoints(store: Writer, rows: DataFrame, append: bool | str = False) -> int:
    """Publish one new generation for each session: ``(session columns, generation, tokens, state, workflow[, attention])``.

    Generations must grow.  With ``append`` the tokens must extend the current head's.  Of ``"state"`` (or True) only what
    the state has beyond its full base is kept; of ``"attention"`` the state is kept whole and each attention buffer's
    bytes beyond the base's, which must be as they were.
    """
    append = "state" if append is True else append
    rows = _with_attention(rows)
    if not rows.where((F.col("generation") < 1) | (F.size("tokens") < 1) | ~F.octet_length("workflow").between(1, sessions.WORKFLOW)).isEmpty():
        raise Invalid("a checkpoint needs a generation, tokens and a workflow")
    if not rows.where(F.exists("attention", lambda e: packed.snapshot_error(e["format"], e["buffers"]).isNotNull())).isEmpty():
        raise Invalid("a checkpoint's attention is not valid")
    if not rows.groupBy(*SESSION).count().where("count > 1").isEmpty():
        raise Invalid("a session may move once in a batch")
    old = store.table("checkpoints")
    rows = rows.withColumn("workflow_sha256", F.sha2("workflow", 256)).withColumn("checkpoint", _checkpoint_digest())
    if old is not None:
        light = old.select(*POINT, "tokens", "base_generation")
        heads = sessions.heads(light, SESSION).select(*SESSION, F.col("generation").alias("_g"), F.col("tokens").alias("_t"), F.col("base_generation").alias("_b"))
        if not rows.join(heads, SESSION).where(F.col("generation") <= F.col("_g")).isEmpty():
            raise Invalid("a session's generations only grow")
    described = F.transform("attention", lambda e: F.struct(e["layer"].alias("layer"), e["slot"].alias("slot"), e["format"].alias("format"), packed.layouts(e["buffers"]).alias("layouts"), F.sha2(packed.payload(e["buffers"]), 256).alias("payload_sha256")))
    if append:
        if old is None or not rows.join(heads, SESSION, "left_anti").isEmpty():
            raise Invalid("there is nothing to append to")
        # of the base no more is read than the kind of append needs
        base = old.where("kind = 'full'").select(*SESSION, F.col("generation").alias("_b"), *([F.col("tail").alias("_base")] if append == "state" else []), F.col("attention_described").alias("_old"))
        joined = rows.join(heads, SESSION).join(base, [*SESSION, "_b"])
        ok = sessions.extends(F.col("tokens"), F.col("_t"))
        if append == "state":
            ok = ok & (F.expr("substring(state, 1, octet_length(_base))") == F.col("_base"))
            tail = F.expr("substring(state, octet_length(_base) + 1, octet_length(state) - octet_length(_base))")
            joined = joined.withColumn("tail", tail).withColumn("plan", F.lit(None)).withColumn("tails", F.lit(None).cast("binary"))
        else:
            grown = packed.append_plan(F.col("_old"), F.col("attention"))
            joined = joined.withColumn("_p", grown).withColumn("plan", F.col("_p.plan")).withColumn("tails", F.col("_p.tails")).withColumn("tail", F.col("state"))
            ok = ok & F.col("_p.ok")
        if joined.count() != rows.count() or not joined.where(~F.coalesce(ok, F.lit(False))).isEmpty():
            raise Invalid("a checkpoint does not extend the one before it")
        if not joined.where(F.octet_length("tail" if append == "state" else "tails") > sessions.TAIL).isEmpty():
            raise Invalid("the tail is too long")
        new = joined.withColumn("base_generation", F.col("_b")).withColumn("kind", F.lit(append)).withColumn("attention_described", F.lit(None))
        new = new.withColumn("attention", F.lit(None).cast(packed.ATTENTION)) if append == "attention" else new
    else:
        new = rows.withColumn("base_generation", F.col("generation")).withColumn("kind", F.lit("full")).withColumn("tail", F.col("state"))
        new = new.withColumn("plan", F.lit(None)).withColumn("tails", F.lit(None).cast("binary")).withColumn("attention_described", described)
    entry = "layer:bigint,slot:string,format:string"
    new = new.withColumn("plan", F.col("plan").cast(f"array<struct<{entry},buffers:array<struct<name:string,dtype:string,shape:array<bigint>,base_len:bigint,tail_len:bigint>>>>"))
    new = new.withColumn("attention_described", F.col("attention_described").cast(f"array<struct<{entry},layouts:array<struct<name:string,dtype:string,shape:array<bigint>,length:bigint>>,payload_sha256:string>>"))
    new = new.withColumn("is_append", F.col("kind") != "full")
    columns = ["checkpoint", "base_generation", "kind", "is_append", "tokens", "tail", F.sha2("tail", 256).alias("tail_sha256"), "workflow", "workflow_sha256", "attention", "attention_described", "plan", "tails", F.sha2("tails", 256).alias("tails_sha256")]
    return store.append({"checkpoints": new.select(*POINT, *columns)})


def get_sessions(store: Reader, asked: DataFrame, full: bool = True) -> DataFrame:
    """The current state of the asked sessions: ``(session columns, generation, tokens, state, workflow, attention)``.

    A missing base, a changed workflow, another address than session, generation and tokens make and, if ``full``,
    changed bytes are corrupt.
    """
    every = store.table("checkpoints").join(asked.select(*SESSION).distinct(), SESSION, "left_semi")
    last = every.groupBy(*SESSION).agg(F.max("generation").alias("generation"))
    heads = every.join(last, POINT)
    base = every.where("kind = 'full'").select(*SESSION, F.col("generation").alias("base_generation"), F.col("tail").alias("_base"), F.col("attention").alias("_attention"), F.col("tokens").alias("_tokens"))
    whole = heads.join(base, [*SESSION, "base_generation"], "left")
    bad = F.col("_base").isNull() | (F.sha2("workflow", 256) != F.col("workflow_sha256")) | (_checkpoint_digest() != F.col("checkpoint"))
    bad = bad | (F.col("is_append") & ~sessions.extends(F.col("tokens"), F.col("_tokens")))
    grows = F.col("kind") == "attention"
    bad = bad | (grows & packed.plan_error(F.col("plan"), F.col("tails"), sessions.TAIL).isNotNull())
    if full:
        bad = bad | (F.sha2("tail", 256) != F.col("tail_sha256")) | (grows & (F.sha2("tails", 256) != F.col("tails_sha256")))
    attention = F.when(grows, packed.grown(F.col("_attention"), F.col("plan"), F.col("tails"))).otherwise(F.col("attention"))
    whole = whole.withColumn("_grown", attention)
    if not whole.where(F.coalesce(bad, F.lit(True)) | F.col("_grown").isNull()).isEmpty():
        raise Corrupt("a session lacks its base or its checkpoint changed")
    state = F.when(F.col("kind") == "state", F.concat("_base", "tail")).otherwise(F.col("tail"))
    return whole.select(*SESSION, "generation", "tokens", state.alias("state"), "workflow", F.col("_grown").alias("attention"))


def prune_checkpoints(store: Writer, asked: DataFrame) -> int:
    """Delete superseded generations ``(session columns, generation)``; heads and the bases they live on are refused.

    A checkpoint whose address is not the one that its session, generation and tokens make is corrupt and stays.
    """
    old = store.table("checkpoints")
    fine = sessions.prunable(old.select(*POINT, "is_append"), SESSION)
    own = old.select(*POINT, "tokens", "checkpoint").join(asked.select(*POINT).distinct(), POINT, "left_semi")
    if not own.join(fine, POINT, "left_anti").isEmpty():
        raise Invalid("a head or its base cannot go")
    if not own.where(_checkpoint_digest() != F.col("checkpoint")).isEmpty():
        raise Corrupt("a checkpoint has another address than its own")
    return store.remove(["checkpoints"], asked, POINT)


# experts --------------------------------------------------------------------------


def put_experts(store: Writer, rows: DataFrame) -> int:
    """Publish snapshots ``(fingerprint, format, layer, expert, bytes)`` together."""
    bad = (F.octet_length("fingerprint") != 32) | (F.hex("fingerprint") == "0" * 64) | ~F.octet_length("format").between(1, 256) | (F.octet_length("bytes") < 1)
    if not rows.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise Invalid("an expert snapshot needs a fingerprint, a format and bytes")
    named = _spread(rows, address.expert_address(F.col("fingerprint"), F.col("format"), F.col("layer"), F.col("expert")))
    return store.upsert("experts", named.select(*KEYS, "format", "expert", "bytes", F.sha2("bytes", 256).alias("sha256")))


def get_experts(store: Reader, asked: DataFrame, full: bool = True) -> DataFrame:
    """Asked snapshots ``(fingerprint, format, layer, expert)`` with their bytes; null where there is none."""
    named = _spread(asked, address.expert_address(F.col("fingerprint"), F.col("format"), F.col("layer"), F.col("expert")))
    out = named.join(store.table("experts").select(*KEYS, "bytes", "sha256"), KEYS, "left")
    if full and not out.where(F.sha2("bytes", 256) != F.col("sha256")).isEmpty():
        raise Corrupt("an expert's bytes are not the ones published")
    return out.select("fingerprint", "format", "layer", "expert", "bytes")


def remove_experts(store: Writer, asked: DataFrame) -> int:
    return store.remove(["experts"], _spread(asked, address.expert_address(F.col("fingerprint"), F.col("format"), F.col("layer"), F.col("expert"))))
