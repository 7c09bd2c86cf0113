"""Queries of addresses, records, prefixes, bundles, sessions and experts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address
from ..operators import bundles, packed, prefix, sessions
from ..sources import caches, store
from ..sources.scratch import new_folder
from ..sources.store import Reader, Writer
from ..streaming.sessions import heads_stream
from .catalogue import query, table

PAGE = 4096
JSON = """'{"namespace":"engine","model_fingerprint":"' || lang || '","prefix_fingerprint":"' || sha256(text) || '","layer":' || (doc_id % 32) || ',"slot":"key"}'"""


def addresses(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("engine").alias("namespace"), F.col("lang").alias("model_fingerprint"), F.sha2(F.encode("text", "UTF-8"), 256).alias("prefix_fingerprint"), (F.col("doc_id") % 32).alias("layer"), F.lit("key").alias("slot"))


@query(f"""WITH h AS (SELECT doc_id, sha256({JSON}) AS h FROM documents),
u AS (SELECT doc_id, CAST(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) AS UBIGINT) AS u FROM h)
SELECT doc_id, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT) & -2 AS key FROM u""")
def address_key(spark, sf_dir):
    return store.with_key(addresses(spark, sf_dir)).select("doc_id", "key")


def new_store(spark: SparkSession) -> str:
    return new_folder(spark, "store")


ADDRESS_SQL = "d.lang = r.lang AND d.text = r.text AND d.doc_id % 32 = r.doc_id % 32"


def _labelled_records(spark, sf_dir) -> tuple[Reader, DataFrame]:
    """A store with a record for each document that has labels, and all documents as requests."""
    every = addresses(spark, sf_dir)
    own = every.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").drop("doc_id").distinct()
    root = new_store(spark)
    with Writer(spark, root) as w:
        w.upsert("records", own.withColumn("payload", F.sha2("prefix_fingerprint", 256)))
    return Reader(spark, root), every


@query(f"SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents r JOIN labels USING (doc_id) WHERE {ADDRESS_SQL}) THEN sha256(sha256(text)) END AS payload FROM documents d")
def point_lookup(spark, sf_dir):
    reader, asked = _labelled_records(spark, sf_dir)
    return reader.lookup("records", asked).select("doc_id", "payload")


@query(f"SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents r JOIN labels USING (doc_id) WHERE {ADDRESS_SQL})")
def cache_miss(spark, sf_dir):
    reader, asked = _labelled_records(spark, sf_dir)
    return asked.join(reader.table("records").select(*address.FIELDS), list(address.FIELDS), "left_anti").select("doc_id")


def _user_states(spark, sf_dir) -> str:
    """A store with the last event of each user, after one batch for each month of events."""
    e = table(spark, sf_dir, "events").withColumn("month", F.date_trunc("month", "ts"))
    last = e.groupBy("month", "user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    identity = (F.lit("engine").alias("namespace"), F.lit("events").alias("model_fingerprint"), F.col("user_id").cast("string").alias("prefix_fingerprint"), F.lit(0).alias("layer"), F.lit("state").alias("slot"))
    root = new_store(spark)
    with Writer(spark, root) as w:
        for row in last.select("month").distinct().orderBy("month").limit(1000).collect():
            w.upsert("states", last.where(F.col("month") == F.lit(row["month"])).select(*identity, "user_id", "event_id", "event_type"))
    return root


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def upsert_last_state(spark, sf_dir):
    """Batches of records in order of arrival: the last one of each key stands."""
    return Reader(spark, _user_states(spark, sf_dir)).table("states").select("user_id", "event_id", "event_type")


@query("""WITH s AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT * FROM s WHERE event_type <> 'error'""")
def remove_state(spark, sf_dir):
    root = _user_states(spark, sf_dir)
    with Writer(spark, root) as w:
        w.remove(["states"], w.table("states").where("event_type = 'error'"))
    return Reader(spark, root).table("states").select("user_id", "event_id", "event_type")


def _short_keys(numbers: DataFrame) -> DataFrame:
    """Addresses of some numbers under keys that are shorter than those of the store, so that they collide."""
    a = numbers.select(F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.col("number").cast("string").alias("prefix_fingerprint"), F.lit(0).cast("bigint").alias("layer"), F.lit("s").alias("slot"), "number")
    return a.withColumn("key", F.col("number") * 7919 % 2003)


@query("""SELECT o_custkey * 7919 % 2003 AS key, CASE WHEN count(DISTINCT o_custkey) = 1 THEN 'Invalid' ELSE 'Collision' END AS error_class FROM orders GROUP BY 1 HAVING count(*) > 1""")
def batch_duplicates(spark, sf_dir):
    """What the store refuses a batch for: an address twice, or two addresses of one key."""
    return store.problems(_short_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"))))


@query("""SELECT DISTINCT s.s_suppkey * 7919 % 2003 AS key, 'Collision' AS error_class FROM supplier s JOIN customer c ON s.s_suppkey * 7919 % 2003 = c.c_custkey * 7919 % 2003 AND s.s_suppkey <> c.c_custkey
UNION SELECT s_suppkey * 7919 % 2003, 'Collision' FROM supplier GROUP BY 1 HAVING count(*) > 1""")
def collision_check(spark, sf_dir):
    """Keys of a batch that another record has, in the batch or in the store."""
    new = _short_keys(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number")))
    old = _short_keys(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number")))
    return store.problems(new, old).distinct()


def _words(text) -> DataFrame:
    """Words at single blanks as unsigned 32-bit ids."""
    return F.transform(F.split(text, " ", -1), lambda w: F.crc32(F.encode(w, "UTF-8")))


@query("SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents r JOIN labels USING (doc_id) WHERE r.text = d.text) THEN CAST(len(string_split(d.text, ' ')) AS INT) END AS n FROM documents d WHERE d.text IS NOT NULL")
def token_cache(spark, sf_dir):
    """The ids of the labelled documents' texts are cached; all texts are asked for."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    own = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("text").distinct()
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.put_token_ids(w, own.withColumn("ids", _words(F.col("text"))), "words/v1")
    return caches.get_token_ids(Reader(spark, root), d, "words/v1").select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"))


def _chain_sql() -> str:
    frame = lambda x: f"hex(encode({x}))"
    size = lambda x: f"lower(lpad(hex(octet_length(encode({x}))), 2, '0')) || '00000000000000'"
    seed = f"sha256(unhex({frame(repr(address.PREFIX_DOMAIN))} || {size(repr('engine'))} || {frame(repr('engine'))} || {size('c_mktsegment')} || {frame('c_mktsegment')} || {size(repr('ctx'))} || {frame(repr('ctx'))}))"
    le = " || ".join(f"lpad(hex((ord(substr(c_name, k + 1, 1)) >> {8 * b}) & 255), 2, '0')" for b in range(4))
    return f"""WITH RECURSIVE c AS (SELECT c_custkey, c_name, 0 AS k, {seed} AS d FROM customer UNION ALL SELECT c_custkey, c_name, k + 1, sha256(unhex(d || {le})) FROM c WHERE k < length(c_name))
SELECT c_custkey, d AS digest FROM c WHERE k = length(c_name)"""


@query(_chain_sql())
def prefix_digest(spark, sf_dir):
    """The chain over the code points of each customer's whole name."""
    c = table(spark, sf_dir, "customer")
    seed = address.prefix_seed(F.lit("engine"), F.col("c_mktsegment"), F.lit("ctx"))
    tokens = F.transform(F.sequence(F.lit(1), F.length("c_name")), lambda i: F.ascii(F.substring(F.col("c_name"), i, F.lit(1))).cast("bigint"))
    return c.select("c_custkey", F.element_at(address.chain_digests(seed, tokens), -1).alias("digest"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS n, true AS same FROM documents WHERE text IS NOT NULL")
def text_chain(spark, sf_dir):
    """The chain over the words of each whole text, by its halves: the second goes on where the first ends."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", _words(F.col("text")).alias("tokens"))
    seed = address.prefix_seed(F.lit("engine"), F.lit("m"), F.lit("ctx"))
    half = F.ceil(F.size("tokens") / 2).cast("int")
    d = d.withColumn("whole", prefix.digests_at(seed, F.col("tokens"), F.array(half, F.size("tokens"))))
    rest = F.slice("tokens", half + 1, F.size("tokens"))
    on = prefix.digests_at(F.element_at("whole", 1)["digest"], rest, F.array(F.size(rest)))
    end = F.when(F.size(rest) == 0, F.element_at("whole", 1)["digest"]).otherwise(F.element_at(on, 1)["digest"])
    return d.select("doc_id", F.size("tokens").alias("n"), (end == F.element_at("whole", -1)["digest"]).alias("same"))


def _so_far(spark, sf_dir) -> DataFrame:
    """Each turn's whole conversation up to it, as words."""
    c = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("conv_id", "turn", "role", F.array_join(F.collect_list("text").over(before), " ").alias("state")).withColumn("tokens", _words(F.col("state")))


SO_FAR = """c AS (SELECT conv_id, turn, role, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM conversations),
w AS (SELECT *, string_split(state, ' ') AS words FROM c), p AS (SELECT DISTINCT words FROM w WHERE role = 'assistant')"""


def _prepared(spark, sf_dir) -> str:
    """A store with every conversation up to each answer."""
    own = _so_far(spark, sf_dir).where("role = 'assistant'").groupBy("tokens").agg(F.min("state").alias("state"))
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.publish_prefixes(w, own.select(F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.lit("ctx").alias("context"), "tokens", F.lit("text").alias("state_format"), F.encode("state", "UTF-8").alias("state")))
    return root


def _requests(spark, sf_dir, context: str) -> DataFrame:
    number = F.col("conv_id") * 1000 + F.col("turn")
    return _so_far(spark, sf_dir).select(number.alias("request_id"), F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.lit(context).alias("context"), "tokens")


@query(f"WITH {SO_FAR} SELECT conv_id * 1000 + turn AS request_id, CAST(max(len(p.words)) AS INT) AS prefix_tokens FROM w JOIN p ON len(p.words) <= len(w.words) AND w.words[1 : len(p.words)] = p.words GROUP BY 1")
def longest_prefix_hit(spark, sf_dir):
    """For each turn the longest conversation up to an answer that its own begins with: metadata only."""
    return caches.find_longest(Reader(spark, _prepared(spark, sf_dir)), _requests(spark, sf_dir, "ctx")).select("request_id", "prefix_tokens")


@query(f"WITH {SO_FAR}, h AS (SELECT conv_id * 1000 + turn AS request_id, max(len(p.words)) AS n, any_value(w.words) AS words FROM w JOIN p ON len(p.words) <= len(w.words) AND w.words[1 : len(p.words)] = p.words GROUP BY 1) SELECT request_id, CAST(n AS INT) AS prefix_tokens, sha256(array_to_string(words[1 : n], ' ')) AS state_sha256 FROM h")
def longest_prefix_read(spark, sf_dir):
    """The same with the states that are stored for the hits."""
    found = caches.read_longest(Reader(spark, _prepared(spark, sf_dir)), _requests(spark, sf_dir, "ctx"), "text")
    return found.select("request_id", "prefix_tokens", F.sha2("state", 256).alias("state_sha256"))


@query("SELECT role, CAST(0 AS BIGINT) AS hits FROM conversations GROUP BY 1")
def prefix_scope_isolation(spark, sf_dir):
    """The same requests in a context that nothing was published for."""
    hits = caches.find_longest(Reader(spark, _prepared(spark, sf_dir)), _requests(spark, sf_dir, "another context"))
    asked = table(spark, sf_dir, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"))
    return asked.join(hits.select("request_id", "prefix_tokens"), "request_id", "left").groupBy("role").agg(F.count("prefix_tokens").alias("hits"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, sha256(coalesce(lang, '')) AS lang_sha, CAST(2 AS INT) AS buffers FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 0 AND octet_length(encode(coalesce(lang, ''))) > 0")
def packed_roundtrip(spark, sf_dir):
    """A record of two buffers for each document, written and read with full verification."""
    d = table(spark, sf_dir, "documents").where("octet_length(text) > 0 and octet_length(lang) > 0")

    def buffer(name: str, column: str):
        data = F.encode(column, "UTF-8")
        return F.struct(F.lit(name).alias("name"), F.lit("u8").alias("dtype"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("bytes"))

    rows = d.select("doc_id", F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.col("doc_id").cast("string").alias("prefix_fingerprint"), F.lit(0).cast("bigint").alias("layer"), F.lit("text").alias("slot"), F.lit("f").alias("format"), F.array(buffer("text", "text"), buffer("lang", "lang")).alias("buffers"))
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.put_packed(w, rows)
    found = caches.get_packed(Reader(spark, root), rows, "f")
    sha = lambda i: F.sha2(F.col("buffers")[i]["bytes"], 256)
    return found.select(F.col("prefix_fingerprint").cast("bigint").alias("doc_id"), sha(0).alias("text_sha"), sha(1).alias("lang_sha"), F.size("buffers").alias("buffers"))


@query("""WITH b AS (SELECT s_suppkey, hex(encode(s_name)) AS h, octet_length(encode(s_name)) AS n FROM supplier),
o AS (SELECT s_suppkey, n, i * 8 + k AS o FROM b, range(0, 64) r(i), range(0, 8) q(k) WHERE i < n AND (CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) >> k) & 1 = 1 UNION ALL SELECT s_suppkey, n, 8 * n FROM b),
l AS (SELECT *, lag(o) OVER (PARTITION BY s_suppkey ORDER BY o) AS before FROM o),
z AS (SELECT s_suppkey, any_value(n) AS n, count(*) AS card, count(*) FILTER (before IS NULL OR o - before <> 1) AS runs FROM l GROUP BY 1)
SELECT s_suppkey, CAST(n AS BIGINT) AS packed_bytes, CAST(12 + CASE WHEN 2 + 4 * runs < 2 * card THEN 11 + 4 * runs ELSE 16 + 2 * card END AS BIGINT) AS payload_roaring_bytes FROM z""")
def packed_estimate(spark, sf_dir):
    """Exact sizes of records that are not written."""
    data = F.encode("s_name", "UTF-8")
    buffer = F.struct(F.lit("name").alias("name"), F.lit("u8").alias("dtype"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("bytes"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("f").alias("format"), F.array(buffer).alias("buffers"))
    return packed.estimated(rows, ["s_suppkey"]).select("s_suppkey", "packed_bytes", "payload_roaring_bytes")


@query("SELECT page_id, sha256(html) AS state_sha, sha256(url) AS key_sha, CAST(octet_length(encode(html)) AS INT) AS n FROM pages WHERE octet_length(encode(html)) > 0 AND octet_length(encode(url)) > 0")
def bundle_roundtrip(spark, sf_dir):
    """A bundle with attention for each page, published and read whole with full verification."""
    p = table(spark, sf_dir, "pages").where("octet_length(html) > 0 and octet_length(url) > 0")
    data = F.encode("url", "UTF-8")
    buffer = F.struct(F.lit("k").alias("name"), F.lit("u8").alias("dtype"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("bytes"))
    entry = F.struct(F.lit(0).cast("bigint").alias("layer"), F.lit("key").alias("slot"), F.lit("f").alias("format"), F.array(buffer).alias("buffers"))
    identity = (F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.col("page_id").cast("string").alias("prefix_fingerprint"), F.lit(0).cast("bigint").alias("layer"), F.lit("bundle").alias("slot"))
    rows = p.select(*identity, F.array(F.col("page_id").cast("bigint")).alias("tokens"), F.lit("html").alias("state_format"), F.encode("html", "UTF-8").alias("state"), F.array(entry).alias("attention"))
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.put_bundles(w, rows, PAGE)
    found = caches.get_bundles(Reader(spark, root), rows, True, "html", PAGE)
    return found.select(F.col("tokens")[0].alias("page_id"), F.sha2("state", 256).alias("state_sha"), F.sha2(F.col("attention")[0]["buffers"][0]["bytes"], 256).alias("key_sha"), F.octet_length("state").alias("n"))


def _session_rows(spark, sf_dir, last: bool) -> DataFrame:
    """The first or the last checkpoint of each conversation: the state is the text so far, attention too."""
    c = _so_far(spark, sf_dir)
    edge = c.groupBy("conv_id").agg((F.max("turn") if last else F.min("turn")).alias("turn"))
    data = F.encode("state", "UTF-8")
    buffer = F.struct(F.lit("k").alias("name"), F.lit("u8").alias("dtype"), F.array(F.octet_length(data).cast("bigint")).alias("shape"), data.alias("bytes"))
    entry = F.struct(F.lit(0).cast("bigint").alias("layer"), F.lit("key").alias("slot"), F.lit("f").alias("format"), F.array(buffer).alias("buffers"))
    return c.join(edge, ["conv_id", "turn"]).select(F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("bigint").alias("generation"), "tokens", data.alias("state"), F.encode("role", "UTF-8").alias("workflow"), F.array(entry).alias("attention"))


@query(f"WITH {SO_FAR} SELECT conv_id, max(turn) + 1 AS generation, sha256(arg_max(state, turn)) AS state_sha, sha256(arg_max(state, turn)) AS key_sha FROM c GROUP BY 1")
def session_roundtrip(spark, sf_dir):
    """Sessions published at their first turn and moved to the last by what attention has beyond that, then read."""
    first, last = _session_rows(spark, sf_dir, False), _session_rows(spark, sf_dir, True)
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.put_checkpoints(w, first)
        moved = last.join(first.select(*caches.POINT), caches.POINT, "left_anti")
        caches.put_checkpoints(w, moved, append="attention")
    found = caches.get_sessions(Reader(spark, root), first)
    return found.select(F.col("session_id").cast("bigint").alias("conv_id"), "generation", F.sha2("state", 256).alias("state_sha"), F.sha2(F.col("attention")[0]["buffers"][0]["bytes"], 256).alias("key_sha"))


PAGES = f"""b AS (SELECT page_id, encode(html) AS data, octet_length(encode(html)) AS n FROM pages),
s AS (SELECT page_id, n, data, CAST(i AS INT) AS page_no, array_slice(data, i * {PAGE} + 1, least(n, (i + 1) * {PAGE})) AS part FROM b, range(0, 4096) r(i) WHERE i * {PAGE} < n)"""


def _pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("state"))


@query(f"WITH {PAGES} SELECT page_id, page_no, CAST(octet_length(part) AS INT) AS n, sha256(part) AS sha FROM s")
def state_pages(spark, sf_dir):
    return bundles.cut_pages(_pages(spark, sf_dir), ["page_id"], "state", PAGE).select("page_id", "page_no", F.octet_length("bytes").alias("n"), F.sha2("bytes", 256).alias("sha"))


LOST = "l AS (SELECT page_id, max(page_no) AS last FROM s GROUP BY 1), u AS (SELECT page_id FROM pages WHERE url LIKE '%?%')"


def _with_holes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """States and their pages, of which those with a query in their URL have lost the last one."""
    state = _pages(spark, sf_dir).where(F.octet_length("state") > 0)
    asked = table(spark, sf_dir, "pages").where("url like '%?%'").select("page_id", F.lit(True).alias("asked"))
    pages = bundles.cut_pages(state.withColumn("last", F.ceil(F.octet_length("state") / PAGE) - 1), ["page_id", "last"], "state", PAGE).join(asked, "page_id", "left")
    return state, pages.where("asked is null or page_no != last").drop("asked", "last")


@query(f"WITH {PAGES}, {LOST} SELECT page_id, last AS page_no FROM l JOIN u USING (page_id)")
def bundle_completeness(spark, sf_dir):
    """Pages that a store with holes lacks."""
    state, there = _with_holes(spark, sf_dir)
    headers = state.select("page_id", F.octet_length("state").alias("state_bytes"))
    return bundles.missing_pages(headers, there, ["page_id"], PAGE).select("page_id", "page_no")


@query(f"WITH {PAGES}, {LOST} SELECT page_id, page_id NOT IN (SELECT page_id FROM u) AS ok FROM l")
def bundle_checksum(spark, sf_dir):
    state, there = _with_holes(spark, sf_dir)
    headers = state.select("page_id", bundles.page_digests(F.col("state"), PAGE).alias("page_sha256"))
    return bundles.verified(headers, there, ["page_id"])


def _checkpoints(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("generation"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.encode(F.array_join(F.collect_list("text").over(order), "\n"), "UTF-8")
    return c.withColumn("state", state).withColumn("is_append", (F.col("generation") - 1) % 4 != 0)


STATES = """c AS (SELECT conv_id, turn + 1 AS generation, role, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM conversations),
b AS (SELECT *, ((generation - 1) // 4) * 4 + 1 AS base_generation FROM c)"""


@query("SELECT conv_id, max(turn) + 1 AS generation, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def session_head(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("generation"), "role")
    return sessions.heads(c, ["conv_id"]).select("conv_id", "generation", "role")


@query(f"WITH {STATES} SELECT a.conv_id, a.generation, a.state LIKE '%' AND substr(a.state, 1, length(p.state)) = p.state AND length(a.state) > length(p.state) AS ok FROM b a JOIN b p ON a.conv_id = p.conv_id AND a.generation = p.generation + 1")
def append_extends(spark, sf_dir):
    c = _checkpoints(spark, sf_dir)
    before = F.lag("state").over(Window.partitionBy("conv_id").orderBy("generation"))
    rows = c.withColumn("before", before).where("before is not null")
    same = F.expr("substring(state, 1, octet_length(before))") == F.col("before")
    return rows.select("conv_id", "generation", (same & (F.octet_length("state") > F.octet_length("before"))).alias("ok"))


@query(f"WITH {STATES} SELECT a.conv_id, a.generation, a.base_generation, CAST(octet_length(encode(a.state)) - octet_length(encode(p.state)) AS INT) AS tail_bytes FROM b a JOIN b p ON a.conv_id = p.conv_id AND a.base_generation = p.generation")
def append_tail_bytes(spark, sf_dir):
    d = sessions.deltas(_checkpoints(spark, sf_dir), ["conv_id"], "state")
    return d.where("ok").select("conv_id", "generation", "base_generation", F.octet_length("tail").alias("tail_bytes"))


@query(f"WITH {STATES} SELECT conv_id, generation, sha256(state) AS digest FROM b")
def append_restore(spark, sf_dir):
    c = _checkpoints(spark, sf_dir)
    tails = sessions.deltas(c, ["conv_id"], "state")
    return sessions.restored(c.where("not is_append"), tails, ["conv_id"], "state").select("conv_id", "generation", F.sha2("state", 256).alias("digest"))


@query(f"""WITH {STATES}, h AS (SELECT conv_id, max(generation) AS head, arg_max(base_generation, generation) AS live FROM b GROUP BY 1)
SELECT conv_id, generation FROM b JOIN h USING (conv_id) WHERE generation <> head AND generation <> live""")
def prunable_generations(spark, sf_dir):
    return sessions.prunable(_checkpoints(spark, sf_dir), ["conv_id"])


@query("SELECT conv_id, max(turn) + 1 AS generation, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def session_stream_head(spark, sf_dir):
    """The heads by a stream over the table's files, run until all is read; each batch's heads are written to the shared folder."""
    kind, out = table(spark, sf_dir, "conversations").schema, new_folder(spark, "heads")
    stream = spark.readStream.schema(kind).parquet(f"{sf_dir}/conversation[s].parquet").select("conv_id", (F.col("turn") + 1).alias("generation"), "role")
    write = lambda heads, batch: heads.write.mode("overwrite").parquet(f"{out}/heads")
    run = heads_stream(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/heads")


@query("""SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS layer, p_partkey AS expert, sha256(p_name) AS digest FROM part WHERE p_type = (SELECT min(p_type) FROM part)""")
def expert_selective(spark, sf_dir):
    """All parts are published as experts, those of one kind are read."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.unhex(F.sha2("p_type", 256)).alias("fingerprint"), F.lit("name").alias("format"), F.regexp_replace("p_brand", "Brand#", "").cast("bigint").alias("layer"), F.col("p_partkey").alias("expert"), F.encode("p_name", "UTF-8").alias("bytes"), "p_type")
    root = new_store(spark)
    with Writer(spark, root) as w:
        caches.put_experts(w, rows.drop("p_type"))
    least = p.agg(F.min("p_type").alias("p_type"))
    found = caches.get_experts(Reader(spark, root), rows.join(F.broadcast(least), "p_type", "left_semi").drop("p_type", "bytes"))
    return found.select("layer", "expert", F.sha2("bytes", 256).alias("digest"))
