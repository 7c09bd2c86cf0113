"""Queries of the tile codec over ``embeddings``: one tile of tokens by 64 channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import bf16_exact, float_bits
from ..operators import affine, bitset, compact, tensor
from ..sources import tiles
from ..sources.scratch import new_folder
from ..sources.store import Reader, Writer
from .catalogue import query, table

CELLS = "t AS (SELECT vec_id, CAST(i - 1 AS INT) AS channel, embedding[i] AS v FROM embeddings, range(1, 65) r(i))"


def channel_groups(spark, sf_dir, size: int = 32) -> DataFrame:
    """Groups along the channels of each token; slices of the stored array, so without a shuffle."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return e.select(F.col("vec_id").alias("tile_id"), "label", F.explode(F.sequence(F.lit(0), F.lit(64 // size - 1))).alias("grp"), "embedding").withColumn("values", F.slice("embedding", F.col("grp") * size + 1, size)).drop("embedding")


def token_tile(spark, sf_dir) -> DataFrame:
    """The tile in long form; ids count the tokens from 0 on."""
    e = table(spark, sf_dir, "embeddings")
    shape = F.array(e.agg(F.count("*").cast("int")).scalar(), F.lit(64))
    rows = e.select(F.lit("tile").alias("tile_id"), shape.alias("shape"), F.array(F.lit("token"), F.lit("channel")).alias("axes"), "vec_id", F.posexplode("embedding").alias("channel", "v"))
    return rows.select("tile_id", "shape", "axes", (F.col("vec_id") * 64 + F.col("channel")).alias("idx"), "v")


def affine_sql(bits: int, outputs: str, size: int = 32) -> str:
    top = (1 << bits) - 1
    return f"""WITH {CELLS},
g AS (SELECT vec_id, channel // {size} AS grp, channel, CAST(v AS DOUBLE) AS v FROM t),
p AS (SELECT vec_id, grp, min(v) AS mn, max(v) AS mx, (max(v) - min(v)) / {top}.0e0 AS step FROM g GROUP BY 1, 2),
c AS (SELECT g.*, mn, step, CASE WHEN step = 0 THEN 0 ELSE CAST(round((v - mn) / step) AS INT) END AS code FROM g JOIN p USING (vec_id, grp)),
d AS (SELECT *, CAST(CAST(mn + step * code AS FLOAT) AS DOUBLE) AS back FROM c)
{outputs}"""


@query(affine_sql(4, "SELECT vec_id, CAST(grp AS INT) AS grp, CAST(sum(code) AS BIGINT) AS code_sum, max(abs(v - back)) AS max_err, CAST(sum(bit_count(code)) AS BIGINT) AS ones FROM d GROUP BY vec_id, grp"))
def affine4_report(spark, sf_dir):
    g = affine.with_quantised(channel_groups(spark, sf_dir), "values", 4, 0)
    g = g.withColumn("back", affine.decoded(F.col("q"), F.col("values")))
    total = lambda f: F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda s, c: s + f(c))
    return g.select(F.col("tile_id").alias("vec_id"), "grp", total(lambda c: c).alias("code_sum"), affine.largest_error(F.col("back"), F.col("values")).alias("max_err"), total(F.bit_count).alias("ones"))


def _fixed(bits: int):
    sql = affine_sql(bits, "SELECT vec_id, CAST(grp AS INT) AS grp, CAST(sum(code) AS BIGINT) AS code_sum, max(abs(v - back)) AS max_err FROM d GROUP BY vec_id, grp")

    @query(sql, name=f"affine_fixed_{bits}")
    def fixed(spark, sf_dir):
        g = affine.with_quantised(channel_groups(spark, sf_dir), "values", bits, 0)
        back = affine.decoded(F.col("q"), F.col("values"))
        return g.select(F.col("tile_id").alias("vec_id"), "grp", F.aggregate("q.codes", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("code_sum"), affine.largest_error(back, F.col("values")).alias("max_err"))


for _b in (2, 4, 8):
    _fixed(_b)


@query(f"WITH {CELLS} SELECT vec_id AS token, channel, CAST(v AS DOUBLE) AS v FROM t")
def tile_long(spark, sf_dir):
    return token_tile(spark, sf_dir).select(F.expr("idx div 64").alias("token"), (F.col("idx") % 64).cast("int").alias("channel"), F.col("v").cast("double").alias("v"))


@query(f"""WITH {CELLS}, n AS (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS blocks FROM embeddings)
SELECT channel * blocks + vec_id // 32 AS group_id, count(*) AS n, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM t, n GROUP BY 1""")
def groups_token_axis(spark, sf_dir):
    g = tensor.with_groups(token_tile(spark, sf_dir), "token", 32)
    return g.groupBy(F.col("grp").alias("group_id")).agg(F.count("*").alias("n"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))


@query(f"WITH {CELLS} SELECT vec_id * 2 + channel // 32 AS group_id, count(*) AS n, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high FROM t GROUP BY 1")
def groups_channel_axis(spark, sf_dir):
    g = tensor.with_groups(token_tile(spark, sf_dir), "channel", 32)
    return g.groupBy(F.col("grp").alias("group_id")).agg(F.count("*").alias("n"), F.min("v").cast("double").alias("low"), F.max("v").cast("double").alias("high"))


@query(f"""WITH {CELLS}, s AS (SELECT vec_id, list_sort(list(CAST(v AS DOUBLE))) AS o FROM t GROUP BY 1)
SELECT t.vec_id, CAST(count(*) FILTER (v < o[4] OR v > o[61]) AS INT) AS exceptions, CAST(min(channel) FILTER (v < o[4] OR v > o[61]) AS INT) AS first_position FROM t JOIN s USING (vec_id) GROUP BY 1""")
def affine_trim_exceptions(spark, sf_dir):
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 4, 3)
    place = F.array_position("q.kept", True).cast("int") - 1
    return g.select(F.col("tile_id").alias("vec_id"), affine.exceptions(F.col("q")).alias("exceptions"), F.when(place >= 0, place).alias("first_position"))


@query(f"""WITH {CELLS}, n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT CAST(ceil(n / 32.0) AS BIGINT) AS blocks, n FROM n)
SELECT channel * blocks + vec_id // 32 AS group_id, bool_or(vec_id >= n - 16) AS is_raw FROM t, b GROUP BY 1""")
def tail_groups_raw(spark, sf_dir):
    g = tensor.with_groups(token_tile(spark, sf_dir), "token", 32)
    return g.groupBy(F.col("grp").alias("group_id")).agg(F.bool_or(F.col("along") >= F.col("width") - 16).alias("is_raw"))


def trials_sql(error: float, outputs: str) -> str:
    """Every trial as exploded rows: codes, exceptions, bit ordinals and portable sizes (raw groups have no SQL)."""
    return f"""WITH {CELLS},
g AS (SELECT vec_id, channel // 32 AS grp, channel % 32 AS i, v AS f, CAST(v AS DOUBLE) AS v FROM t),
s AS (SELECT vec_id, grp, list_sort(list(v)) AS o FROM g GROUP BY 1, 2),
p AS (SELECT vec_id, grp, bits, trim, o[trim + 1] AS mn, o[32 - trim] AS mx, (o[32 - trim] - o[trim + 1]) / ((1 << bits) - 1) AS step FROM s, (VALUES (2), (4), (8)) b(bits), (VALUES (0), (1)) k(trim)),
c AS (SELECT p.*, g.i, g.f, g.v, g.v < mn OR g.v > mx AS kept, CASE WHEN g.v < mn OR g.v > mx OR step = 0 THEN 0 ELSE CAST(round((g.v - mn) / step) AS INT) END AS code FROM g JOIN p USING (vec_id, grp)),
e AS (SELECT vec_id, grp, bits, trim, CAST(count(*) FILTER (kept) AS INT) AS exceptions, max(CASE WHEN kept THEN 0 ELSE abs(v - CAST(CAST(mn + step * code AS FLOAT) AS DOUBLE)) END) AS max_err FROM c GROUP BY 1, 2, 3, 4)
{outputs.format(error=error)}"""


@query(trials_sql(0.02, "SELECT vec_id, CAST(grp AS INT) AS grp, bits, trim, exceptions, max_err, max_err <= {error} AS ok FROM e"))
def acceptable_candidates(spark, sf_dir):
    g = channel_groups(spark, sf_dir).withColumn("raw", F.lit(False))
    t = affine.trials(g, affine.Policy("channel", 32, (2, 4, 8), 0.02, 0.05), with_raw=False)
    return t.select(F.col("tile_id").alias("vec_id"), "grp", "bits", (F.col("trial") % 2).alias("trim"), "exceptions", "max_err", "ok")


def _chosen(spark, sf_dir) -> DataFrame:
    g = channel_groups(spark, sf_dir).withColumn("raw", F.lit(False))
    return affine.encode(g, affine.Policy("channel", 32, (2, 4, 8), 0.02, 0.0))


BEST = """, x AS (SELECT vec_id, grp, bits, (b * 32 + i) AS ordinal FROM c, range(0, 8) r(b) WHERE trim = 0 AND b < bits AND (code >> b) & 1 = 1),
l AS (SELECT *, lag(ordinal) OVER (PARTITION BY vec_id, grp, bits ORDER BY ordinal) AS before FROM x),
z AS (SELECT vec_id, grp, bits, count(*) AS card, count(*) FILTER (before IS NULL OR ordinal - before <> 1) AS runs FROM l GROUP BY 1, 2, 3),
k AS (SELECT vec_id, grp, bits, 29 + 8 + 4 + CASE WHEN 2 + 4 * runs < 2 * card THEN 4 + 1 + 4 + 2 + 4 * runs ELSE 16 + 2 * card END AS cost FROM z),
q AS (SELECT *, abs(v) AS m, CAST(floor(log2(abs(v))) AS INT) AS guess FROM g), w AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN pow(2.0, guess) > m THEN guess - 1 WHEN pow(2.0, guess + 1) <= m THEN guess + 1 ELSE guess END AS ex FROM q),
rb AS (SELECT vec_id, grp, i, CASE WHEN m = 0 THEN 0 ELSE (CASE WHEN v < 0 THEN 2147483648 ELSE 0 END) + CAST((ex + 127) AS BIGINT) * 8388608 + CAST((m / pow(2.0, ex) - 1) * 8388608 AS BIGINT) END AS word FROM w),
rx AS (SELECT vec_id, grp, b * 32 + i AS ordinal FROM rb, range(0, 32) r(b) WHERE (word >> b) & 1 = 1),
rl AS (SELECT *, lag(ordinal) OVER (PARTITION BY vec_id, grp ORDER BY ordinal) AS before FROM rx),
rz AS (SELECT vec_id, grp, count(*) AS card, count(*) FILTER (before IS NULL OR ordinal - before <> 1) AS runs FROM rl GROUP BY 1, 2),
a AS (SELECT e.vec_id, e.grp, e.bits, k.cost FROM e JOIN k ON e.vec_id = k.vec_id AND e.grp = k.grp AND e.bits = k.bits WHERE e.trim = 0 AND max_err <= {error}
UNION ALL SELECT vec_id, grp, 32, 29 + 8 + 4 + CASE WHEN 2 + 4 * runs < 2 * card THEN 11 + 4 * runs ELSE 16 + 2 * card END FROM rz),
h AS (SELECT *, row_number() OVER (PARTITION BY vec_id, grp ORDER BY cost, bits) AS nth FROM a)
{{outputs}}"""


def best_sql(outputs: str) -> str:
    """The cheapest acceptable trial of each group, raw words among them, as ``h`` with ``nth`` of 1."""
    return trials_sql(0.02, "SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + BEST.format(error=0.02).replace("{outputs}", outputs)




@query(best_sql("SELECT vec_id, CAST(grp AS INT) AS grp, bits, CAST(cost AS BIGINT) AS cost FROM h WHERE nth = 1"))
def affine_choose_best(spark, sf_dir):
    """The cheapest trial, the raw words among them."""
    g = channel_groups(spark, sf_dir).withColumn("raw", F.lit(False))
    t = affine.trials(g, affine.Policy("channel", 32, (2, 4, 8), 0.02, 0.0), best_only=True)
    return t.select(F.col("tile_id").alias("vec_id"), "grp", "bits", "cost")


@query(best_sql("SELECT bits, count(*) AS groups, CAST(CASE WHEN bits = 32 THEN 32 * count(*) ELSE 0 END AS BIGINT) AS raw_values, CAST(0 AS BIGINT) AS exceptions FROM h WHERE nth = 1 GROUP BY bits"))
def groups_by_bits(spark, sf_dir):
    c = _chosen(spark, sf_dir)
    return c.groupBy("bits").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("bits") == 32, F.size("values")).otherwise(0)).alias("raw_values"), F.sum("exceptions").alias("exceptions"))


@query(best_sql(""", sq AS (SELECT vec_id, grp, bits, sum(pow(v - CAST(CAST(mn + step * code AS FLOAT) AS DOUBLE), 2)) AS sse FROM c WHERE trim = 0 GROUP BY 1, 2, 3),
fin AS (SELECT h.vec_id, h.bits, coalesce(e.max_err, 0) AS max_err, coalesce(sq.sse, 0) AS sse FROM h LEFT JOIN e ON h.vec_id = e.vec_id AND h.grp = e.grp AND h.bits = e.bits AND e.trim = 0 LEFT JOIN sq ON h.vec_id = sq.vec_id AND h.grp = sq.grp AND h.bits = sq.bits WHERE nth = 1)
SELECT vec_id AS tile_id, CAST(sum(32 * bits) AS BIGINT) AS span_bits, CAST(sum(32 * bits) / 8 AS BIGINT) AS packed_bytes, CAST(0 AS BIGINT) AS exceptions, CAST(sum(CASE WHEN bits = 32 THEN 32 ELSE 0 END) AS BIGINT) AS raw_values, max(max_err) AS max_err, round(sqrt(sum(sse) / 64), 6) AS rmse FROM fin GROUP BY 1"""))
def encode_report(spark, sf_dir):
    r = affine.report(_chosen(spark, sf_dir))
    return r.select("tile_id", "span_bits", "packed_bytes", "exceptions", "raw_values", "max_err", F.round("rmse", 6).alias("rmse"))


@query("SELECT vec_id, CAST(0 AS BIGINT) AS mismatches FROM embeddings")
def decode_roundtrip(spark, sf_dir):
    """Codes rebuilt from their bit ordinals are the codes that were scattered."""
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 8, 0).withColumn("codes", F.col("q.codes"))
    scattered = g.select("tile_id", F.explode(bitset.plane_ordinals(F.col("codes"), F.lit(8))).alias("ordinal"))
    rebuilt = scattered.groupBy("tile_id", (F.col("ordinal") % 64).cast("int").alias("i")).agg(F.sum(F.expr("shiftleft(1, cast(ordinal div 64 as int))")).alias("code"))
    wanted = g.select("tile_id", F.posexplode("codes").alias("i", "wanted"))
    both = wanted.join(rebuilt, ["tile_id", "i"], "left")
    return both.groupBy(F.col("tile_id").alias("vec_id")).agg(F.sum((F.coalesce("code", F.lit(0)) != F.col("wanted")).cast("bigint")).alias("mismatches"))


@query(affine_sql(4, "SELECT CAST(b AS INT) AS plane, CAST(count(*) FILTER ((code >> b) & 1 = 1) AS BIGINT) AS ones, count(*) AS total FROM d, range(0, 4) r(b) GROUP BY b"))
def bitplane_density(spark, sf_dir):
    g = affine.with_quantised(channel_groups(spark, sf_dir), "values", 4, 0).withColumn("codes", F.col("q.codes"))
    return bitset.plane_density(g, "codes", 4, [])


@query(affine_sql(4, """, x AS (SELECT vec_id, grp, b * 32 + channel % 32 AS ordinal FROM d, range(0, 4) r(b) WHERE (code >> b) & 1 = 1),
l AS (SELECT *, lag(ordinal) OVER (PARTITION BY vec_id, grp ORDER BY ordinal) AS before FROM x),
z AS (SELECT vec_id, grp, count(*) AS card, count(*) FILTER (before IS NULL OR ordinal - before <> 1) AS runs FROM l GROUP BY 1, 2)
SELECT vec_id, CAST(grp AS INT) AS grp, CAST(12 + CASE WHEN 2 + 4 * runs < 2 * card THEN 11 + 4 * runs ELSE 16 + 2 * card END AS BIGINT) AS bytes FROM z"""))
def roaring_size_by_group(spark, sf_dir):
    g = affine.with_quantised(channel_groups(spark, sf_dir), "values", 4, 0).withColumn("codes", F.col("q.codes"))
    return g.select(F.col("tile_id").alias("vec_id"), "grp", bitset.roaring_size(bitset.plane_ordinals(F.col("codes"), F.lit(4))).alias("bytes"))


@query(affine_sql(8, """, x AS (SELECT vec_id, b * 64 + channel AS ordinal FROM d, range(0, 8) r(b) WHERE (code >> b) & 1 = 1),
l AS (SELECT *, lag(ordinal) OVER (PARTITION BY vec_id ORDER BY ordinal) AS before FROM x),
z AS (SELECT vec_id, count(*) AS card, count(*) FILTER (before IS NULL OR ordinal - before <> 1) AS runs FROM l GROUP BY 1)
SELECT vec_id, CAST(12 + CASE WHEN 2 + 4 * runs < 2 * card THEN 11 + 4 * runs ELSE 16 + 2 * card END AS BIGINT) AS bytes FROM z""", 64))
def roaring_size_of_tiles(spark, sf_dir):
    """The same by rows, as for sets too large for an array."""
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 8, 0).withColumn("codes", F.col("q.codes"))
    rows = g.select(F.col("tile_id").alias("vec_id"), F.explode(bitset.plane_ordinals(F.col("codes"), F.lit(8))).alias("ordinal"))
    return bitset.roaring_size_of_rows(rows, ["vec_id"]).withColumn("bytes", F.col("bytes").cast("bigint"))


@query("""WITH b AS (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages),
o AS (SELECT page_id, CAST(sum(bit_count(CAST('0x' || substr(h, 2 * i + 1, 2) AS INT))) AS BIGINT) AS ones FROM b, LATERAL (SELECT unnest(range(0, n)) AS i) GROUP BY 1)
SELECT page_id, ones, CAST(8 * n AS BIGINT) AS sentinel, true AS same FROM b JOIN o USING (page_id)""")
def bytes_bit_roundtrip(spark, sf_dir):
    """Bits of each whole page, its end mark and whether the page comes back from them."""
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("data")).where(F.octet_length("data") > 0)
    return bitset.byte_round_trips(p, "page_id", "data")


def _lloyd_sql() -> str:
    steps = ["c0 AS (SELECT vec_id, CAST(min(v) AS DOUBLE) AS a, CAST(max(v) AS DOUBLE) AS b FROM t GROUP BY 1)"]
    for k in range(8):
        steps.append(f"""m{k} AS (SELECT t.vec_id, avg(CAST(v AS DOUBLE)) FILTER (v <= (a + b) / 2) AS x, avg(CAST(v AS DOUBLE)) FILTER (v > (a + b) / 2) AS y FROM t JOIN c{k} USING (vec_id) GROUP BY 1),
c{k + 1} AS (SELECT vec_id, CASE WHEN x IS NULL OR y IS NULL THEN a ELSE x END AS a, CASE WHEN x IS NULL OR y IS NULL THEN b ELSE y END AS b FROM c{k} JOIN m{k} USING (vec_id))""")
    return f"WITH {CELLS}, {', '.join(steps)} SELECT vec_id, round(a, 5) AS low, round(b, 5) AS high FROM c8"


@query(_lloyd_sql())
def compact_1bit(spark, sf_dir):
    c = compact.two_centroids(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", c.alias("c")).select("vec_id", F.round(F.col("c.low").cast("double"), 5).alias("low"), F.round(F.col("c.high").cast("double"), 5).alias("high"))


def _compact(bits: int):
    top = (1 << bits) - 1
    sql = f"""WITH {CELLS}, p AS (SELECT vec_id, CAST(min(v) AS DOUBLE) AS a, CAST(CAST((CAST(max(v) AS DOUBLE) - CAST(min(v) AS DOUBLE)) / {top}.0e0 AS FLOAT) AS DOUBLE) AS b FROM t GROUP BY 1)
SELECT vec_id, CAST(sum(CASE WHEN b = 0 THEN 0 ELSE least(greatest(round((CAST(v AS DOUBLE) - a) / b), 0), {top}) END) AS BIGINT) AS code_sum, CAST({64 * bits // 8} AS BIGINT) AS packed_bytes FROM t JOIN p USING (vec_id) GROUP BY 1"""

    @query(sql, name=f"compact_{bits}bit")
    def run(spark, sf_dir):
        g = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), F.lit(0).alias("grp"), F.col("embedding").alias("values"))
        e = compact.encode(g, compact.CompactPolicy("channel", bits, 0))
        return e.select(F.col("tile_id").alias("vec_id"), F.aggregate("codes", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("code_sum"), F.octet_length("packed").cast("bigint").alias("packed_bytes"))


for _b in (2, 4):
    _compact(_b)


@query(f"""WITH {CELLS}, m AS (SELECT vec_id, abs(CAST(v AS DOUBLE)) AS m FROM t), g AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE CAST(floor(log2(m)) AS INT) END AS guess FROM m),
x AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN pow(2.0, guess) > m THEN guess - 1 WHEN pow(2.0, guess + 1) <= m THEN guess + 1 ELSE guess END AS ex FROM g)
SELECT label, CASE WHEN bool_and(m = 0 OR CAST((m / pow(2.0, ex) - 1) * 8388608 AS BIGINT) % 65536 = 0) THEN 'bf16-le' ELSE 'f32-le' END AS dtype FROM x JOIN embeddings USING (vec_id) GROUP BY 1""")
def bf16_tail_eligible(spark, sf_dir):
    """For each label whether its vectors' floats are all brain floats."""
    e = table(spark, sf_dir, "embeddings").select("label", bf16_exact(float_bits("embedding")).alias("exact"))
    return e.groupBy("label").agg(F.when(F.bool_and("exact"), "bf16-le").otherwise("f32-le").alias("dtype"))


@query(affine_sql(4, """, x AS (SELECT label, b, sum((code >> b) & 1) / CAST(count(*) AS DOUBLE) AS density FROM d JOIN embeddings USING (vec_id), range(0, 4) r(b) GROUP BY 1, 2)
SELECT CAST(b AS INT) AS plane, round(min(density), 9) AS least, round(max(density), 9) AS most FROM x GROUP BY 1"""))
def density_by_layer(spark, sf_dir):
    """The least and the greatest share of ones of each plane among layers (here: labels)."""
    g = affine.with_quantised(channel_groups(spark, sf_dir), "values", 4, 0).withColumn("codes", F.col("q.codes"))
    each = bitset.plane_density(g, "codes", 4, ["label"]).withColumn("density", F.col("ones") / F.col("total"))
    return each.groupBy("plane").agg(F.round(F.min("density"), 9).alias("least"), F.round(F.max("density"), 9).alias("most"))


def _layout_sql(ordinal: str) -> str:
    return f"""SELECT vec_id, 12 + CASE WHEN 2 + 4 * count(*) FILTER (before IS NULL OR o - before <> 1) < 2 * count(*) THEN 11 + 4 * count(*) FILTER (before IS NULL OR o - before <> 1) ELSE 16 + 2 * count(*) END AS bytes
FROM (SELECT vec_id, {ordinal} AS o, lag({ordinal}) OVER (PARTITION BY vec_id ORDER BY {ordinal}) AS before FROM d, range(0, 8) r(b) WHERE (code >> b) & 1 = 1) GROUP BY 1"""


@query(affine_sql(8, f""", i AS ({_layout_sql("channel * 8 + b")}), t2 AS ({_layout_sql("b * 64 + channel")})
SELECT CAST(sum(i.bytes) AS BIGINT) AS interleaved, CAST(sum(t2.bytes) AS BIGINT) AS transposed, count(*) * 64 AS packed FROM i JOIN t2 USING (vec_id)""", 64))
def roaring_layouts(spark, sf_dir):
    """Bytes of all codes as sets of bits, value after value and plane after plane, against dense packing."""
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 8, 0).withColumn("codes", F.col("q.codes"))
    sizes = bitset.layout_sizes(g, "codes", 8)
    return sizes.agg(F.sum("interleaved").alias("interleaved"), F.sum("transposed").alias("transposed"), (F.count("*") * 64).alias("packed"))


@query("SELECT vec_id, CAST(64 AS INT) AS n, true AS bounded FROM embeddings")
def tile_roundtrip(spark, sf_dir):
    """Each vector as a tile, put with a bound and read through the strict decoder."""
    e = table(spark, sf_dir, "embeddings")
    identity = (F.lit("engine").alias("namespace"), F.lit("m").alias("model_fingerprint"), F.col("vec_id").cast("string").alias("prefix_fingerprint"), F.lit(0).cast("bigint").alias("layer"), F.lit("key").alias("slot"))
    rows = e.select(*identity, F.array(F.lit(1), F.lit(64)).alias("shape"), F.array(F.lit("token"), F.lit("channel")).alias("axes"), F.col("embedding").cast("array<float>").alias("values"))
    root = new_folder(spark, "store")
    with Writer(spark, root) as w:
        tiles.put_tiles(w, rows, affine.Policy("channel", 32, (2, 4, 8), 0.02, 0.05))
    found = tiles.get_tiles(Reader(spark, root), rows).select(F.col("prefix_fingerprint").cast("bigint").alias("vec_id"), F.col("values").alias("back"))
    both = found.join(e, "vec_id")
    return both.select("vec_id", F.size("back").alias("n"), (affine.largest_error(F.col("back"), F.col("embedding")) <= 0.02).alias("bounded"))
