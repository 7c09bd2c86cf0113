"""Queries of admission, the host tier, budgets and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..operators import admission, affine, allocation
from .catalogue import query, table
from .codec import affine_sql, channel_groups

COSTS = "c AS (SELECT event_id, value * 1.0e0 AS recompute, value * 0.75e0 AS publish, user_id % 4 AS hits, value * 0.5e0 + (user_id % 7) * 10.0e0 AS durable, value * 0.5e0 + (event_id % 5) * 15.0e0 AS host FROM events)"


def _costs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.col("value") * 0.5
    tiers = F.array(F.struct(F.lit("durable").alias("tier"), (half + (F.col("user_id") % 7) * 10.0).alias("ms")), F.struct(F.lit("host").alias("tier"), (half + (F.col("event_id") % 5) * 15.0).alias("ms")))
    return e.select("event_id", "user_id", "value", F.col("value").alias("recompute"), (F.col("value") * 0.75).alias("publish"), (F.col("user_id") % 4).alias("hits"), tiers.alias("tiers"))


@query(f"WITH {COSTS} SELECT event_id, CASE WHEN least(durable, host) >= recompute THEN 'recompute' WHEN durable <= host THEN 'durable' ELSE 'host' END AS choice FROM c")
def choose_hit(spark, sf_dir):
    return _costs(spark, sf_dir).select("event_id", F.coalesce(admission.choose_hit(F.col("tiers"), F.col("recompute"))["tier"], F.lit("recompute")).alias("choice"))


@query(f"WITH {COSTS} SELECT event_id, least(durable, host) < recompute AND hits * (recompute - least(durable, host)) > publish AS publish FROM c")
def should_publish(spark, sf_dir):
    return _costs(spark, sf_dir).select("event_id", admission.should_publish(F.col("tiers"), F.col("recompute"), F.col("publish"), F.col("hits")).alias("publish"))


@query("SELECT event_id, round((value - value * 0.25e0) * (user_id % 5) - 20.0e0, 6) AS net FROM events")
def host_net_saving(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    net = admission.net_saving(F.col("value"), F.col("value") * 0.25, F.col("user_id") % 5, F.lit(20.0))
    return e.select("event_id", F.round(net, 6).alias("net"))


@query()
def host_tier_trace(spark, sf_dir):
    """What stays resident after the whole trace, a tier for each of sixteen shards of users."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "invalidate").otherwise("offer")
    trace = e.select((F.col("user_id") % 16).cast("int").alias("tier"), "event_id", op.alias("op"), F.col("user_id").alias("key"), (F.col("event_id") % 97 + 1).alias("bytes"), (F.col("value") - 20).alias("saving"))
    return admission.replay(trace, "tier", ["event_id"], 512, 12)


def _choices(spark, sf_dir) -> DataFrame:
    """For each vector two, four and eight bits with their bytes and squared error; a pool for each label."""
    return affine.choices(channel_groups(spark, sf_dir, 64), "label").drop("packed_bytes")


def _greedy_sql(rounds: int = 4) -> str:
    """The purchases in rounds, each up to the first that does not fit; three options have no more than three sizes of a step."""
    errors = " UNION ALL ".join(f"SELECT * FROM ({affine_sql(b, f'SELECT vec_id, {b} AS bits, sum(pow(v - back, 2)) AS s FROM d GROUP BY vec_id', 64)})" for b in (2, 4, 8))
    steps = [
        f"x AS ({errors})",
        "i AS (SELECT label AS pool, vec_id AS item, max(s) FILTER (bits = 2) AS s0, max(s) FILTER (bits = 4) AS s1, max(s) FILTER (bits = 8) AS s2 FROM x JOIN embeddings USING (vec_id) GROUP BY 1, 2)",
        "t0 AS (SELECT *, 0 AS j FROM i)",
        "l0 AS (SELECT pool, count(*) * (69 - 45) AS l FROM i GROUP BY 1)",
    ]
    for r in range(rounds):
        steps += [
            f"f{r} AS (SELECT *, CASE WHEN j = 0 AND l >= 16 AND s0 > s1 AND (l < 48 OR s0 <= s2 OR (s0 - s1) / 16 >= (s0 - s2) / 48) THEN 1 WHEN j = 0 AND l >= 48 AND s0 > s2 THEN 2 WHEN j = 1 AND l >= 32 AND s1 > s2 THEN 2 END AS n FROM t{r} JOIN l{r} USING (pool))",
            f"g{r} AS (SELECT *, CASE WHEN j = 1 THEN 32 WHEN n = 1 THEN 16 ELSE 48 END AS e, CASE WHEN j = 1 THEN (s1 - s2) / 32 WHEN n = 1 THEN (s0 - s1) / 16 ELSE (s0 - s2) / 48 END AS gain FROM f{r} WHERE n IS NOT NULL)",
            f"m{r} AS (SELECT pool, item, l, 0 AS k, n, e, gain, e AS late FROM g{r} UNION ALL SELECT pool, item, l, 1, 2, 32, least(gain, (s1 - s2) / 32), CASE WHEN (s1 - s2) / 32 > gain THEN e ELSE 32 END FROM g{r} WHERE j = 0 AND n = 1 AND l >= 48 AND s1 > s2)",
            f"c{r} AS (SELECT *, sum(e) OVER w AS spent, row_number() OVER w AS nth FROM m{r} WINDOW w AS (PARTITION BY pool ORDER BY gain DESC, late, item, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
            f"b{r} AS (SELECT pool, min(nth) AS stop FROM c{r} WHERE spent > l GROUP BY 1)",
            f"d{r} AS (SELECT c{r}.* FROM c{r} LEFT JOIN b{r} USING (pool) WHERE stop IS NULL OR nth < stop)",
            f"p{r} AS (SELECT pool, item, max(n) AS n FROM d{r} GROUP BY 1, 2)",
            f"t{r + 1} AS (SELECT t.pool, t.item, s0, s1, s2, coalesce(n, j) AS j FROM t{r} t LEFT JOIN p{r} USING (pool, item))",
            f"l{r + 1} AS (SELECT pool, l - coalesce((SELECT sum(e) FROM d{r} WHERE d{r}.pool = l{r}.pool), 0) AS l FROM l{r})",
        ]
    return f"WITH {', '.join(steps)} SELECT pool, item, CAST(j AS INT) AS j FROM t{rounds}"


@query(_greedy_sql())
def budget_greedy(spark, sf_dir):
    """A budget of five bits a value in each pool."""
    c = _choices(spark, sf_dir)
    budget = c.groupBy("pool").agg((F.count_distinct("item") * 69).alias("budget"))
    return allocation.allocate(c.join(budget, "pool"), "pool", F.col("budget"))


@query("""WITH i AS (SELECT label AS pool, vec_id AS item, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
o AS (SELECT pool, item, n, row_number() OVER (PARTITION BY pool ORDER BY place * 73 % n, place) AS nth FROM i)
SELECT pool, item, CAST(CASE WHEN nth * 16 <= n * 8 THEN 1 ELSE 0 END AS INT) AS j FROM o""")
def dispersed_mix(spark, sf_dir):
    c = _choices(spark, sf_dir).where("j < 2")
    budget = c.groupBy("pool").agg((F.count_distinct("item") * 53).alias("budget"))
    return allocation.allocate(c.join(budget, "pool"), "pool", F.col("budget"), "dispersed")


def _mse_sql(bits: int) -> str:
    body = affine_sql(bits, f"SELECT vec_id, {bits} AS bits, avg(pow(v - back, 2)) AS mse FROM d GROUP BY vec_id", 64)
    return f"SELECT * FROM ({body})"


@query(f"""WITH m AS ({" UNION ALL ".join(_mse_sql(b) for b in (2, 4, 8))}), p AS (SELECT label, bits, avg(mse) AS mse FROM m JOIN embeddings USING (vec_id) GROUP BY 1, 2)
SELECT label, round(greatest(exp(-regr_slope(ln(greatest(mse, 1e-30)), bits)), 1.000001), 6) AS beta FROM p GROUP BY 1""")
def rate_fit_beta(spark, sf_dir):
    mse = _choices(spark, sf_dir).groupBy(F.col("pool").alias("label"), "bits").agg(F.avg(F.col("score") / 64).alias("mse"))
    return allocation.beta_of(mse, ["label"]).select("label", F.round("beta", 6).alias("beta"))


LOGITS = """, a AS (SELECT vec_id, max(v) AS pm, max(back) AS qm FROM d GROUP BY 1),
z AS (SELECT vec_id, pm + ln(sum(exp(v - pm))) AS zp, qm + ln(sum(exp(back - qm))) AS zq FROM d JOIN a USING (vec_id) GROUP BY vec_id, pm, qm),
k AS (SELECT vec_id, sum(exp(v - zp) * ((v - zp) - (back - zq))) AS kl, max(abs(v - back)) AS delta, arg_max(channel, (v, channel)) = arg_max(channel, (back, channel)) AS same, any_value(zq) - max(back) FILTER (channel = vec_id % 64) AS nll FROM d JOIN z USING (vec_id) GROUP BY 1)
"""


@query(affine_sql(4, LOGITS + "SELECT round(avg(nll), 6) AS nll, round(avg(kl), 6) AS kl, round(avg(CAST(same AS INT)), 6) AS agreement, round(max(delta), 6) AS max_delta FROM k", 64))
def quality_metrics(spark, sf_dir):
    """The vectors as logits against what four bits give back."""
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 4, 0)
    g = g.withColumn("back", affine.decoded(F.col("q"), F.col("values")))
    rows = quality.with_kl(g, "values", "back").select(
        quality.nll(F.col("back"), (F.col("tile_id") % 64).cast("int")).alias("nll"),
        "kl",
        (quality.top(F.col("values")) == quality.top(F.col("back"))).cast("int").alias("same"),
        quality.max_abs(F.col("values"), F.col("back")).alias("delta"),
    )
    return rows.agg(F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("kl"), 6).alias("kl"), F.round(F.avg("same"), 6).alias("agreement"), F.round(F.max("delta"), 6).alias("max_delta"))


@query(affine_sql(4, LOGITS + "SELECT label, round(greatest(avg(kl), 0), 6) AS mean_kl FROM k JOIN embeddings USING (vec_id) GROUP BY 1", 64))
def mean_kl(spark, sf_dir):
    g = affine.with_quantised(channel_groups(spark, sf_dir, 64), "values", 4, 0)
    g = quality.with_kl(g.withColumn("back", affine.decoded(F.col("q"), F.col("values"))), "values", "back")
    return g.groupBy("label").agg(F.round(F.greatest(F.avg("kl"), F.lit(0.0)), 6).alias("mean_kl"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, median(value) AS middle FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return e.groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.median("value").alias("middle"))
