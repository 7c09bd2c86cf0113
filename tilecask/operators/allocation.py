"""Budgeted choice of precision: purchases of quality for bytes, by sorted moves and running sums.

An item's best purchases from where it stands follow one another with falling gain for each byte, so all items'
purchases in that order are the greedy ones as long as each fits.  A round makes those before the first that does
not fit; the next one starts from there with what still fits, until nothing does.  Each round leaves out at least the
size that did not fit, so there are no more rounds than sizes of a step.  No pool is brought to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Corrupt, Invalid
from .running import running_sums, settled

MOVES = "k int, j int, extra bigint, gain double, after bigint"


def _moves(options: list[dict], j: int, left: int, free: bool) -> Iterator[tuple[int, int, int, float, int]]:
    """One item's purchases ``(k, j, extra, gain, after)`` in order; a later one never has a greater gain, or an equal one and smaller ``after``, than the one before."""
    now = next(o for o in options if o["j"] == j)
    start, k, held = now["bytes"], 0, (float("inf"), 0)
    while True:
        best = None
        for o in options:
            extra, drop = o["bytes"] - now["bytes"], now["score"] - o["score"]
            if drop > 0 and (extra > 0 or extra == 0 and free) and o["bytes"] - start <= left:
                rank = (drop / extra if extra else float("inf"), -extra)
                if best is None or rank > best[0]:
                    best = rank, o
        if best is None:
            return
        (gain, less), o = best
        # what the last step made the best at once comes at once
        held = held if k and (gain > held[0] or gain == held[0] and -less < held[1]) else (gain, -less)
        yield k, o["j"], -less, held[0], held[1]
        now, k = o, k + 1


def _all_moves(items: DataFrame, pool: str, free: bool) -> DataFrame:
    """``(pool, item, k, j, extra, gain, after)`` of ``(pool, item, options, j, left)``."""
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in (pool, "item"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], [[], [], [], [], []]
            for i, r in enumerate(batch.select(["options", "j", "left"]).to_pylist()):
                for move in _moves(r["options"], r["j"], r["left"], free):
                    rows.append(i)
                    for column, value in zip(out, move, strict=True):
                        column.append(value)
            at = pa.array(rows, pa.int64())
            types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(pool).take(at), batch.column("item").take(at), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [pool, "item", "k", "j", "extra", "gain", "after"])

    return items.mapInArrow(run, f"{kinds}, {MOVES}")


def _items(choices: DataFrame, pool: str) -> DataFrame:
    """``(pool, item, options)``: each item's few options by j."""
    return choices.groupBy(pool, "item").agg(F.array_sort(F.collect_list(F.struct("j", F.col("bytes").cast("bigint").alias("bytes"), F.col("score").cast("double").alias("score")))).alias("options"))


def _fitting(steps: DataFrame, pool: str, order: list[Column]) -> DataFrame:
    """The steps ``(pool, .., extra, left)`` before the first in the order that does not fit; ``nth`` counts them."""
    summed = settled(running_sums(steps.withColumn("one", F.lit(1)), pool, order, {"extra": "spent", "one": "nth"}))
    first = summed.where("spent > left").groupBy(pool).agg(F.min("nth").alias("stop"))
    return summed.join(first, pool, "left").withColumn("fits", F.col("stop").isNull() | (F.col("nth") < F.col("stop"))).drop("one", "stop")


def _budgets(choices: DataFrame, pool: str, budget: Column, start: DataFrame) -> DataFrame:
    """``(pool, left)`` after the start's bytes."""
    left = choices.groupBy(pool).agg(F.max(budget).cast("bigint").alias("budget")).join(start.groupBy(pool).agg(F.sum("bytes").alias("used")), pool)
    left = settled(left.select(pool, (F.col("budget") - F.col("used")).alias("left")))
    if not left.where("left < 0").isEmpty():
        raise Invalid("the budget is below the least possible size")
    return left


def allocate(choices: DataFrame, pool: str, budget: Column, method: str = "greedy", **how) -> DataFrame:
    """``(pool, item, j)`` for choices ``(pool, item, j, bytes, score)``; each pool has its own budget."""
    return {"greedy": greedy, "dispersed": dispersed}[method](choices, pool, budget, **how)


def greedy(choices: DataFrame, pool: str, budget: Column, free_upgrades: bool = False, even_floor: bool = False) -> DataFrame:
    """The chosen option of each item.

    Every item starts at its cheapest option (without ``free_upgrades`` the lower score among equals).
    Then the purchase with the greatest drop of score for each byte is made, fewer bytes first
    among equals, then the first item, until none fits.  With ``free_upgrades`` an option of equal bytes costs nothing
    and comes first.  With ``even_floor`` items at even places may not have their first option.
    """
    items = _items(choices, pool)
    if even_floor:
        placed = running_sums(items.withColumn("one", F.lit(1)), pool, [F.col("item")], {"one": "nth"})
        items = placed.withColumn("options", F.when(F.col("nth") % 2 == 1, F.filter("options", lambda o: o["j"] >= 1)).otherwise(F.col("options"))).drop("one", "nth")
    cheapest = F.array_min(F.transform("options", lambda o: F.struct(o["bytes"].alias("bytes"), (F.lit(0.0) if free_upgrades else o["score"]).alias("s"), o["j"].alias("j"))))
    items = settled(items.withColumn("j", cheapest["j"]).withColumn("bytes", cheapest["bytes"]))
    left = _budgets(choices, pool, budget, items)
    items = items.drop("bytes")
    order = [F.col("gain").desc(), F.col("after"), F.col("item"), F.col("k")]
    while True:
        moves = _all_moves(items.join(left, pool), pool, free_upgrades).join(left, pool)
        steps = settled(_fitting(moves, pool, order))
        if steps.isEmpty():
            return items.select(pool, "item", "j")
        done = steps.where("fits")
        spent = done.groupBy(pool).agg(F.sum("extra").alias("spent"))
        left = settled(left.join(spent, pool, "left").select(pool, (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))
        new = done.groupBy(pool, "item").agg(F.max_by("j", "k").alias("new"))
        items = settled(items.join(new, [pool, "item"], "left").withColumn("j", F.coalesce("new", "j")).drop("new"))


def dispersed(choices: DataFrame, pool: str, budget: Column, stride: int = 73) -> DataFrame:
    """Second options in the order of ``place * stride mod items`` while they fit; one that does not is passed over."""
    items = _items(choices, pool).select(pool, "item", F.col("options")[0]["bytes"].alias("bytes"), (F.col("options")[1]["bytes"] - F.col("options")[0]["bytes"]).alias("raise"))
    left = _budgets(choices, pool, budget, items)
    placed = running_sums(items.withColumn("one", F.lit(1)), pool, [F.col("item")], {"one": "nth"}).drop("one")
    place = F.col("nth") - 1
    open_ = settled(placed.join(items.groupBy(pool).agg(F.count("*").alias("n")), pool).select(pool, "item", "raise", F.greatest("raise", F.lit(0)).alias("extra"), (place * stride % F.col("n")).alias("turn"), place.alias("place")))
    taken = None
    while True:
        fitting = open_.join(left, pool).where("raise <= left")
        steps = settled(_fitting(fitting, pool, [F.col("turn"), F.col("place")]))
        if steps.isEmpty():
            break
        done = steps.where("fits").select(pool, "item", "extra")
        taken = done if taken is None else taken.union(done)
        spent = done.groupBy(pool).agg(F.sum("extra").alias("spent"))
        left = settled(left.join(spent, pool, "left").select(pool, (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))
        open_ = settled(steps.where("not fits").select(*open_.columns))
    if taken is None:
        return items.select(pool, "item", F.lit(0).alias("j"))
    return items.select(pool, "item").join(taken.select(pool, "item", F.lit(1).alias("got")), [pool, "item"], "left").select(pool, "item", F.coalesce("got", F.lit(0)).alias("j"))


def rate_score(score: Column, beta: Column, bits: Column) -> Column:
    return score * F.pow(beta, -(bits - 2))


def beta_of(mse: DataFrame, keys: list[str]) -> DataFrame:
    """How error falls with each bit, from mean errors ``(keys, bits, mse)``."""
    slope = F.regr_slope(F.ln(F.greatest(F.col("mse"), F.lit(1e-30))), F.col("bits").cast("double"))
    return mse.groupBy(*keys).agg(F.greatest(F.exp(-slope), F.lit(1.000001)).alias("beta"))


def chosen_tiles(variants: DataFrame, chosen: DataFrame) -> DataFrame:
    """The encoded variant ``(pool, item, j, ..)`` of each item that was chosen."""
    return variants.join(chosen.select("pool", "item", "j"), ["pool", "item", "j"])


def chosen_bytes(choices: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(pool, bytes)`` of a choice; adding beyond 64 bits is an error."""
    return chosen_tiles(choices, chosen).groupBy("pool").agg(F.sum(F.col("bytes").cast("bigint")).alias("bytes"))


def within(choices: DataFrame, chosen: DataFrame, budget: DataFrame) -> DataFrame:
    """``(pool, bytes, budget, ok)`` of a choice against ``(pool, budget)``."""
    return chosen_bytes(choices, chosen).join(budget, "pool").withColumn("ok", F.col("bytes") <= F.col("budget"))


def _changes(chosen: DataFrame, choices: DataFrame) -> DataFrame:
    """``(pool, item, j, db, gain)`` of every other option of each item against its present one."""
    now = choices.join(chosen.select("pool", "item", "j"), ["pool", "item", "j"]).select("pool", "item", F.col("j").alias("now"), F.col("bytes").alias("b0"), F.col("score").alias("s0"))
    return choices.join(now, ["pool", "item"]).where("j != now").select("pool", "item", "j", (F.col("bytes") - F.col("b0")).cast("bigint").alias("db"), (F.col("s0") - F.col("score")).alias("gain"))


def swaps(chosen: DataFrame, choices: DataFrame, most: int = 40, slack: int = 0) -> DataFrame:
    """The ``most`` changes of one item or of two of a pool that gain most within ``slack`` more bytes: ``(pool, up, up_j, down, down_j, gain)``, best first.

    Of changes by the same bytes only the best can be in it, so no more than ``most`` and one item's own are kept of
    each; of what is left those go that as many cheaper and better ones beat.  Single changes have a null ``down``.
    """
    changes = _changes(chosen, choices)
    keep = most + (changes.groupBy("pool", "item").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] or 0)
    best = Window.partitionBy("pool", "db").orderBy(F.desc("gain"), "item", "j")
    few = changes.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep).drop("r")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["db", "gain", "item", "j"], ascending=[True, False, True, True]).to_dict("records")
        kept: list[dict] = []
        for r in rows:  # a change that ``keep`` no dearer ones beat is in no best pair
            if sum(1 for k in kept if k["gain"] > r["gain"] or (k["gain"] == r["gain"] and k["db"] <= r["db"])) < keep:
                kept.append(r)
        out = [(r["gain"], r["item"], r["j"], None, None) for r in kept if r["db"] <= slack]
        for i, a in enumerate(kept):
            for b in kept[i + 1 :]:
                if a["item"] != b["item"] and a["db"] + b["db"] <= slack:
                    x, y = sorted((a, b), key=lambda r: (r["item"], r["j"]))
                    out.append((x["gain"] + y["gain"], x["item"], x["j"], y["item"], y["j"]))
            if len(out) > 64 * most:
                out = sorted(out, key=lambda o: (-o[0], o[1], o[2], o[3] is not None, o[3] or 0, o[4] or 0))[:most]
        out.sort(key=lambda o: (-o[0], o[1], o[2], o[3] is not None, o[3] or 0, o[4] or 0))
        return pd.DataFrame([(pdf["pool"].iloc[0], *o[1:], o[0]) for o in out[:most]], columns=["pool", "up", "up_j", "down", "down_j", "gain"]).astype({"down": "Int64", "down_j": "Int32"})

    pool, item = (choices.schema[c].dataType.simpleString() for c in ("pool", "item"))
    found = few.groupBy("pool").applyInPandas(pairs, f"pool {pool}, up {item}, up_j int, down {item}, down_j int, gain double")
    return found.orderBy(F.desc("gain"), "pool", "up", "up_j", F.col("down").asc_nulls_first(), "down_j").limit(most)


#: A choice ``(pool, item, j)`` to its measured loss.
Scorer = Callable[[DataFrame], float]


def _with_changes(chosen: DataFrame, changed: list[tuple]) -> DataFrame:
    spark = chosen.sparkSession
    kinds = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in ("pool", "item"))
    new = spark.createDataFrame([(p, i, j) for p, i, j in changed], f"{kinds}, new int")
    return chosen.join(F.broadcast(new), ["pool", "item"], "left").select("pool", "item", F.coalesce("new", "j").alias("j"))


def refined(chosen: DataFrame, choices: DataFrame, slack: Callable[[DataFrame], int], score: Scorer, rounds: int = 2, most: int = 40) -> tuple[DataFrame, float, int]:
    """A choice after some rounds of the best of ``most`` proposed swaps that a scorer finds better: the choice, its loss and how many were scored.

    ``slack`` says how many more bytes a choice may take; the table is changed by two rows for each trial.
    """
    current, trials = score(chosen), 1
    for _ in range(rounds):
        best = None
        for s in swaps(chosen, choices, most, slack(chosen)).collect():  # ``most`` rows
            changed = [(s["pool"], s["up"], s["up_j"]), *([] if s["down"] is None else [(s["pool"], s["down"], s["down_j"])])]
            trial = _with_changes(chosen, changed)
            loss, trials = score(trial), trials + 1
            if loss + 1e-8 < current and (best is None or loss < best[1]):
                best = trial, loss
        if best is None:
            break
        chosen, current = settled(best[0]), best[1]
    return chosen, current, trials


def one_bit_shortlist(chosen: DataFrame, choices: DataFrame, most: int = 20, low: int = 0, high: int = 2) -> DataFrame:
    """The ``most`` items at option ``high`` that lose least score for each byte that ``low`` saves: ``(pool, item, saved, loss_per_byte)``."""
    option = lambda j, n: choices.where(F.col("j") == j).select("pool", "item", F.col("bytes").alias(f"b{n}"), F.col("score").alias(f"s{n}"))
    both = chosen.where(F.col("j") == high).select("pool", "item").join(option(low, 0), ["pool", "item"]).join(option(high, 1), ["pool", "item"]).where("b0 < b1")
    saved = (F.col("b1") - F.col("b0")).cast("bigint")
    rows = both.select("pool", "item", saved.alias("saved"), (F.greatest(F.col("s0") - F.col("s1"), F.lit(0.0)) / saved).alias("loss_per_byte"))
    return rows.orderBy("loss_per_byte", "pool", "item").limit(most)


def sparse_one_bit(chosen: DataFrame, choices: DataFrame, score: Scorer, most_tiles: int = 6, shortlist: int = 20, extra: float = 0.01, low: int = 0, high: int = 2) -> tuple[DataFrame, float, int]:
    """A choice with up to ``most_tiles`` items at their lowest option while the loss stays within ``extra`` of the first.

    In each round the item of the shortlist that saves most bytes goes there, the one of less loss among equals.
    """
    first = current = score(chosen)
    trials = 0
    for _ in range(most_tiles):
        best = None
        for r in one_bit_shortlist(chosen, choices, shortlist, low, high).collect():  # ``shortlist`` rows
            trial = _with_changes(chosen, [(r["pool"], r["item"], low)])
            loss, trials = score(trial), trials + 1
            if loss <= first + extra and (best is None or (-r["saved"], loss) < best[0]):
                best = (-r["saved"], loss), trial
        if best is None:
            break
        chosen, current = settled(best[1]), best[0][1]
    return chosen, current, trials


def persist_and_verify(store, name: str, tiles: DataFrame, keys: list[str]) -> int:
    """Write chosen tiles in one commit and hold what a new reader sees against them, row by row and bit by bit."""
    from ..sources.store import Reader

    tiles = settled(tiles)
    version = store.append({name: tiles})
    back = Reader(store.spark, store.files.root, version).table(name).join(tiles.select(*keys), keys, "left_semi")
    rest = [c for c in tiles.columns if c not in keys]
    digest = F.sha2(F.to_json(F.struct(*[F.base64(c) if tiles.schema[c].dataType.typeName() == "binary" else F.col(c) for c in rest])), 256)
    both = tiles.select(*keys, digest.alias("a")).join(back.select(*keys, digest.alias("b")), keys, "full_outer")
    if not both.where("not (a <=> b)").isEmpty():
        raise Corrupt(f"{name}: what was read is not what was written")
    return version
