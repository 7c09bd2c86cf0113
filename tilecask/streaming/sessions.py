"""Session heads as a stream: a checkpoint of an older generation than its session's head is refused."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heads_stream(checkpoints: DataFrame, key: str = "conv_id") -> DataFrame:
    """The running head of each session from an unbounded table of checkpoints."""
    return checkpoints.groupBy(key).agg(F.max("generation").alias("generation"), F.max_by("role", "generation").alias("role"))


def accept(checkpoints: DataFrame, key: str = "session") -> DataFrame:
    """Each checkpoint ``(session, generation, arrival)`` with ``ok``, decided in order of arrival with one number of state a session."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        head = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("arrival")
        ok = []
        for g in rows["generation"]:
            ok.append(bool(g >= 1 and g > head))
            head = max(head, int(g)) if ok[-1] else head
        state.update((head,))
        yield pd.DataFrame({key: name[0], "generation": rows["generation"].to_numpy(), "arrival": rows["arrival"].to_numpy(), "ok": ok})

    kind = checkpoints.schema[key].dataType.simpleString()
    return checkpoints.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, generation bigint, arrival bigint, ok boolean", "head bigint", "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums with a watermark; late rows beyond it are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
