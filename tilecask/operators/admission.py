"""What to read, publish and keep, by measured cost."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import isfinite
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Invalid


def cost_error(*costs: Column) -> Column:
    """Null if every cost is finite and not negative."""
    bad = F.lit(False)
    for c in costs:
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    return F.when(bad, F.lit("Invalid"))


def choose_hit(tiers: Column, recompute: Column) -> Column:
    """The first cheapest of an array of ``(tier, ms)`` if it is strictly below recomputing, else null."""
    placed = F.transform(tiers, lambda t, i: F.struct(t["ms"].alias("ms"), i.alias("pos"), t["tier"].alias("tier")))
    best = F.array_min(placed)
    return F.when(best["ms"] < recompute, F.struct(best["tier"].alias("tier"), best["ms"].alias("ms")))


def should_publish(tiers: Column, recompute: Column, publish: Column, hits: Column) -> Column:
    hit = choose_hit(tiers, recompute)
    return F.coalesce(hits * (recompute - hit["ms"]) > publish, F.lit(False))


def net_saving(fallback: Column, resident: Column, reuses: Column, fill: Column) -> Column:
    return (fallback - resident) * reuses - fill


@dataclass
class Entry:
    bytes: int
    saving: float
    used: int
    value: Any = None


@dataclass
class HostTier:
    """Entries under a byte and an entry cap; the least saving for its bytes leaves first."""

    most_bytes: int
    most_entries: int
    entries: dict[Any, Entry] = field(default_factory=dict)
    clock: int = 0

    @property
    def resident_bytes(self) -> int:
        return sum(e.bytes for e in self.entries.values())

    def get(self, key: Any) -> Any:
        entry = self.entries.get(key)
        if entry is None:
            return None
        self.clock += 1
        entry.used = self.clock
        return entry

    def invalidate(self, key: Any) -> bool:
        return self.entries.pop(key, None) is not None

    def offer(self, key: Any, size: int, saving: float, build: Callable[[], Any] = lambda: None) -> bool:
        """Admit if it saves more for its bytes than each entry it displaces and no less than all of them together."""
        if size == 0 or not isfinite(saving):
            raise Invalid("a zero-sized entry or a saving that is no number")
        if saving <= 0 or size > self.most_bytes or not self.most_entries:
            return False
        others = {k: e for k, e in self.entries.items() if k != key}
        room, places, displaced = self.most_bytes - sum(e.bytes for e in others.values()), self.most_entries - len(others), []
        queue = sorted(others.items(), key=lambda x: (x[1].saving / x[1].bytes, x[1].used))
        for k, e in queue:
            if size <= room and places >= 1:
                break
            if e.saving / e.bytes > saving / size:
                return False
            room, places = room + e.bytes, places + 1
            displaced.append(k)
        if size > room or places < 1 or saving < sum(others[k].saving for k in displaced):
            return False
        value = build()
        for k in displaced:
            del self.entries[k]
        self.clock += 1
        self.entries.pop(key, None)
        self.entries[key] = Entry(size, saving, self.clock, value)
        return True


def replay(trace: DataFrame, tier: str, order: list[str], most_bytes: int, most_entries: int) -> DataFrame:
    """Runs each tier's trace ``(tier, order, op, key, bytes, saving)`` in order; the entries that stay.

    ``op`` is get, offer or invalidate.  A tier is a state of its own, so tiers run side by side; a task
    streams a tier's sorted rows and holds its entries only, which the caps bound.
    """
    kind = trace.schema[tier].dataType.simpleString()
    columns = ["op", "key", "bytes", "saving"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, name = HostTier(most_bytes, most_entries), None

        def left() -> pa.RecordBatch:
            rows = sorted(host.entries.items())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kinds), pa.array([k for k, _ in rows], pa.int64()), pa.array([e.bytes for _, e in rows], pa.int64()), pa.array([e.saving for _, e in rows], pa.float64()), pa.array([e.used for _, e in rows], pa.int64())], [tier, "key", "bytes", "saving", "used"])

        for batch in batches:
            kinds = batch.schema.field(tier).type
            for own, op, key, size, saving in zip(batch.column(tier).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if own != name:
                    if name is not None:
                        yield left()
                    host, name = HostTier(most_bytes, most_entries), own
                if op == "get":
                    host.get(key)
                elif op == "invalidate":
                    host.invalidate(key)
                else:
                    host.offer(key, int(size), float(saving))
        if name is not None:
            yield left()

    rows = trace.repartition(tier).sortWithinPartitions(tier, *order).select(tier, *columns)
    return rows.mapInArrow(run, f"{tier} {kind}, key bigint, bytes bigint, saving double, used bigint")
