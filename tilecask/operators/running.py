"""Running sums in an order, without bringing a group to one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def settled(rows: DataFrame) -> DataFrame:
    """The rows under a plan of their own, in partitions that stay as they are."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def running_sums(rows: DataFrame, group: str, order: list[Column], values: dict[str, str]) -> DataFrame:
    """``rows`` with a column ``values[c]`` for each whole-number column c: the sum of it over the group's rows up to each.

    Rows are sorted by ranges, tasks sum their own, and what a group has in the partitions before comes from one
    total for each group and partition.
    """
    placed = settled(rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order))
    names = list(values)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_pylist()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            sums = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != last:
                    carried[:] = 0
                sums[:, a:b] = sums[:, a:b].cumsum(1) + carried[:, None]
                last, carried = keys[a], sums[:, b - 1].copy()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(s) for s in sums)], [*batch.schema.names, *(f"_sum_{c}" for c in names)])

    local = placed.mapInArrow(run, f"{kinds}, {', '.join(f'`_sum_{c}` bigint' for c in names)}").withColumn("_part", F.spark_partition_id())
    totals = placed.groupBy(F.spark_partition_id().alias("_part"), group).agg(*(F.sum(c).cast("bigint").alias(f"_total_{c}") for c in names))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has the group
    totals = totals.select("_part", group, *(F.coalesce(F.sum(f"_total_{c}").over(before), F.lit(0)).alias(f"_total_{c}") for c in names))
    out = local.join(totals, ["_part", group])
    return out.select(*placed.columns, *((F.col(f"_sum_{c}") + F.col(f"_total_{c}")).alias(n) for c, n in values.items()))
