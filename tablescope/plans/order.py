"""Whether values rise in row order, tested over range partitions and stitched at their edges."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.plans.columns import col, nan_to_null

# Functions of this module travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rising_columns(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partitions: int | None = None) -> set[str]:
    """The integer columns whose values strictly rise when the rows are ordered by ``order_by`` (gaps first).

    Rows that ``order_by`` does not tell apart may stand in any order, so their values need only lie above all before and
    below all after them. Rows of one order key become one row of least and greatest values before they are exchanged.
    Every task then tests its range of keys and hands on its first and last values; the driver compares neighbours, which is
    one row for each task and column. A column with a gap does not rise; an empty table has no rising column.
    """
    if not columns:
        return set()
    keys = [f"k{i}" for i in range(len(order_by))]
    sides = [x for i, c in enumerate(columns) for x in (F.min(col(c)).alias(f"l{i}"), F.max(col(c)).alias(f"h{i}"))]
    gaps = [F.sum(col(c).isNull().cast("long")).alias(f"g{i}") for i, c in enumerate(columns)]
    named = nan_to_null(df)
    grouped = named.groupBy(*[col(c).alias(k) for c, k in zip(order_by, keys, strict=True)]).agg(*sides, *gaps)
    ranged = grouped.repartitionByRange(partitions, *keys) if partitions else grouped.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).drop(*keys)
    number = len(columns)

    def test(batches):
        first, last, rises = [None] * number, [None] * number, [True] * number
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(number):
                if batch.column(f"g{i}").to_numpy().any():
                    rises[i] = False
                if batch.column(f"l{i}").null_count:  # a gap, already noted
                    continue
                low, high = (batch.column(f"{side}{i}").to_numpy().astype(np.int64) for side in "lh")
                rises[i] = rises[i] and bool((low[1:] > high[:-1]).all()) and (last[i] is None or low[0] > last[i])
                first[i] = int(low[0]) if first[i] is None else first[i]
                last[i] = int(high[-1])
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([place] * number, pa.int32()),
                pa.array(range(number), pa.int32()),
                pa.array(first, pa.int64()),
                pa.array(last, pa.int64()),
                pa.array(rises),
            ],
            ["place", "i", "first", "last", "rises"],
        )

    rows = ranged.mapInArrow(test, "place int, i int, first long, last long, rises boolean").collect()
    found = set()
    for i, name in enumerate(columns):
        parts = sorted((r for r in rows if r["i"] == i), key=lambda r: r["place"])
        ends = [(r["first"], r["last"]) for r in parts if r["first"] is not None]
        if ends and all(r["rises"] for r in parts) and all(a[1] < b[0] for a, b in zip(ends, ends[1:])):
            found.add(name)
    return found
