"""Exact quantiles of any number of rows, in a number of jobs that does not depend on how many are asked for.

The wanted order statistics of all columns are found together by narrowing brackets. Marks are spread over each column;
one pass counts exactly how many values lie under, on and between the marks; a rank then lies on a mark or in the
bracket between two. Brackets that still hold many values get marks of their own and another pass. The values of small
brackets are counted by value, and running sums say which has the rank. Tasks send counters, and only values of small
brackets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescope.plans.columns import COLUMNS_PER_AGGREGATE, col, local_rows

# Values of one bracket that are counted one by one.
BRACKET_ROWS = 200_000
FIRST_MARKS = 2_000
MARKS_PER_BRACKET = 500


@dataclass
class _Search:
    column: str
    rank: int  # zero-based position among the sorted non-null values
    inside: int  # values in the open bracket
    below: int = 0  # values at or under the lower end
    low: float | None = None
    high: float | None = None
    answer: float | None = None


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    names: Sequence[str] | None = None,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """One row per column with linearly interpolated quantiles of its non-null values.

    Columns without values give no row.
    """
    names = list(names or [f"q{i}" for i in range(len(probabilities))])
    schema = "column string, " + ", ".join(f"`{n}` double" for n in names)
    if not columns:
        return local_rows(df.sparkSession, [], schema)
    counts = df.agg(*[F.count(col(c)).alias(c) for c in columns]).first()
    wanted: dict[tuple[str, int], None] = {}
    for name in columns:
        for p in probabilities:
            if counts[name]:
                place = p * (counts[name] - 1)
                wanted[(name, math.floor(place))] = None
                wanted[(name, math.ceil(place))] = None
    found = order_statistics(df, list(wanted), {c: counts[c] for c in columns}, bracket_rows)
    result = []
    for name in columns:
        if counts[name]:
            row = [name]
            for p in probabilities:
                place = p * (counts[name] - 1)
                low, high = found[(name, math.floor(place))], found[(name, math.ceil(place))]
                share = place - math.floor(place)
                row.append(low + (high - low) * share if share else low)
            result.append(tuple(row))
    return local_rows(df.sparkSession, result, schema)


def order_statistics(
    df: DataFrame, wanted: Sequence[tuple[str, int]], counts: dict[str, int], bracket_rows: int = BRACKET_ROWS
) -> dict[tuple[str, int], float]:
    """The values at the given ``(column, zero-based rank)`` places, exactly, without sorting the table."""
    searches = [_Search(column, rank, counts[column]) for column, rank in wanted]
    columns = list(dict.fromkeys(column for column, _ in wanted))
    numbers = df.select(*[col(c).cast("double").alias(c) for c in columns])
    marks = None
    while wide := [s for s in searches if s.answer is None and s.inside > bracket_rows]:
        marks = _ends(numbers, wide) if marks is None else _spaced(wide)
        for column, steps in _counted(numbers, marks).items():
            for s in wide:
                if s.column == column:
                    _move(s, steps)
    _finish(numbers, [s for s in searches if s.answer is None])
    return {(s.column, s.rank): s.answer for s in searches}


def _ends(numbers: DataFrame, searches: list[_Search]) -> dict[str, np.ndarray]:
    """Marks all over each column, from its smallest to its largest value."""
    names = list(dict.fromkeys(s.column for s in searches))
    found: dict[str, np.ndarray] = {}
    for start in range(0, len(names), COLUMNS_PER_AGGREGATE):
        part = names[start : start + COLUMNS_PER_AGGREGATE]
        row = numbers.agg(*[f(F.nanvl(col(c), F.lit(None))) for c in part for f in (F.min, F.max)]).first()
        for i, c in enumerate(part):
            low, high = row[2 * i], row[2 * i + 1]
            found[c] = np.unique(np.concatenate([[low, high], _marks(low, high, FIRST_MARKS)]))
    return found


def _marks(low: float, high: float, n: int) -> np.ndarray:
    """Evenly spaced marks inside a bracket, the numbers next to its ends, and powers of ten, so that no scale takes
    many rounds."""
    largest = np.finfo(float).max
    a, b = max(low, -largest), min(high, largest)
    t = np.linspace(0.0, 1.0, n)
    tens = 10.0 ** np.arange(-300, 301, 5)
    marks = np.concatenate([a * (1 - t) + b * t, -tens, [0.0], tens, [np.nextafter(a, b), np.nextafter(b, a)]])
    return marks[(marks > low) & (marks < high)]


def _spaced(searches: list[_Search]) -> dict[str, np.ndarray]:
    """Marks in every open bracket."""
    found: dict[str, list[np.ndarray]] = {}
    for low, high, column in {(s.low, s.high, s.column) for s in searches}:
        found.setdefault(column, []).append(_marks(low, high, MARKS_PER_BRACKET))
    return {c: np.unique(np.concatenate(parts)) for c, parts in found.items()}


def _counted(numbers: DataFrame, marks: dict[str, np.ndarray]) -> dict[str, list[tuple[float, int, int]]]:
    """For each column and mark, how many values lie under it and how many equal it; one job for all."""
    names = list(marks)
    edges = [marks[c] for c in names]

    def work(batches):
        totals = [np.zeros(2 * len(m) + 1, np.int64) for m in edges]
        for batch in batches:
            for total, m, values in zip(totals, edges, batch.columns, strict=True):
                x = values.to_numpy(zero_copy_only=False).astype(float)
                x = x[~np.isnan(x)]
                # Even places lie between two marks, odd ones on a mark.
                place = np.searchsorted(m, x, "left") + np.searchsorted(m, x, "right")
                total += np.bincount(place, minlength=len(total))
        for number, total in enumerate(totals):
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(filled), number)), pa.array(filled), pa.array(total[filled])], ["c", "place", "n"]
            )

    parts = numbers.select(*[col(c) for c in names]).mapInArrow(work, "c long, place long, n long")
    totals = [np.zeros(2 * len(m) + 1, np.int64) for m in edges]
    for row in parts.groupBy("c", "place").agg(F.sum("n").alias("n")).collect():
        totals[row["c"]][row["place"]] = row["n"]
    return {
        c: [
            (float(mark), int(total[: 2 * i + 1].sum()), int(total[2 * i + 1])) for i, mark in enumerate(m)
        ]
        for c, m, total in zip(names, edges, totals, strict=True)
    }


def _move(s: _Search, steps: list[tuple[float, int, int]]) -> None:
    """Shrink a search to the marks around its rank, or end it on a mark. ``steps`` holds for each mark how many
    values lie under it and how many equal it."""
    start, end = s.below, s.below + s.inside
    for mark, under, equal in steps:
        if s.rank < under:
            if s.high is None or mark < s.high:
                s.high, end = mark, under
            break
        if s.rank < under + equal:
            s.answer = mark
            return
        if s.low is None or mark > s.low:
            s.low, start = mark, under + equal
    s.below, s.inside = start, end - start


def _finish(numbers: DataFrame, searches: list[_Search]) -> None:
    """Ranks of small brackets: their values are counted, and a running sum over each bracket finds the rank."""
    if not searches:
        return
    groups = sorted({(s.column, s.low, s.high) for s in searches}, key=str)
    names = list(dict.fromkeys(g[0] for g in groups))
    number = {g: i for i, g in enumerate(groups)}
    by_column = [[(number[g], g[1], g[2]) for g in groups if g[0] == c] for c in names]

    def work(batches):
        for batch in batches:
            group, value, n = [], [], []
            for found, values in zip(by_column, batch.columns, strict=True):
                x = values.to_numpy(zero_copy_only=False).astype(float)
                x = np.sort(x[~np.isnan(x)])
                for number, low, high in found:
                    a = 0 if low is None else np.searchsorted(x, low, "right")
                    b = len(x) if high is None else np.searchsorted(x, high, "left")
                    if a < b:
                        kept, counts = np.unique(x[a:b], return_counts=True)
                        group.append(np.full(len(kept), number))
                        value.append(kept)
                        n.append(counts)
            if group:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (group, value, n)], ["g", "value", "n"]
                )

    cells = numbers.select(*[col(c) for c in names]).mapInArrow(work, "g long, value double, n long")
    cells = cells.groupBy("g", "value").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("value"))  # a bracket holds a bounded number of values
    asked = [(number[(s.column, s.low, s.high)], i, s.rank - s.below) for i, s in enumerate(searches)]
    ranks = local_rows(numbers.sparkSession, asked, "g long, i long, rank long")
    hits = cells.withColumn("upto", upto).join(ranks, "g").filter("rank < upto AND rank >= upto - n")
    for row in hits.select("i", "value").collect():
        searches[row["i"]].answer = row["value"]
