"""Exact nearest-neighbour distances and neighbour counts of many planes of points at once, without meeting all pairs.

A plane is a set of points ``(f, x, y)``; distances are the larger of the two differences, or, in planes whose ``y`` is a
label, the difference in ``x`` between points of one label. Equal points are one point with a weight.

*Distances.* A bounded sample cuts each plane into rectangles of about ``BLOCK`` points. A task finds the nearest points
of a rectangle inside it, by halving it further. A point whose found distance reaches over the edge is asked again in the
rectangles that it reaches, and the answers are merged; nothing nearer can lie elsewhere.

*Counts.* How many points lie within a distance of a value is the difference of two ranks. Values are cut into ranges by the
same sample, whose totals give the rank at each range's start; inside a range a task looks up both ends. A range that many
points ask is copied to several tasks.

The driver holds the cuts and the totals of the ranges, at most ``MOST_BLOCKS`` each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions of this module travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 20_000
MOST_BLOCKS = 65_536
SAMPLE_PER_BLOCK = 16
LEAF = 96
CELLS = 2_000_000  # distances held at once
ASKED = 100_000  # questions to one copy of a range
# Points whose distance is the radius, up to rounding, are not within it.
SHRINK = 1.0 - 1e-9


def digamma(n: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function at numbers of one or more."""
    x = np.asarray(n, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    s = 1 / (x * x)
    series = s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132 - s * 691 / 32760)))))
    return shift + np.log(x) - 0.5 / x - series


@dataclass
class Cuts:
    """A plane cut into rectangles: nodes with an axis and a cut (left if not above it); leaves have axis -1."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray  # left child, or the number of the rectangle
    high: np.ndarray
    blocks: int

    @staticmethod
    def of(sample: np.ndarray, blocks: int) -> Cuts:
        axis, cut, low, high = [], [], [], []
        leaves = 0

        def add() -> int:
            for part in (axis, cut, low, high):
                part.append(0)
            return len(axis) - 1

        open_ = [(add(), sample, blocks)]
        while open_:
            node, points, parts = open_.pop()
            side = None
            if parts > 1 and len(points) > 1:
                for a in np.argsort(-np.array([len(np.unique(points[:, 0])), len(np.unique(points[:, 1]))]), kind="stable"):
                    at = np.quantile(points[:, a], 0.5, method="lower")
                    if at == points[:, a].max():  # the upper half is one value
                        below = points[:, a][points[:, a] < at]
                        at = below.max() if len(below) else at
                    left = points[:, a] <= at
                    if left.any() and not left.all():
                        side = a
                        break
            if side is None:
                axis[node], low[node] = -1, leaves
                leaves += 1
                continue
            axis[node], cut[node] = side, at
            low[node], high[node] = add(), add()
            open_.append((high[node], points[~left], parts - parts // 2))
            open_.append((low[node], points[left], parts // 2))
        return Cuts(np.array(axis), np.array(cut, float), np.array(low), np.array(high), leaves)

    def block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.axis[node] >= 0).any():
            at = node[inner]
            value = np.where(self.axis[at] == 0, x[inner], y[inner])
            node[inner] = np.where(value <= self.cut[at], self.low[at], self.high[at])
        return self.low[node]

    def reached(self, x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a rectangle that its box of half widths ``rx, ry`` touches."""
        point, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        found = []
        while len(point):
            leaf = self.axis[node] < 0
            found.append((point[leaf], self.low[node[leaf]]))
            point, node = point[~leaf], node[~leaf]
            across = self.axis[node] == 0
            value, r = np.where(across, x[point], y[point]), np.where(across, rx[point], ry[point])
            down, up = value - r <= self.cut[node], value + r > self.cut[node]
            point, node = np.append(point[down], point[up]), np.append(self.low[node[down]], self.high[node[up]])
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (point, node)


def halved(x: np.ndarray, y: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Places of the points in groups of about ``leaf`` that lie close together."""
    done, open_ = [], [np.arange(len(x))] if len(x) else []
    while open_:
        at = open_.pop()
        if len(at) <= leaf:
            done.append(at)
            continue
        spread = [np.ptp(v[at]) if np.isfinite(v[at]).all() else 0.0 for v in (x, y)]
        scale = [spread[0] / (np.ptp(x) or 1.0), spread[1] / (np.ptp(y) or 1.0)]
        order = np.argpartition((x if scale[0] >= scale[1] else y)[at], len(at) // 2)
        open_ += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


def _nearest_of(qx, qy, px, py, pw, k: int, labels: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the ``k`` nearest other points, ascending and padded with infinity, and their weights."""
    far, weight = np.full((len(qx), k), np.inf), np.zeros((len(qx), k), np.int64)
    step = max(1, CELLS // max(1, len(px)))
    for a in range(0, len(qx), step):
        dx = np.abs(px[None, :] - qx[a : a + step, None])
        dy = np.abs(py[None, :] - qy[a : a + step, None])
        d = np.where(dy == 0, dx, np.inf) if labels else np.maximum(dx, dy)
        d[(dx == 0) & (dy == 0)] = np.inf  # the point itself
        m = min(k, d.shape[1])
        best = np.argpartition(d, m - 1, axis=1)[:, :m]
        part = np.take_along_axis(d, best, axis=1)
        order = np.argsort(part, axis=1, kind="stable")
        far[a : a + step, :m] = np.take_along_axis(part, order, axis=1)
        weight[a : a + step, :m] = np.where(np.isinf(far[a : a + step, :m]), 0, pw[np.take_along_axis(best, order, axis=1)])
    return far, weight


def radius_of(far: np.ndarray, weight: np.ndarray, own: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The distance at which a point has ``need`` others: ``own`` at distance zero, then the weights."""
    enough = own[:, None] + np.cumsum(weight, axis=1) >= need[:, None]
    first = np.where(enough.any(axis=1), enough.argmax(axis=1), far.shape[1] - 1)
    found = np.where(enough.any(axis=1), far[np.arange(len(far)), first], np.inf)
    return np.where(own >= need, 0.0, found)


def nearest(qx, qy, radius, px, py, pw, k: int, labels: bool, own=None, need=None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of each question among ``px, py``; only what lies within ``radius`` matters.

    Without a radius the questions are the points themselves, and each first looks around in its own group.
    """
    far, weight = np.full((len(qx), k), np.inf), np.zeros((len(qx), k), np.int64)
    groups = halved(px, py)
    if not groups:
        return far, weight
    x0, x1 = np.array([px[g].min() for g in groups]), np.array([px[g].max() for g in groups])
    y0, y1 = np.array([py[g].min() for g in groups]), np.array([py[g].max() for g in groups])
    for g in groups if radius is None else halved(qx, qy):
        if radius is None:
            near = _nearest_of(qx[g], qy[g], px[g], py[g], pw[g], k, labels)
            reach = radius_of(*near, own[g], need[g]).max()
        else:
            reach = radius[g].max()
        up = 0.0 if labels else reach
        touched = (x0 <= qx[g].max() + reach) & (x1 >= qx[g].min() - reach)
        touched &= (y0 <= qy[g].max() + up) & (y1 >= qy[g].min() - up)
        if touched.any():
            at = np.concatenate([groups[t] for t in np.flatnonzero(touched)])
            far[g], weight[g] = _nearest_of(qx[g], qy[g], px[at], py[at], pw[at], k, labels)
    return far, weight


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64() if rows.dtype == float else pa.int64()))


class Planes:
    """Weighted points of several planes, cut for the questions to come.

    ``points`` holds ``f, x, y, w, need``; ``labels`` says whether ``y`` is a label. ``close`` gives the memory back.
    """

    def __init__(self, points: DataFrame, labels: bool, block: int = BLOCK):
        self.labels = labels
        self.points = points.persist(StorageLevel.MEMORY_AND_DISK)
        self.sizes = {r.f: r.n for r in self.points.groupBy("f").agg(F.count("*").alias("n")).collect()}
        total = max(1, sum(self.sizes.values()))
        block = max(block, -(-total // MOST_BLOCKS))
        share = min(1.0, SAMPLE_PER_BLOCK / block * 4)
        wanted = F.lit(share >= 1) | (F.pmod(F.xxhash64(F.lit(5), "f", "x", "y"), F.lit(1_000_000)) < share * 1_000_000)
        found: dict[int, list] = {}
        for r in self.points.filter(wanted).select("f", "x", "y").toLocalIterator():
            found.setdefault(r.f, []).append((r.x, r.y))
        self.sample = {f: np.array(sorted(found.get(f, [])), float).reshape(-1, 2) for f in self.sizes}
        self.cuts = {f: Cuts.of(self.sample[f], -(-n // block)) for f, n in self.sizes.items()}
        self.block = block
        self.held = [self.points]

    def close(self) -> None:
        for df in self.held:
            df.unpersist()

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def radii(self, k: int) -> DataFrame:
        """``f, x, y, w, r``: the distance within which each point has ``need`` others, at most ``k`` of them."""
        cuts, labels = self.cuts, self.labels

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, x, y = (batch.column(c).to_numpy() for c in ("f", "x", "y"))
                block = np.zeros(len(f), np.int32)
                for g in np.unique(f):
                    block[f == g] = cuts[g].block(x[f == g], y[f == g])
                yield batch.append_column("block", pa.array(block))

        placed = self.keep(self.points.mapInArrow(place, "f int, x double, y double, w long, need long, block int"))

        def inside(table: pa.Table) -> pa.Table:
            f, block = table.column("f")[0].as_py(), table.column("block")[0].as_py()
            x, y, w, need = (_column(table, c) for c in ("x", "y", "w", "need"))
            far, weight = nearest(x, y, None, x, y, w, k, labels, w - 1, need)
            r = radius_of(far, weight, w - 1, need)
            point, other = cuts[f].reached(x, y, r, np.zeros_like(r) if labels else r)
            point, other = point[other != block], other[other != block]
            order = np.argsort(point, kind="stable")
            number = np.bincount(point, minlength=len(x))
            ends = np.cumsum(number)
            others = [o.tolist() for o in np.split(other[order], ends[:-1])]
            return pa.table(
                {
                    **{c: table.column(c) for c in ("f", "x", "y", "w", "need")},
                    "r": r,
                    "d": _lists(far),
                    "dw": _lists(weight),
                    "others": pa.array(others, pa.list_(pa.int32())),
                }
            )

        schema = "f int, x double, y double, w long, need long, r double, d array<double>, dw array<long>, others array<int>"
        first = self.keep(placed.groupBy("f", "block").applyInArrow(inside, schema))
        asked = first.filter(F.size("others") > 0)
        questions = asked.select("f", "x", "y", "r", F.explode("others").alias("block"))

        def answer(questions: pa.Table, points: pa.Table) -> pa.Table:
            if not questions.num_rows or not points.num_rows:
                far = np.zeros((questions.num_rows, k)) + np.inf
                weight = np.zeros(far.shape, np.int64)
            else:
                qx, qy, r = (_column(questions, c) for c in ("x", "y", "r"))
                far, weight = nearest(qx, qy, r, *(_column(points, c) for c in ("x", "y", "w")), k, labels)
            return pa.table({**{c: questions.column(c) for c in ("f", "x", "y")}, "d": _lists(far), "dw": _lists(weight)})

        answers = (
            questions.groupBy("f", "block")
            .cogroup(placed.select("f", "block", "x", "y", "w").groupBy("f", "block"))
            .applyInArrow(answer, "f int, x double, y double, d array<double>, dw array<long>")
        )
        none = F.lit(None).cast("long")
        both = asked.select("f", "x", "y", "w", "need", "d", "dw").union(
            answers.select("f", "x", "y", none.alias("w"), none.alias("need"), "d", "dw")
        )
        merged = both.groupBy("f", "x", "y").agg(
            F.max("w").alias("w"),
            F.max("need").alias("need"),
            F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "dw")))).alias("near"),
        )
        start = F.struct((F.col("w") - 1).alias("have"), F.when(F.col("w") > F.col("need"), F.lit(0.0)).alias("r"))
        walk = F.aggregate(
            "near",
            start,
            lambda s, p: F.struct(
                (s["have"] + p["dw"]).alias("have"),
                F.when(s["r"].isNull() & (s["have"] + p["dw"] >= F.col("need")), p["d"]).otherwise(s["r"]).alias("r"),
            ),
        )
        final = merged.select("f", "x", "y", "w", walk["r"].alias("r"))
        return self.keep(first.filter(F.size("others") == 0).select("f", "x", "y", "w", "r").union(final))

    def mean_digamma(self, axis: str, values: DataFrame, radii: DataFrame) -> dict[int, float]:
        """For each plane the sum, over all its points, of weight times digamma of how many lie within ``r`` on one axis.

        ``values`` holds ``f, v, n``: how often each value of the axis is there.
        """
        side = 0 if axis == "x" else 1
        ranges = {}
        for f, n in self.sizes.items():
            column = np.sort(self.sample[f][:, side])
            parts = -(-n // self.block)
            marks = np.unique(column[np.linspace(0, len(column) - 1, parts + 1).astype(int)[1:-1]]) if len(column) and parts > 1 else column[:0]
            ranges[f] = marks
        total = {f: np.zeros(len(m) + 1, np.int64) for f, m in ranges.items()}

        def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, v = batch.column("f").to_numpy(), batch.column("v").to_numpy()
                part = np.zeros(len(f), np.int32)
                for g in np.unique(f):
                    part[f == g] = np.searchsorted(ranges[g], v[f == g], "left")
                yield batch.append_column("part", pa.array(part))

        values = self.keep(values.select("f", "v", "n").mapInArrow(ranged, "f int, v double, n long, part int"))
        for r in values.groupBy("f", "part").agg(F.sum("n").alias("n")).collect():
            total[r.f][r.part] = r.n
        before = {f: np.concatenate([[0], np.cumsum(t)[:-1]]) for f, t in total.items()}
        points = {r.f: max(1, r.n) for r in radii.groupBy("f").agg(F.count("*").alias("n")).collect()}
        # A range gets copies in proportion to the points that may ask it, by its share of the rows.
        copies = {
            f: np.maximum(1, np.ceil(2 * points.get(f, 0) * t / max(1, t.sum()) / ASKED)).astype(np.int32)
            for f, t in total.items()
        }
        fields = "f int, part int, copy int, x double, y double, w long, low double, high double"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, x, y, w, r = (batch.column(c).to_numpy() for c in ("f", "x", "y", "w", "r"))
                v = x if axis == "x" else y
                low, high = v - r * SHRINK, v + r * SHRINK
                first, last = np.zeros(len(f), np.int32), np.zeros(len(f), np.int32)
                for g in np.unique(f):
                    at = f == g
                    first[at], last[at] = (np.searchsorted(ranges[g], e[at], "left") for e in (low, high))
                one = first == last
                # Ends in one range are asked together; others apart, with the missing end as NaN.
                row = np.concatenate([np.flatnonzero(one), np.flatnonzero(~one), np.flatnonzero(~one)])
                lower = np.concatenate([np.ones(one.sum(), bool), np.ones((~one).sum(), bool), np.zeros((~one).sum(), bool)])
                upper = np.concatenate([np.ones(one.sum(), bool), np.zeros((~one).sum(), bool), np.ones((~one).sum(), bool)])
                part = np.where(lower, first[row], last[row]).astype(np.int32)
                copy = np.zeros(len(row), np.int32)
                for g in np.unique(f[row]):
                    at = f[row] == g
                    copy[at] = np.arange(at.sum()) % copies[g][part[at]]
                arrays = [f[row], part, copy, x[row], y[row], w[row], np.where(lower, low[row], np.nan), np.where(upper, high[row], np.nan)]
                names = ["f", "part", "copy", "x", "y", "w", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

        asked = radii.select("f", "x", "y", "w", "r").mapInArrow(ask, fields)

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f, part = batch.column("f").to_numpy(), batch.column("part").to_numpy()
                times = np.array([copies[g][p] for g, p in zip(f.tolist(), part.tolist(), strict=True)], np.int64)
                row = np.repeat(np.arange(len(f)), times)
                copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                taken = batch.take(pa.array(row))
                yield taken.append_column("copy", pa.array(copy.astype(np.int32)))

        spread = values.mapInArrow(copied, "f int, v double, n long, part int, copy int")

        def look(questions: pa.Table, values: pa.Table) -> pa.Table:
            if not questions.num_rows:
                return pa.table({c: pa.array([], t) for c, t in (("f", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("w", pa.int64()), ("n", pa.int64()), ("psi", pa.float64()))})
            f, part = questions.column("f")[0].as_py(), questions.column("part")[0].as_py()
            v, n = (_column(values, c) for c in ("v", "n")) if values.num_rows else (np.zeros(0), np.zeros(0, np.int64))
            order = np.argsort(v)
            v, upto = v[order], np.concatenate([[0], np.cumsum(n[order])])
            low, high, w, x, y = (_column(questions, c) for c in ("low", "high", "w", "x", "y"))
            under = before[f][part] + upto[np.searchsorted(v, low, "left")]
            within = before[f][part] + upto[np.searchsorted(v, high, "right")]
            whole = ~np.isnan(low) & ~np.isnan(high)
            half = np.flatnonzero(~whole)
            psi = float((w[whole] * digamma((within - under)[whole])).sum())
            count = np.where(np.isnan(low[half]), within[half], -under[half])
            return pa.table(
                {
                    "f": pa.array(np.full(len(half) + 1, f, np.int32)),
                    "x": np.append(x[half], np.nan),
                    "y": np.append(y[half], np.nan),
                    "w": np.append(w[half], 0),
                    "n": np.append(count, 0).astype(np.int64),
                    "psi": np.append(np.zeros(len(half)), psi),
                }
            )

        key = ["f", "part", "copy"]
        found = self.keep(
            asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(look, "f int, x double, y double, w long, n long, psi double")
        )
        done = found.filter("w = 0").groupBy("f").agg(F.sum("psi").alias("psi"))
        counted = found.filter("w > 0").groupBy("f", "x", "y").agg(F.max("w").alias("w"), F.sum("n").alias("n"))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                psi = batch.column("w").to_numpy() * digamma(batch.column("n").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(psi)], ["f", "psi"])

        halves = counted.select("f", "w", "n").mapInArrow(weigh, "f int, psi double").groupBy("f").agg(F.sum("psi").alias("psi"))
        return {r.f: r.psi for r in done.union(halves).groupBy("f").agg(F.sum("psi").alias("psi")).collect()}
