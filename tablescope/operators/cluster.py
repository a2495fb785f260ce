"""K-means over the numeric columns, with the number of clusters chosen by silhouette.

All numbers of clusters and all starts are tried together: one pass over the rows assigns each row for every start and sums
up the clusters of each, so an iteration moves one small row for each task, start and cluster. One start comes from
splitting: the cluster with the largest squared error is cut at its mean along its widest column, until there are enough. The
others are oversampled seeds: in each of five rounds, rows are drawn with a chance that grows with their squared distance to
the seeds so far, by a hash of the row, and the seeds, weighted by the rows nearest to them, are reduced to each number of clusters.
The start of least squared error is kept. Nothing depends on the order or the partitions of the rows; sums that only differ in
their last bits are rounded away.

The silhouette uses distances, not their squares. Space is cut into cells, and the rows of a cluster in a cell are known by
their number, mean and spread. With ``d`` the distance to that mean and ``s`` the root mean square distance of those rows from it, their
mean distance from any point lies between ``d`` and the root of ``d**2 + s**2``. The sums of these ends bound each row's silhouette, so the
cost is linear in the rows and the error is known.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.plans.columns import col, local_rows, nan_to_null, numeric_columns, per_column

# Functions of this module travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_ROWS = 30
MAX_K = 8
MAX_ITERATIONS = 100
# Iteration ends when the squared moves of all centres sum to this share of the mean variance (1 once standardised).
TOLERANCE = 1e-4
DIGITS = 9
STARTS = 10
SEED_ROUNDS = 5
PACK = 4096  # rows of a block
PARTS = 1 << 17, 1 << 22  # rows of a partition at least and at most; between them, a partition for each core
CACHED = 1 << 17  # numbers of a step of the work on a block, so that they stay in a core's cache
RACES = {2: 3, 5: 1}  # after so many rounds, so many seeded starts of each k go on
# A seeded start also ends when a round lowers its error by less than this share.
REST = 1e-4
CELLS = 64  # cells of space that the silhouette sums up; more cells make its error smaller
CELL_SAMPLE = 20_000  # rows that place the cells; they only decide how tight the bounds are


@dataclass
class Clustering:
    """The result of a search: scores of every k tried, the centres of the best k, and the labelled rows."""

    columns: list[str]
    scores: list[tuple[int, float, float]]  # k, silhouette, the most it can be off
    inertia: dict[int, float]  # sum of squared distances to the centres
    best_k: int
    silhouette: float
    points: np.ndarray
    mean: list[float]
    std: list[float]
    label: str
    labelled: DataFrame

    def k_scores(self) -> DataFrame:
        """``k, silhouette, silhouette_error, inertia, is_best``; the error bounds the silhouette's distance from the exact one."""
        rows = [(k, round(s, 4), round(e, 4), float(f"{self.inertia[k]:.9g}"), k == self.best_k) for k, s, e in self.scores]
        schema = "k int, silhouette double, silhouette_error double, inertia double, is_best boolean"
        return local_rows(self.labelled.sparkSession, rows, schema)

    def sizes(self) -> DataFrame:
        return self.labelled.groupBy(F.col(self.label).alias("cluster")).agg(F.count("*").alias("size")).orderBy("cluster")

    def centers(self) -> DataFrame:
        """Cluster centres in the columns' own units: ``cluster, column, center``."""
        rows = [
            (number, name, float(round(point[i] * self.std[i] + self.mean[i], 6)))
            for number, point in enumerate(self.points)
            for i, name in enumerate(self.columns)
        ]
        return local_rows(self.labelled.sparkSession, rows, "cluster int, column string, center double")


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


def _packed(points: DataFrame) -> DataFrame:
    """``n, x``: the rows in blocks of up to ``PACK`` as bytes, which every pass hands to Python as they are."""

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([x.tobytes()], pa.binary())], ["n", "x"])

    return points.mapInArrow(pack, "n long, x binary")


def _spread(points: DataFrame, rows: int) -> DataFrame:
    """The blocks dealt evenly over the cluster: a table in few files or row groups would keep most cores idle in every pass."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    least, most = PARTS
    return points.repartition(max(1, min(-(-rows // least), cores), rows // most))


def _blocks(batches: Iterable[pa.RecordBatch], width: int = 1) -> Iterator[np.ndarray]:
    """The rows in steps, of which each needs ``width`` numbers a row."""
    step = max(64, min(PACK, CACHED // max(width, 1)))
    for batch in batches:
        for n, x in zip(batch.column("n").to_pylist(), batch.column("x"), strict=True):
            block = np.frombuffer(x.as_buffer()).reshape(n, -1)
            for at in range(0, n, step):
                yield block[at : at + step]


class Nearest:
    """The squared distances of rows to the centres of several tables, less the rows' own squares, and the least of each table.

    Larger tables come first, and the first centres of all tables are one layer, the second ones the next, so that a step of the
    work is one operation on all tables.
    """

    def __init__(self, tables: list[np.ndarray]):
        order = sorted(range(len(tables)), key=lambda i: -len(tables[i]))
        layers = [[tables[i][j] for i in order if len(tables[i]) > j] for j in range(len(tables[order[0]]))]
        stacked = np.array([center for layer in layers for center in layer])
        self.lifted = np.column_stack([-2 * stacked, (stacked * stacked).sum(axis=1)])
        self.starts = np.cumsum([0, *map(len, layers)])
        self.rank = np.argsort(order)  # of each table
        self.places = [self.starts[: len(t)] + rank for t, rank in zip(tables, self.rank, strict=True)]

    def __len__(self) -> int:
        return len(self.lifted)

    def __call__(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        layers = np.split(self.lifted @ np.vstack([x.T, np.ones(len(x))]), self.starts[1:-1])
        least = layers[0].copy()
        for layer in layers[1:]:
            np.minimum(least[: len(layer)], layer, out=least[: len(layer)])
        return layers, least


def _sums(points: DataFrame, tables: dict) -> dict[object, tuple[np.ndarray, float]]:
    """For each table of centres: the rows of each cluster and the sums of their columns, and the squared distances of all rows."""
    nearest = Nearest(list(tables.values()))
    width = nearest.lifted.shape[1]

    def work(batches):
        total, errors = np.zeros((len(nearest), width)), np.zeros((len(nearest.rank), width))
        for x in _blocks(batches, len(nearest)):
            layers, least = nearest(x)
            member = [layer == least[: len(layer)] for layer in layers]
            if sum(map(np.count_nonzero, member)) != least.size:  # a row between two centres goes to the first
                taken = np.zeros(least.shape, bool)
                for own in member:
                    own &= ~taken[: len(own)]
                    taken[: len(own)] |= own
            total += np.concatenate(member).astype(float) @ np.column_stack([np.ones(len(x)), x])
            errors[:, 0] += np.maximum(least + (x * x).sum(axis=1), 0.0).sum(axis=1)
        rows = np.vstack([total, errors])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float64()))], ["c", "v"])

    parts = points.mapInArrow(work, "c long, v array<double>")
    out = np.zeros((len(nearest) + len(tables), width))
    for row in parts.groupBy("c").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v")).collect():
        out[row["c"]] = row["v"]
    errors = out[len(nearest) :, 0][nearest.rank].tolist()
    return {key: (out[place], error) for key, place, error in zip(tables, nearest.places, errors, strict=True)}


def _mixed(h: np.ndarray) -> np.ndarray:
    """Numbers as if drawn at random from the hashes, the same for the same hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(x: np.ndarray) -> np.ndarray:
    """A hash of each row's values; zero has one sign."""
    h = np.zeros(len(x), np.uint64)
    for column in (x + 0.0).T:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(column).view(np.uint64))
    return h


def _draw(points: DataFrame, seeds: list[np.ndarray], round_: int, number: int) -> list[np.ndarray]:
    """For each start, ``number`` different rows, drawn without replacement with weights that are squared distances to its
    seeds (all alike if it has none): those of the smallest exponential draws."""
    starts, width = len(seeds), seeds[0].shape[1]

    salts = _mixed(np.array([s * 1009 + round_ + 1 for s in range(starts)], np.uint64))
    seeded = [s for s in range(starts) if len(seeds[s])]
    nearest = Nearest([seeds[s] for s in seeded]) if seeded else None
    far = np.array([(seeds[s] ** 2).sum(axis=1).max() for s in seeded])

    def work(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, width)))] * starts
        bound = np.full(starts, np.inf)
        for x in _blocks(batches, starts + sum(map(len, seeds))):
            u = (_mixed(_hashes(x) + salts[:, None]) >> np.uint64(11)).astype(float) + 0.5
            weights = np.ones((starts, len(x)))
            if seeded:
                own = (x * x).sum(axis=1)
                d = nearest(x)[1][nearest.rank] + own
                weights[seeded] = np.where(d > 1e-9 * (own + far[:, None] + 1.0), d, 0.0)
            keys = np.full(u.shape, np.inf)
            np.divide(-np.log(u / 2.0**53), weights, out=keys, where=weights > 0)
            drawn = (keys <= bound[:, None]) & (weights > 0)
            for s in np.flatnonzero(drawn.any(axis=1)):
                at = np.flatnonzero(drawn[s])
                key = keys[s, at]
                if len(key) > 4 * number:  # equal rows have equal draws, so look a little further
                    near = np.argpartition(key, 4 * number)[: 4 * number]
                    at, key = at[near], key[near]
                key, row = np.append(best[s][0], key), np.vstack([best[s][1], x[at]])
                _, first = np.unique(row, axis=0, return_index=True)
                order = first[np.argsort(key[first], kind="stable")][:number]
                best[s] = key[order], row[order]
                if len(order) == number:
                    bound[s] = best[s][0][-1]
        rows = [(s, k, r.tolist()) for s, (keys, found) in enumerate(best) for k, r in zip(keys.tolist(), found, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["s", "key", "v"])

    drawn = points.mapInArrow(work, "s long, key double, v array<double>")
    smallest = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct("key", "v")))), 1, number)
    found = {r["s"]: [x["v"] for x in r["best"]] for r in drawn.groupBy("s").agg(smallest.alias("best")).collect()}
    return [np.array(found.get(s, [])).reshape(-1, width) for s in range(starts)]


def _seeds(points: DataFrame, width: int, most: int, starts: int) -> dict[tuple[int, int], np.ndarray]:
    """Start centres for 2..``most`` clusters from oversampled seeds, for each of several starts."""
    if not starts:
        return {}
    seeds = _draw(points, [np.zeros((0, width))] * starts, 0, 1)
    for round_ in range(1, SEED_ROUNDS + 1):
        more = _draw(points, seeds, round_, 2 * most)
        seeds = [np.vstack([a, b]) for a, b in zip(seeds, more, strict=True)]
    weights = _sums(points, dict(enumerate(seeds)))
    return {
        (k, s): _reduced(found, weights[s][0][:, 0], k, np.random.default_rng([s, k]))
        for s, found in enumerate(seeds)
        for k in range(2, min(most, len(found)) + 1)
    }


def _reduced(seeds: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of weighted seeds: drawn one after the other by weight and squared distance, then averaged."""
    centers = seeds[[rng.choice(len(seeds), p=weights / weights.sum())]]
    while len(centers) < k:
        chance = weights * np.maximum(_distances(seeds, centers), 0.0).min(axis=1)
        if chance.sum() <= 0:  # only repeated seeds are left
            chance = np.ones(len(seeds))
        centers = np.vstack([centers, seeds[rng.choice(len(seeds), p=chance / chance.sum())]])
    for _ in range(20):
        member = (_distances(seeds, centers).argmin(axis=1)[:, None] == np.arange(k)) * weights[:, None]
        total = member.sum(axis=0)
        centers = np.where(total[:, None] > 0, member.T @ seeds / np.maximum(total, 1e-300)[:, None], centers)
    return np.round(centers, DIGITS)


def _first_centers(points: DataFrame, width: int, most: int) -> dict[int, np.ndarray]:
    """Start centres for 2..``most`` clusters, by splitting."""
    # A cluster is a box: lower bounds (exclusive) and upper bounds of each column.
    boxes = [(np.full(width, -np.inf), np.full(width, np.inf))]
    found: dict[int, np.ndarray] = {}
    while True:
        sums = _box_sums(points, boxes)
        n = np.maximum(sums[:, :1], 1)
        means = np.round(sums[:, 1 : width + 1] / n, DIGITS)
        spread = np.round(sums[:, width + 1 :] - n * means * means, 6)
        if len(boxes) > 1:
            found[len(boxes)] = means
        widest = int(spread.sum(axis=1).argmax())
        axis = int(spread[widest].argmax())
        if len(boxes) >= most or spread[widest, axis] <= 0:
            return found
        low, high = boxes[widest]
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = means[widest, axis]
        boxes[widest] = (low, left)
        boxes.append((right, high))


def _box_sums(points: DataFrame, boxes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows, sums and sums of squares of each box."""

    width = 2 * len(boxes[0][0]) + 1

    def work(batches):
        total = np.zeros((len(boxes), width))
        for x in _blocks(batches, len(boxes) + width):
            member = np.ones((len(boxes), len(x)), bool)
            for own, (low, high) in zip(member, boxes, strict=True):
                for axis, column in enumerate(x.T):
                    if low[axis] > -np.inf:
                        own &= column > low[axis]
                    if high[axis] < np.inf:
                        own &= column <= high[axis]
            total += member.astype(float) @ np.column_stack([np.ones(len(x)), x, x * x])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(boxes))), pa.array(list(total), pa.list_(pa.float64()))], ["c", "v"]
        )

    parts = points.mapInArrow(work, "c long, v array<double>").groupBy("c")
    sums = F.array(*[F.sum(F.col("v")[i]) for i in range(width)])
    return np.array([r["v"] for r in sorted(parts.agg(sums.alias("v")).collect(), key=lambda r: r["c"])])


def kmeans_search(df: DataFrame, max_k: int = MAX_K, starts: int = STARTS, cells: int = CELLS) -> Clustering | None:
    """Cluster all complete rows, standardised, for k = 2..``max_k`` and keep the k with the best silhouette.

    No row is sampled away. Each k keeps the best of ``starts`` seeded starts and the split one, which always runs to its end;
    seeded starts that fall behind end early. NULL is returned for fewer than
    two numeric columns or thirty complete rows, or if all rows are equal. The label stays on its row in ``labelled``.
    """
    columns = numeric_columns(df)
    if len(columns) < 2:
        return None
    complete = nan_to_null(df).dropna(how="any", subset=columns)
    shapes = per_column(
        complete,
        columns,
        lambda c: {
            "n": F.count(col(c)),
            "mean": F.avg(col(c).cast("double")),
            "std": F.stddev_samp(col(c).cast("double")),
        },
        "n bigint, mean double, std double",
    ).collect()
    by_name = {r["column"]: r for r in shapes}
    rows = shapes[0]["n"]
    if rows < MIN_ROWS:
        return None
    mean = [_steady(by_name[c]["mean"]) for c in columns]
    std = [_steady(by_name[c]["std"]) or 1.0 for c in columns]

    def standard(i: int) -> Column:
        return (col(columns[i]).cast("double") - F.lit(mean[i])) / F.lit(std[i])

    points = complete.select(*[standard(i).alias(f"x{i}") for i in range(len(columns))])
    points = _spread(_packed(points), rows).persist(StorageLevel.MEMORY_AND_DISK)
    width = len(columns)
    try:
        most = min(max_k, rows - 1)
        split = {(k, -1): table for k, table in _first_centers(points, width, most).items()}
        tried = _lloyd(points, split | (_seeds(points, width, most, starts) if split else {}))
        errors = {key: error for key, (_, error) in _sums(points, tried).items()} if tried else {}
        chosen = {key[0]: key for key in reversed(_ranked(errors))}
        centers = {k: tried[key] for k, key in sorted(chosen.items())}
        scores = _silhouettes(points, centers, cells, rows)
    finally:
        points.unpersist()
    if not scores:
        return None
    best = max(scores, key=lambda k: (round(scores[k][0], 6), -k))
    distances = [
        F.struct(sum((standard(i) - F.lit(float(x))) ** 2 for i, x in enumerate(c)).alias("d"), F.lit(number).alias("c"))
        for number, c in enumerate(centers[best])
    ]
    label = "cluster" if "cluster" not in df.columns else "cluster_label"
    return Clustering(
        columns=columns,
        scores=[(k, *scores[k]) for k in sorted(scores)],
        inertia={k: float(errors[chosen[k]]) for k in scores},
        best_k=best,
        silhouette=round(scores[best][0], 4),
        points=centers[best],
        mean=mean,
        std=std,
        label=label,
        labelled=complete.withColumn(label, F.array_min(F.array(*distances))["c"]),
    )


def _steady(value: float) -> float:
    """Twelve significant digits, which sums in any order agree on."""
    return float(f"{value:.12g}")


def _ranked(errors: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Starts by number of clusters and squared error; among equal ones, the split start and then the first."""
    return sorted(errors, key=lambda key: (key[0], float(f"{errors[key]:.9g}"), key[1]))


def _lloyd(points: DataFrame, centers: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Assign and average until the centres rest; a cluster that lost its rows keeps its place.

    After the rounds named in ``RACES``, only so many of the seeded starts of each k go on, those of the least error.
    """
    moving, rested = dict(centers), {}
    errors: dict[tuple[int, int], float] = {}
    for round_ in range(MAX_ITERATIONS):
        if round_ in RACES:
            for k in {k for k, _ in centers}:
                behind = [key for key in _ranked(errors) if key[0] == k and key[1] >= 0][RACES[round_] :]
                for key in behind:
                    moving.pop(key, None), rested.pop(key, None), errors.pop(key)
        if not moving:
            break
        for key, (table, error) in _sums(points, moving).items():
            filled = table[:, 0] > 0
            new = moving[key].copy()
            new[filled] = np.round(table[filled, 1:] / table[filled, :1], DIGITS)
            before, errors[key] = errors.get(key, np.inf), error
            slow = key[1] >= 0 and before - errors[key] < REST * errors[key]
            if slow or ((new - moving[key]) ** 2).sum() <= TOLERANCE:
                del moving[key]
                rested[key] = new
            else:
                moving[key] = new
    return rested | moving


def _cell_planes(sample: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Space cut into cells at medians of the sample: nodes of an axis, a cut and two children; leaves have axis -1."""
    nodes: list = [None]
    open_, leaves = [(0, sample, cells)], 0
    while open_:
        node, part, wanted = open_.pop()
        axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
        cut = float(np.median(part[:, axis])) if len(part) else 0.0
        left = part[:, axis] <= cut
        if wanted < 2 or not left.any() or left.all():
            nodes[node] = (-1, 0.0, leaves, leaves)
            leaves += 1
            continue
        nodes += [None, None]
        nodes[node] = (axis, cut, len(nodes) - 2, len(nodes) - 1)
        open_ += [(len(nodes) - 1, part[~left], wanted - wanted // 2), (len(nodes) - 2, part[left], wanted // 2)]
    return nodes


def _cell_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    axis, cut, low, high = (np.array(c) for c in zip(*nodes, strict=True))
    node = np.zeros(len(x), np.int64)
    while (inner := axis[node] >= 0).any():
        at = node[inner]
        node[inner] = np.where(x[inner, axis[at]] <= cut[at], low[at], high[at])
    return low[node]


def _silhouettes(points: DataFrame, centers: dict[int, np.ndarray], cells: int, rows: int) -> dict[int, tuple[float, float]]:
    """Mean silhouette of each k with at least two filled clusters, and the most that it can be off."""
    if not centers:
        return {}
    keys, width = list(centers), next(iter(centers.values())).shape[1]
    limit = np.uint64(min(1.0, CELL_SAMPLE / rows) * (2**64 - 2**11))

    def pick(batches):
        for x in _blocks(batches):
            found = x[_hashes(x) <= limit]
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["x"])

    parts = points.mapInArrow(pick, "x binary").toArrow().column("x")
    sample = np.frombuffer(b"".join(parts.to_pylist())).reshape(-1, width)
    nodes = _cell_planes(sample[np.lexsort(sample.T)], cells)

    def members(batches):
        found: dict[tuple[int, int, int], np.ndarray] = {}
        for x in _blocks(batches):
            cell = _cell_of(x, nodes)
            values = np.column_stack([np.ones(len(x)), x, (x * x).sum(axis=1)])
            for k in keys:
                pair = cell * k + _distances(x, centers[k]).argmin(axis=1)
                code, place = np.unique(pair, return_inverse=True)
                sums = np.column_stack([np.bincount(place, v, len(code)) for v in values.T])
                for c, row in zip(code.tolist(), sums, strict=True):
                    key = (k, c // k, c % k)
                    found[key] = found[key] + row if key in found else row
        if found:
            k, cell, cluster = (pa.array(c, pa.int64()) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [k, cell, cluster, pa.array(list(found.values()), pa.list_(pa.float64()))], ["k", "cell", "cluster", "v"]
            )

    sums = F.array(*[F.sum(F.col("v")[i]) for i in range(width + 2)]).alias("v")
    parts = points.mapInArrow(members, "k long, cell long, cluster long, v array<double>")
    parts = parts.groupBy("k", "cell", "cluster").agg(sums).collect()
    means, spreads, members_of = {}, {}, {}
    for k in keys:
        own = sorted((r for r in parts if r["k"] == k), key=lambda r: (r["cell"], r["cluster"]))
        v = np.array([r["v"] for r in own])
        count = np.zeros((len(own), k))
        count[np.arange(len(own)), [r["cluster"] for r in own]] = v[:, 0]
        if (count.sum(axis=0) > 0).sum() > 1:
            means[k] = v[:, 1:-1] / v[:, :1]
            spreads[k] = np.maximum(v[:, -1] / v[:, 0] - (means[k] ** 2).sum(axis=1), 0.0)
            members_of[k] = count
    # Where spread has no direction, this share of it lies across the line of sight and lengthens the distance.
    across = 1.0 - 1.0 / width

    def one(a: np.ndarray, b: np.ndarray, alone: np.ndarray) -> float:
        top = np.maximum(a, b)
        return float(np.where(alone | (top <= 0), 0.0, (b - a) / np.where(top > 0, top, 1.0)).sum())

    def scored(batches):
        total = np.zeros((len(keys), 3))
        for x in _blocks(batches, max(map(len, means.values()), default=1)):
            for i, k in enumerate(keys):
                if k not in means:
                    continue
                n = members_of[k].sum(axis=0)
                labels = _distances(x, centers[k]).argmin(axis=1)
                squared = np.maximum(_distances(x, means[k]), 0.0)
                low = np.sqrt(squared) @ members_of[k]
                high = np.sqrt(squared + spreads[k]) @ members_of[k]
                middle = low + across * (high - low)
                row, alone = np.arange(len(x)), n[labels] <= 1
                ends = []
                for part in (low, middle, high):
                    own = part[row, labels] / np.maximum(n[labels] - 1, 1)
                    other = np.where(n > 0, part / np.maximum(n, 1), np.inf)
                    other[row, labels] = np.inf
                    ends.append((own, other.min(axis=1)))
                (a0, b0), (a, b), (a1, b1) = ends
                total[i] += one(a1, b0, alone), one(a, b, alone), one(a0, b1, alone)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), *(pa.array(c) for c in total.T)], ["k", "low", "middle", "high"]
        )

    totals = points.mapInArrow(scored, "k long, low double, middle double, high double").groupBy("k")
    found = {}
    for r in totals.agg(*[(F.sum(c) / rows).alias(c) for c in ("low", "middle", "high")]).collect():
        if r["k"] in means:
            found[r["k"]] = (r["middle"], max(r["high"] - r["middle"], r["middle"] - r["low"]))
    return found
