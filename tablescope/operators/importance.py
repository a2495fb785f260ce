"""Which columns tell most about a target, or vary most when there is no target."""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tablescope.plans.columns import (
    col,
    families,
    flat_columns,
    kind_of,
    local_rows,
    nan_to_null,
    numeric_columns,
    schema_rows,
    string_columns,
)
from tablescope.plans.neighbours import BLOCK, Planes, digamma
from tablescope.plans.passes import class_summary, moments, text_key
from tablescope.plans.quantiles import exact_quantiles

# Functions of this module travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 20
NEIGHBOURS = 3
MAX_TARGET_CLASSES = 20
MIN_ROWS = 20


def _as_number(df: DataFrame, name: str) -> Column:
    if kind_of(df.schema[name].dataType) == "datetime":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, col(name).cast("timestamp_ntz")).cast("double")
    return col(name).cast("double")


def _binned(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Numeric columns replaced by a bin number; two values share a bin when the same cut points lie below them.

    The bucketizer closes its intervals at the lower end, so values and cut points enter with opposite sign.
    """
    names = list(cuts)
    inputs, outputs = [f"__v{i}" for i in range(len(names))], [f"__b{i}" for i in range(len(names))]
    infinity = float("inf")
    splits = [[-infinity, *sorted({-c for c in cuts[n]}), infinity] for n in names]
    signed = df.withColumns({i: -_as_number(df, n) for i, n in zip(inputs, names)})
    bucketed = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs).transform(signed)
    return bucketed.withColumns({n: F.col(o).cast("int") for n, o in zip(names, outputs)}).drop(*inputs, *outputs)


def mutual_information(df: DataFrame, target: str, bins: int = BINS, digits: int = 4) -> DataFrame | None:
    """``feature, score, score_corrected, position`` of ``target_information``."""
    found = target_information(df, target, bins, digits)
    return None if found is None else found[1]


def target_information(
    df: DataFrame, target: str, bins: int = BINS, digits: int = 4
) -> tuple[str, DataFrame] | None:
    """Plug-in mutual information of every other column with the target, in nats, best first, and the method name.

    Text is taken as it is; numbers and times are cut at their exact quantiles into ``bins`` groups, and so is a
    numeric target with more than twenty values (regression). Rows with any gap are left out. NULL is returned when
    fewer than twenty rows are left, or when there is no other column. ``score_corrected`` takes off the bias that
    many cells on few rows bring (Miller and Madow).

    This is another estimator than nearest neighbours on a row sample: the scores differ, clear signals rank alike.

    With S = sum of c*ln(c) over the counts of a grouping, the information is ln(n) + (S_xy - S_x - S_y) / n, so one
    count table per cell is enough; no join and no window over it is needed.
    """
    features = [c for c in flat_columns(df) if c != target]
    if not features:
        return None
    positions = schema_rows(df).select(F.col("column").alias("feature"), "position")
    df = nan_to_null(df).select(*[col(c) for c in [*features, target]]).dropna(how="any")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    rows, n_unique = _target_facts(df, target)
    if rows < MIN_ROWS:
        return None
    classification = is_classification(df, target, n_unique)
    cut = [c for c in features if kinds[c] in ("numeric", "datetime")]
    if not classification:
        cut.append(target)
    numbers = df.select(*[_as_number(df, c).alias(c) for c in cut])
    points = [i / bins for i in range(1, bins)]
    cuts = {
        r["column"]: sorted(set(list(r)[1:])) for r in exact_quantiles(numbers, cut, points).collect()
    }

    def key(name: str) -> Column:
        return col(name) if name in cuts else text_key(col(name).cast("string"))

    binned = _binned(df, cuts) if cuts else df
    keyed = binned.select(key(target).alias("__y"), *[key(c).alias(c) for c in features])
    cells = reduce(DataFrame.unionByName, [_cells(keyed, family) for family in families(keyed, features)])
    feature, x, y = F.col("feature"), F.col("x"), F.col("__y")
    levels = cells.groupingSets([[feature, x, y], [feature, x], [feature, y]], feature, x, y).agg(
        F.sum("c").alias("n"), F.grouping_id().alias("level")
    )
    weight = F.col("n") * F.ln(F.col("n").cast("double"))
    joint, of_x, of_y = (F.col("level") == i for i in (0, 1, 2))

    def total(level: Column) -> Column:
        return F.sum(F.when(level, weight).otherwise(F.lit(0.0)))

    n = F.lit(float(rows))
    information = F.ln(n) + (total(joint) - total(of_x) - total(of_y)) / n
    bias = (F.count_if(joint) - F.count_if(of_x) - F.count_if(of_y) + 1) / (2 * n)
    ranked = (
        levels.groupBy("feature")
        .agg(
            F.round(F.greatest(information, F.lit(0.0)), digits).alias("score"),
            F.round(information - bias, digits).alias("score_corrected"),
        )
        .join(positions, "feature")
        .orderBy(F.desc("score"), "position")
    )
    return f"mutual_info_{'classif' if classification else 'regression'}", ranked


def neighbour_information(
    df: DataFrame, target: str, neighbours: int = NEIGHBOURS, digits: int = 4, block: int = BLOCK
) -> tuple[str, DataFrame] | None:
    """Nearest-neighbour mutual information of every other column with the target, in nats, best first, and the method.

    All complete rows take part. Numbers and times are continuous, in units of their standard deviation; text and booleans
    are discrete, and so is a target that is no number or has at most twenty values. Two continuous columns: with ``r`` the
    distance (the larger difference) to a row's third neighbour and ``c`` the rows within ``r`` on one axis, itself included, the
    information is psi(n) + psi(k) - mean psi(c_x) - mean psi(c_y). A continuous and a discrete one: ``r`` is the distance to
    the third neighbour of the same class (or the last, if there are fewer), and the information is psi(n) + mean psi(k) -
    mean psi(class size) - mean psi(c), over rows whose class has two rows or more. Two discrete ones: from their counts.

    Ties: equal points are at distance zero, and no noise is added. Rows at the radius itself are not within it, and neither
    are those that miss it by a billionth of it; if the radius is zero, the equal rows are. NULL is returned as by
    ``target_information``; rows with infinite numbers are left out as rows with gaps are.
    """
    features = [c for c in flat_columns(df) if c != target]
    if not features:
        return None
    positions = {c: i for i, c in enumerate(df.columns)}
    df = nan_to_null(df).select(*[col(c) for c in [*features, target]]).dropna(how="any")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema}
    continuous = [c for c in [*features, target] if kinds[c] in ("numeric", "datetime")]
    numbers = {c: _as_number(df, c) for c in continuous}
    for number in numbers.values():
        df = df.filter(F.abs(number) < float("inf"))
    rows, n_unique = _target_facts(df, target)
    if rows < MIN_ROWS:
        return None
    classification = is_classification(df, target, n_unique)
    spread = df.agg(F.count("*").alias("n"), *[F.stddev_pop(numbers[c]).alias(c) for c in continuous]).first()
    unit = {c: float(f"{spread[c]:.12g}") or 1.0 for c in continuous}

    def axis(name: str) -> Column:
        # Zero has one sign, so that equal values are one point.
        return numbers[name] / F.lit(unit[name]) + F.lit(0.0)

    def label(name: str) -> Column:
        # A class as a number: its own value, or 52 bits of its hash, which a double holds.
        if name in numbers:
            return numbers[name] + F.lit(0.0)
        return F.shiftrightunsigned(F.xxhash64(col(name).cast("string")), 12).cast("double")

    discrete_features = [c for c in features if c not in numbers]
    if classification:
        pairs = {c: (axis(c), label(target)) for c in features if c in numbers}
    else:
        pairs = {c: (axis(target), label(c)) for c in discrete_features}
    scores = _one_axis(df, pairs, neighbours, block)
    if classification and discrete_features:
        counted = target_information(df.select(*[col(c) for c in [*discrete_features, target]]), target, digits=12)
        scores |= {r["feature"]: r["score"] for r in counted[1].collect()}
    if not classification:
        scores |= _two_axes(df, {c: (axis(c), axis(target)) for c in features if c in numbers}, spread["n"], neighbours, block)
    found = [(c, round(max(0.0, scores.get(c, 0.0)), digits), positions[c]) for c in features]
    found.sort(key=lambda r: (-r[1], r[2]))
    ranked = local_rows(df.sparkSession, found, "feature string, score double, position int")
    return f"mutual_info_{'classif' if classification else 'regression'}", ranked


def _points(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``f, x, y, w``: the different points of each pair of axes, with the number of their rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("f"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(pairs.values())])
    return df.select(F.explode(rows).alias("p")).select("p.*").groupBy("f", "x", "y").agg(F.count("*").alias("w"))


def _two_axes(df: DataFrame, pairs: dict, rows: int, k: int, block: int) -> dict[str, float]:
    """Information of pairs of continuous columns."""
    if not pairs:
        return {}
    k = min(k, rows - 1)
    planes = Planes(_points(df, pairs).withColumn("need", F.lit(k).cast("long")), False, block)
    try:
        radii = planes.radii(k)
        mean = {}
        for side in ("x", "y"):
            values = planes.points.groupBy("f", F.col(side).alias("v")).agg(F.sum("w").alias("n"))
            mean[side] = planes.mean_digamma(side, values, radii)
    finally:
        planes.close()
    start = float(digamma(rows) + digamma(k))
    return {c: start - (mean["x"][i] + mean["y"][i]) / rows for i, c in enumerate(pairs)}


def _one_axis(df: DataFrame, pairs: dict, k: int, block: int) -> dict[str, float]:
    """Information of pairs of a continuous column (first) and a discrete one."""
    if not pairs:
        return {}
    points = _points(df, pairs)
    sizes = points.groupBy("f", "y").agg(F.sum("w").alias("size")).filter("size > 1")
    need = F.least(F.lit(k).cast("long"), F.col("size") - 1)
    planes = Planes(points.join(sizes, ["f", "y"]).select("f", "x", "y", "w", need.alias("need")), True, block)

    def weigh(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            psi = [size * digamma(n) for n in (size.clip(max=k + 1) - 1, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("f"), batch.column("size"), *map(pa.array, psi)], ["f", "n", "of_k", "of_size"]
            )

    try:
        total = sizes.select("f", "size").mapInArrow(weigh, "f int, n long, of_k double, of_size double").groupBy("f")
        total = {r["f"]: r for r in total.agg(*[F.sum(c).alias(c) for c in ("n", "of_k", "of_size")]).collect()}
        values = planes.points.groupBy("f", F.col("x").alias("v")).agg(F.sum("w").alias("n"))
        near = planes.mean_digamma("x", values, planes.radii(k)) if total else {}
    finally:
        planes.close()
    return {
        c: float(digamma(t["n"])) + (t["of_k"] - t["of_size"] - near[i]) / t["n"]
        for i, c in enumerate(pairs)
        if (t := total.get(i))
    }


def _cells(keyed: DataFrame, features: list[str]) -> DataFrame:
    """``feature, x, __y, c``: how often each value of a feature meets each value of the target."""
    return (
        keyed.unpivot([F.col("__y")], [col(c) for c in features], "feature", "x")
        .groupBy("feature", "x", "__y")
        .agg(F.count("*").alias("c"))
        .withColumn("x", F.col("x").cast("string"))
    )


def _target_facts(df: DataFrame, target: str) -> tuple[int, int]:
    """The rows with a target, and its different values; a number of more than ``MAX_TARGET_CLASSES`` only says that there are more.

    Tasks send a few values each, so a target of very many values is not counted by value.
    """
    kind = df.schema[target].dataType
    if kind_of(kind) != "numeric":  # a classification whatever the number
        return df.filter(col(target).isNotNull()).count(), 0
    values_type = to_arrow_type(kind)
    most = MAX_TARGET_CLASSES + 2  # zero may come with two signs

    def work(batches):
        rows, seen = 0, set()
        for batch in batches:
            values = batch.column(0).drop_null()
            rows += len(values)
            if len(seen) < most:
                seen.update(values.unique()[:most].to_pylist())
        found = list(seen)[:most]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows] + [0] * len(found)), pa.array([None, *found], values_type)], ["n", "value"]
        )

    parts = df.select(col(target).alias("value")).mapInArrow(work, f"n long, value {kind.simpleString()}").collect()
    return sum(r["n"] for r in parts), len({r["value"] for r in parts} - {None})


def is_classification(df: DataFrame, target: str, n_unique: int) -> bool:
    return kind_of(df.schema[target].dataType) != "numeric" or n_unique <= MAX_TARGET_CLASSES


def variance_entropy_rank(df: DataFrame, variance_digits: int = 6, entropy_digits: int = 4) -> DataFrame:
    """Numeric columns by variance over squared mean, text columns by entropy in bits, in one list."""
    df = nan_to_null(df)
    mean, variance = F.col("mean"), F.col("variance")
    spread = F.when(mean != 0, variance / (mean * mean)).otherwise(variance)
    numbers = moments(df, numeric_columns(df)).select(
        F.col("column").alias("feature"), F.round(spread, variance_digits).alias("score"), F.lit("variance").alias("basis")
    )
    n = F.col("n_nonnull").cast("double")
    entropy = F.log2(n) - F.col("sum_c_log2_c") / n
    texts = class_summary(df, string_columns(df)).select(
        F.col("column").alias("feature"),
        F.round(F.greatest(entropy, F.lit(0.0)), entropy_digits).alias("score"),
        F.lit("entropy").alias("basis"),
    )
    positions = schema_rows(df).select(F.col("column").alias("feature"), "position")
    return numbers.unionByName(texts).join(positions, "feature").orderBy(F.desc("score"), "position")


def feature_importance(
    df: DataFrame, target: str | None = None, bins: int = BINS, estimator: str = "bins"
) -> DataFrame:
    """``method, target_used, feature, score, position``: information about the target if there is a usable one,
    else variance and entropy. The ``estimator`` of the information is ``bins`` or ``neighbours``."""
    if estimator not in ("bins", "neighbours"):
        raise ValueError(f"estimator is 'bins' or 'neighbours', not {estimator!r}")
    if target and target in flat_columns(df):
        found = target_information(df, target, bins) if estimator == "bins" else neighbour_information(df, target)
        if found is not None:
            method, ranked = found
            return ranked.select(
                F.lit(method).alias("method"), F.lit(target).alias("target_used"), "feature", "score", "position"
            )
    return variance_entropy_rank(df).select(
        F.lit("variance_entropy").alias("method"),
        F.lit(None).cast("string").alias("target_used"),
        "feature",
        "score",
        "position",
    )
