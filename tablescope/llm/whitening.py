"""Embedding whitening by QDWH spectral divide-and-conquer.

The covariance of the distinct vectors is summed up in tasks as one ``d x d`` matrix each, added row by row. Its leading
eigenvectors come from spectral divide-and-conquer: the polar factor of the shifted covariance (by the QR-based,
dynamically weighted Halley iteration) is the matrix sign, half of one plus the sign projects on the invariant subspace
above the shift, and each of the two subspaces is split again in its own coordinates until a component stands alone. Only
subspaces that can hold one of the wanted components are split. The components, ``d`` numbers each, are broadcast, and one
pass whitens every row.

What passes through the driver is one ``d x d`` matrix, bounded by the number of dimensions and not by rows.

Defined results: rows whose vector is null, is empty, holds null, NaN or infinite entries, or entries outside
``+-2**54`` (256 times which must fit a long) are dropped; so are vectors of another length than the most frequent
(ties: the longest). Repeated rows stay, one set of result rows each, and count once in the fit, as do equal vectors of
different ids. Ids may be null and may repeat. A component of variance zero (fewer distinct vectors than components, or one alone) has null
``whitened`` and takes no part in ``identity_error``, which is null if there is no other; ``explained`` is null if all vectors are
equal. A deviation that does not fit a long is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.llm.common import share, staged

COMPONENTS = 4
SCALE = 256
LARGEST = float(2**54)
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix: its sign; None if it is singular in double precision."""
    x = a / np.linalg.norm(a)
    one = np.eye(len(a))
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return None
    if not low > 4 * EPS:
        return None
    for _ in range(30):
        # Weights of the Halley step that are best for singular values between low and 1.
        t = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + t) + 0.5 * np.sqrt(8 - 4 * t + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + t)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
        top, bottom = q[: len(a)], q[len(a) :]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (top @ bottom.T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if moved < len(a) * 1e-12:
            break
    return x if np.abs(x @ x - one).max() < 1e-8 else None


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are one."""
    k = len(a)
    diagonal = np.diag(a)
    if np.linalg.norm(a - np.diag(diagonal)) <= EPS * scale and np.ptp(diagonal) <= EPS * scale:
        return None
    mean, spread = diagonal.mean(), np.linalg.norm(a - np.eye(k) * diagonal.mean()) / np.sqrt(k)
    rng = np.random.default_rng(k)
    shifts = [np.median(diagonal), mean, *(mean + spread * np.array([0.1, -0.1, 0.3, -0.3, 0.6, -0.6, 0.03, -0.03]))]
    for shift in shifts:
        sign = polar(a - shift * np.eye(k))
        if sign is None:
            continue
        above = (np.eye(k) + sign) / 2
        rank = round(np.trace(above))
        if not 0 < rank < k:
            continue
        # A projector times a random matrix spans its range; a second step and a joint QR make the bases orthogonal.
        upper, _ = np.linalg.qr(above @ rng.standard_normal((k, rank)))
        lower, _ = np.linalg.qr((np.eye(k) - above) @ rng.standard_normal((k, k - rank)))
        basis, _ = np.linalg.qr(np.hstack([above @ upper, lower - above @ lower]))
        return basis[:, :rank], basis[:, rank:]
    return None


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a covariance and their unit eigenvectors as columns."""
    scale = float(np.linalg.norm(v))
    found: list[tuple[float, np.ndarray]] = []
    open_ = [np.eye(len(v))] if scale else []
    while open_ and len(found) < count:
        basis = open_.pop()
        part = basis.T @ v @ basis
        part = (part + part.T) / 2
        split = halves(part, scale) if len(part) > 1 else None
        if split:
            open_ += [basis @ split[1], basis @ split[0]]
        else:  # one component, or several of equal variance, for which every basis is one
            found += [(float(part[i, i]), basis[:, i]) for i in np.argsort(-np.diag(part))]
    found = sorted(found[:count], key=lambda x: -x[0])
    vectors = np.array([w / np.linalg.norm(w) for _, w in found]).reshape(-1, len(v)).T
    values = np.array([max(e, 0.0) for e, _ in found])
    flip = [1.0 if w[np.argmax(np.abs(w))] >= 0 else -1.0 for w in vectors.T]
    values, vectors = np.append(values, np.zeros(min(count, len(v)) - len(values))), vectors * np.array(flip)
    return values, np.hstack([vectors, np.zeros((len(v), len(values) - vectors.shape[1]))])


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(rows: DataFrame) -> list[np.ndarray]:
    """Matrices of ``rows`` (task, i, values) added over tasks; the driver receives one row for each ``i``."""

    def add(table: pa.Table) -> pa.Table:
        wide = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        total = wide[np.argsort(table.column("task").to_numpy())].sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    total = rows.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    return [np.array(r.v) for r in sorted(total, key=lambda r: r.i)]


def _gram(df: DataFrame, project, d: int) -> np.ndarray:
    """Sum of outer products of ``project(x)`` over the rows of ``df``."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch, "x", d))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            k = len(total)
            arrays = [
                pa.array([TaskContext.get().partitionId()] * k, pa.int32()),
                pa.array(range(k), pa.int32()),
                pa.array(list(total), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["task", "i", "v"])

    found = _added(df.select("x").mapInArrow(run, "task int, i int, v array<double>"))
    return np.array(found)


def entries(vector: Column) -> Column:
    """The vector as longs; null unless every entry is there, finite and in range."""
    inside = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return F.when(inside & (F.size(vector) > 0), whole)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row for each kept row of ``vectors`` and each of its first ``components`` components."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), entries(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    out = T.StructType(
        [rows.schema["vec_id"], T.StructField("component", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("n", "deviation")]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], out)
    d = size.d
    rows = rows.filter(F.size("x") == d)
    fit = staged(rows.select("x").distinct(), "vectors")

    def sums(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch, "x", d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))],
            ["n", "high", "low"],
        )

    # The halves of the sums are added as decimals: exact whatever the number of rows.
    parts = fit.mapInArrow(sums, "n long, high array<long>, low array<long>")
    n = parts.agg(F.sum("n")).first()[0]
    exploded = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "p"))
    added = exploded.groupBy("i").agg(*[F.sum(F.col(f"p.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    total = [int(r.high) * 2**32 + int(r.low) for r in added.orderBy("i").collect()]
    mean = np.array([s / n for s in total])

    covariance = _gram(fit, lambda x: x - mean, d) / n
    values, basis = leading(covariance, components)
    trace = float(np.trace(covariance))
    live = values > d * EPS * max(trace, 0.0)
    scaled = basis[:, live] / np.sqrt(values[live])
    error = None
    if live.any():
        again = _gram(fit, lambda x: (x - mean) @ scaled, d) / n
        error = float(np.abs(again - np.eye(len(again))).max())
    model = share(spark, (np.array(total, object), mean, scaled, live))
    explained = [float(e) / trace if trace > 0 else None for e in values]
    k = len(values)

    def work(batches):
        total, mean, scaled, live = model()
        for batch in batches:
            x = _matrix(batch, "x", d)
            if not len(x):
                continue
            widest = n * int(np.abs(x).max()) + max(abs(s) for s in total)
            exact = np.int64 if d * widest**2 < 2**63 else object
            gaps = x.astype(exact) * n - total.astype(exact)
            far = [int(v) if v < 2**63 else None for v in (gaps * gaps).sum(axis=1).tolist()]
            z = np.full((len(x), k), np.nan)
            z[:, live] = (x - mean) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)),
                    pa.array([v for v in far for _ in range(k)], pa.int64()),
                    pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * (len(x) * k), pa.float64()),
                ],
                out.fieldNames(),
            )

    return rows.mapInArrow(work, out)
