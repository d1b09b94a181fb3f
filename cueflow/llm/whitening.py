"""Whitening of embeddings on their leading principal components.

Vectors are taken as whole numbers x = floor(64 c) + 1000000, so sums are exact. Three passes over
the table, each by partial results of a task that Spark adds up:

1. number of rows and sums by dimension, as whole numbers;
2. the covariance, of entries centred before they are multiplied;
3. the projection, with the mean and the components in every task (d x 32 numbers, whatever the
   number of rows), and the covariance of what came out.

The eigenvectors are worked out from the d x d covariance: Householder reflections to a tridiagonal
matrix, bisection with Sturm counts for the leading eigenvalues, inverse iteration for their vectors,
orthogonalised again within clusters of close eigenvalues, and the reflections in reverse.

Rows whose vector is null or has a null, infinite or NaN entry are left out, and so are vectors of
another length than the most frequent one (of equally frequent ones the largest). Directions without
variance (an eigenvalue below `LEAST_SHARE` of their sum) have no component, so equal rows, a single
row or an empty table give no rows. Repeated rows count as often as they come; a null id is kept.
Entries beyond `MOST` count as `MOST`; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.session import settle

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Largest whole number taken for an entry.
MOST = 1 << 52
#: Share of the total variance below which a direction counts as having none.
LEAST_SHARE = 1e-10
#: Tasks that add up the partial rows of one row of a matrix.
FAN = 16
#: Rows taken at once within a task.
ROWS_AT_ONCE = 4096


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Whole-number vectors of a batch: (rows, dims) int64."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def whole_vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the rows that count, whatever their length."""
    entries = F.col(vector_col)
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                    & (F.abs(c.cast("double")) < float("inf")))
    # clipped as doubles, so that the cast to long never overflows
    whole = lambda c: (F.greatest(F.lit(-float(MOST)), F.least(
        F.lit(float(MOST)), c.cast("double") * SCALE)))
    return embeddings.filter(entries.isNotNull() & good & (F.size(entries) > 0)).select(
        F.col(id_col).alias("__id"),
        F.transform(entries, lambda c: F.floor(whole(c)).cast("long") + OFFSET).alias("x"))


def _sums(rows: DataFrame) -> DataFrame:
    """(length, dim, n, total): rows and exact sums by length of vector and dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            lengths = np.diff(x.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                own = _matrix(x.filter(pa.array(lengths == d)), d)
                # in two halves, so that no sum of a task leaves 64 bits
                parts = [(own >> 26).sum(0).tolist(), (own & ((1 << 26) - 1)).sum(0).tolist()]
                n, high, low = held.get(d, (0, [0] * d, [0] * d))
                held[d] = (n + len(own), [a + b for a, b in zip(high, parts[0], strict=True)],
                           [a + b for a, b in zip(low, parts[1], strict=True)])
        for d, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()),
                 pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                ["length", "dim", "n", "high", "low"])

    wide = "decimal(38,0)"
    return (
        rows.select("x").mapInArrow(run, "length int, dim int, n long, high long, low long")
        .groupBy("length", "dim").agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("high").cast(wide)) * F.lit(1 << 26).cast("decimal(10,0)")
             + F.sum(F.col("low").cast(wide))).cast(wide).alias("total")))


def _added(partial: DataFrame) -> DataFrame:
    """Rows (i, v array<double>) added up by i: within `FAN` groups of each i, then all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                total[i] = total[i] + v if i in total else v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()),
             pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "v"])

    fields = "i int, v array<double>"
    first = partial.repartition("i", F.pmod(F.col("part"), F.lit(FAN))).select("i", "v")
    return first.mapInArrow(run, fields).repartition("i").mapInArrow(run, fields)


def _gram(rows: DataFrame, centred) -> DataFrame:
    """(i, v): row i of the sum of y y' over the rows y that `centred` makes of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                y = centred(batch.slice(at, ROWS_AT_ONCE))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()),
                 pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    partial = rows.mapInArrow(run, "i int, v array<double>")
    return _added(partial.withColumn("part", F.spark_partition_id()))


def _as_matrix(rows: DataFrame, size: int) -> np.ndarray:
    """A small matrix by rows (i, v); `size` squared numbers come to the driver."""
    out = np.zeros((size, size))
    for row in rows.collect():
        out[row.i] += row.v
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, subdiagonal, reflections): a = Q T Q' with Q the product of I - 2 u u'."""
    a = a.copy()
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1:, k]
        u = x.copy()
        scale = np.abs(x[1:]).max(initial=0)
        if scale:
            length = np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max()
            u[0] += length if u[0] >= 0 else -length
            u /= np.linalg.norm(u)
            p = a[k + 1:, k + 1:] @ u
            q = p - (u @ p) * u
            a[k + 1:, k + 1:] -= 2 * (np.outer(u, q) + np.outer(q, u))
            a[k + 1, k] = -length if x[0] >= 0 else length
            a[k + 2:, k] = 0
        else:
            u[:] = 0  # already tridiagonal here
        reflections.append(u)
    return a.diagonal().copy(), np.array([a[k + 1, k] for k in range(d - 1)]), reflections


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of `at`."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    floor = max(least, np.finfo(float).eps * (np.abs(off).max(initial=0)) ** 2 * 1e-30)
    q = diag[0] - at
    count = (q < 0).astype(int)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < floor, np.where(q < 0, -floor, floor), q)
        q = diag[i] - at - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The `many` largest eigenvalues, falling, by bisection to the last bits."""
    d = len(diag)
    around = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    wanted = d - np.arange(many)  # the wanted-th smallest
    low = np.full(many, (diag - around).min())
    high = np.full(many, (diag + around).max())
    reach = max(abs(low[0]), abs(high[0])) * np.finfo(float).eps
    low, high = low - 2 * reach - 1e-300, high + 2 * reach + 1e-300
    # down to the rounding of the counts themselves
    while (high - low > np.maximum(max(reach * 1e-2, 4e-300), 2 * np.finfo(float).eps * np.abs(low))).any():
        mid = low + (high - low) / 2
        below = sturm_counts(diag, off, mid) >= wanted
        high, low = np.where(below, mid, high), np.where(below, low, mid)
    return low + (high - low) / 2


def _solve(diag: np.ndarray, off: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """(T - value) x = b by elimination with row exchanges."""
    d = len(diag)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0))
    tiny = norm * np.finfo(float).eps or np.finfo(float).tiny
    main, upper, second, x = diag - value, np.append(off, 0.0), np.zeros(d), b.copy()
    main = main.copy()
    for i in range(d - 1):
        below = off[i]
        if abs(below) > abs(main[i]):  # rows i and i + 1 change places
            main[i], below = below, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = (upper[i + 1], 0.0) if i + 1 < d - 1 else (0.0, 0.0)
            x[i], x[i + 1] = x[i + 1], x[i]
        if main[i] == 0:
            main[i] = tiny
        factor = below / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        x[i + 1] -= factor * x[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    x[-1] /= main[-1]
    if d > 1:
        x[-2] = (x[-2] - upper[-2] * x[-1]) / main[-2]
    for i in range(d - 3, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1] - second[i] * x[i + 2]) / main[i]
    return x


def tridiagonal_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of falling `values`, by inverse iteration.

    Vectors of a cluster (values closer than a thousandth of the norm) are made orthogonal to those
    before them after every step; values that agree are moved apart a little for the solution only.
    """
    d = len(diag)
    norm = max(np.abs(diag).max(initial=0), np.abs(off).max(initial=0)) or 1.0
    draw = np.random.default_rng(11)
    out = np.zeros((d, len(values)))
    start, used = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            start = k
        shift = value
        if used is not None and used - shift < 4 * np.finfo(float).eps * norm:
            shift = used - 4 * np.finfo(float).eps * norm
        used = shift
        x = draw.standard_normal(d)
        for step in range(6):
            x = _solve(diag, off, shift, x / np.abs(x).max())
            for _ in range(2):
                x -= out[:, start:k] @ (out[:, start:k].T @ x)
            x /= np.linalg.norm(x)
            rest = diag * x - value * x
            rest[:-1] += off * x[1:]
            rest[1:] += off * x[:-1]
            if step and np.abs(rest).max() < 4 * np.finfo(float).eps * norm:
                break
        out[:, k] = x
    return out


def leading_components(covariance: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the `many` largest eigenvalues of a symmetric matrix."""
    size = np.abs(covariance).max(initial=0)
    if not size:
        return np.zeros(min(many, len(covariance))), np.eye(len(covariance))[:, :many]
    scaled = covariance / size
    diag, off, reflections = tridiagonal((scaled + scaled.T) / 2)
    values = leading_values(diag, off, min(many, len(diag)))
    vectors = tridiagonal_vectors(diag, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(u, u @ vectors[k + 1:])
    return values * size, vectors


def _centre(n: int, sums: np.ndarray):
    """Batches to centred doubles: x - S/n with the whole part taken first, so nothing is lost."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return lambda vectors: (_matrix(vectors, len(whole)) - whole).astype(float) - rest


def _deviation(n: int, sums: list[int], x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2; in 64 bits where these suffice for the batch."""
    most = max([abs(n * int(v) - s) for s, lo, hi in zip(sums, x.min(0), x.max(0), strict=True)
                for v in (lo, hi)])
    if n * (int(np.abs(x).max()) + 1) < 1 << 62 and most * most * x.shape[1] < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    many: int = COMPONENTS,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that counts.

    One row for each component, from 1 by falling variance, at most `many`.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    fields = (f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    rows = whole_vectors(embeddings, id_col, vector_col)
    totals = settle(_sums(rows), "whitening-sums")
    frequent = totals.groupBy("length").agg(F.max("n").alias("n")).orderBy(
        F.desc("n"), F.desc("length")).first()
    if frequent is None:
        return spark.createDataFrame([], fields)
    dims, n = frequent.length, frequent.n
    sums = [int(r.total) for r in totals.filter(F.col("length") == dims).orderBy("dim").collect()]
    rows = settle(rows.filter(F.size("x") == dims), "whitening-rows")
    centre = _centre(n, sums)
    covariance = _as_matrix(
        _gram(rows.select("x"), lambda batch: centre(batch.column(0))), dims) / n
    values, vectors = leading_components(covariance, many)
    total = float(np.trace(covariance))
    used = int((values > LEAST_SHARE * total).sum())
    if not used:
        return spark.createDataFrame([], fields)
    shares, project = (values / total)[:used], vectors[:, :used] / np.sqrt(values[:used])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(_deviation(n, sums, _matrix(part.column(1), dims)), pa.int64()),
                     pa.array(list(centre(part.column(1)) @ project), pa.list_(pa.float64()))],
                    ["__id", "deviation", "w"])

    white = settle(rows.mapInArrow(run, f"__id {kind}, deviation long, w array<double>"), "whitened")
    # centred too, though its mean is nearly zero: by the covariance's own definition
    means = white.select(F.posexplode("w").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("m"))
    mean = np.zeros(used)
    for row in means.collect():
        mean[row.i] = row.m

    def flat(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, used) - mean

    spread = _as_matrix(_gram(white.select("w"), flat), used) / n
    error = float(np.abs(spread - np.eye(used)).max())
    share = F.array(*(F.lit(float(s)) for s in shares))
    return white.select(
        F.col("__id").alias(id_col), "deviation", F.posexplode("w").alias("i", "whitened")
    ).select(
        id_col, (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(share, F.col("i") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))
