"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X are made orthogonal without any task seeing more than its own rows: a
pass sums the Gram matrix of X (or of X solved against the triangles found so far), the
driver factors it, and the triangles are composed: X = Q R. The first Gram matrix gets a
small shift, so that its factor exists even when columns nearly depend on each other; two
more passes at least bring Q to orthogonality at working precision. The singular values and
right vectors of R, a matrix as small as the vectors are long, are those of X.

Centring is exact: entries are whole numbers, so ``n x - S`` is one, and products of large
sums never meet. Sums of matrices go through a fixed number of tasks; the driver sees a few
megabytes at most, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scale and offset of the whole numbers, and the size from which an entry is no exact whole number any more.
SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**53
#: Bytes of partial matrices that come to the driver at once, and the tasks that add them up at most.
DRIVER_BYTES, ADDERS = 32 << 20, 64
#: Passes after the shifted one: at least, at most, and the distance from orthogonality that ends them.
LEAST_PASSES, MOST_PASSES, NEAR = 2, 8, 1e-13
#: Singular values below this part of the greatest are zero.
NULL_PART = 1e-12


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` with whole-number entries, for vectors without null or non-finite entries."""
    c = F.col(vector_col).cast("array<double>")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(MOST / SCALE)))
    whole = F.when(c.isNotNull() & good, F.transform(c, lambda e: F.floor(e * SCALE) + F.lit(OFFSET)))
    return rows.select(F.col(id_col).alias("vec_id"), whole.alias("v")).where("v is not null")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The whole numbers of a batch's vectors as rows."""
    return np.asarray(column.flatten()).reshape(len(column), d)


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices of rows ``task, m``: first in a bounded number of tasks, then on the driver."""
    n = max(1, min(ADDERS, DRIVER_BYTES // (8 * shape[0] * shape[1])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column("m"):
                x = np.frombuffer(m.as_py(), np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    few = parts.repartition(n, "task").mapInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r.m, np.float64) for r in few), np.zeros(shape[0] * shape[1])).reshape(shape)


def gram(rows: DataFrame, sums: list[int], n: int, width: int, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after ``step`` (to ``width`` columns): a partial matrix per task, then their sum."""
    d = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((width, width))
        for batch in batches:
            x = step(centred(_matrix(batch.column("v"), d), sums, n)[0])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "m"])

    return _added(rows.select("v").mapInArrow(partial, "task long, m binary"), (width, width))


def centred(v: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, list[int | None]]:
    """``v - S/n`` as doubles, and the exact sum of ``(n v - S)^2`` for every row (null beyond a BIGINT)."""
    most = max((abs(s) for s in sums), default=0) + n * (int(np.abs(v).max()) if v.size else 0)
    if most < 1 << 62:
        whole = v * n - np.array(sums, np.int64)
        x = whole / n
        largest = int(np.abs(whole).max()) if whole.size else 0
        if largest * largest * max(1, v.shape[1]) < 1 << 63:
            return x, (whole * whole).sum(1).tolist()
        whole = whole.astype(object)
    else:
        whole = v.astype(object) * n - np.array(sums, object)
        x = np.array([[int(e) / n for e in row] for row in whole], np.float64).reshape(v.shape)
    exact = [int(sum(e * e for e in row)) for row in whole.tolist()]
    return x, [e if e < 1 << 63 else None for e in exact]


def upper(g: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(g).T


def solved(x: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """Rows solved against one triangle after the other."""
    for r in triangles:
        x = np.linalg.solve(r.T, x.T).T
    return x


def triangle(rows: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """The triangle R of the centred rows by shifted CholeskyQR; columns that are constant throughout get zeros."""
    d = len(sums)
    out = np.zeros((d, d))
    g = gram(rows, sums, n, d, lambda x: x)
    live = np.flatnonzero(np.diag(g) > 0)
    m = len(live)
    if not m:
        return out
    scale = np.sqrt(np.diag(g)[live])
    g = g[np.ix_(live, live)] / np.outer(scale, scale)  # columns of length one, so that the shift suits all of them
    shift = 11 * (n * m + m * (m + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    triangles = [upper(g + min(shift, 1e-8) * np.eye(m))]
    for k in range(MOST_PASSES):
        g = gram(rows, sums, n, m, lambda x, rs=tuple(triangles): solved(x[:, live] / scale, rs))
        off = np.abs(g - np.eye(m)).max()
        try:
            triangles.append(upper(g))
        except np.linalg.LinAlgError:  # dependent columns: a direction has no length left, and a shift keeps the triangle regular
            triangles.append(upper(g + 1e-12 * np.linalg.norm(g, 2) * np.eye(m)))
        if k + 1 >= LEAST_PASSES and off < NEAR * max(1.0, np.sqrt(n)):
            break
    r = np.eye(m)
    for t in triangles:
        r = t @ r
    out[:m, live] = r * scale
    return out


def components(rows: DataFrame, sums: list[int], n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening matrix (vector length by components), eigenvalues and explained parts, by falling eigenvalue."""
    _, s, w = np.linalg.svd(triangle(rows, sums, n))
    e = s**2 / n
    total = e.sum()
    w, e = w[:most].T, e[:most]
    sign = np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])]) if w.size else np.ones(0)
    w = w * np.where(sign == 0, 1, sign)
    null = s[:most] <= NULL_PART * max(s[0], 1e-300) if len(s) else np.zeros(0, bool)
    e = np.where(null, 0.0, e)
    white = w / np.sqrt(np.where(null, np.nan, e))
    return white, e, (e / total if total > 0 else np.full(len(e), np.nan))


def whitened(rows: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component with its whitened coordinate.

    Vectors are used when they have no null and no non-finite entry, none too large for an
    exact whole number (2^47), and the length of most of them (the greater length on a
    tie). Directions in which no row differs have eigenvalue 0: ``explained`` is 0 (null if
    no direction has more), ``whitened`` null, and they don't count in ``identity_error``
    (0 if none is left). ``deviation`` is null beyond a BIGINT. Null and repeated ids have
    rows of their own; no usable vector gives no rows; other columns are not looked at.
    """
    spark = rows.sparkSession
    good = usable(rows, id_col, vector_col)
    kind = dict(good.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None or length.d == 0:
        return spark.createDataFrame([], schema)
    d, n = length.d, length["count"]
    good = good.where(F.size("v") == d)
    totals = good.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    sums = [int(s) for _, s in sorted((r.i, r.s) for r in totals)]
    white, e, part = components(good, sums, n, most)
    live = np.flatnonzero(~np.isnan(white).any(0)) if white.size else np.zeros(0, int)
    error = float(np.abs(gram(good, sums, n, len(live), lambda x: x @ white[:, live]) / n - np.eye(len(live))).max()) if len(live) else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, deviation = centred(_matrix(batch.column("v"), d), sums, n)
            z = x @ np.nan_to_num(white)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["vec_id", "deviation", "z"])

    wide = good.mapInArrow(project, f"vec_id {kind}, deviation long, z array<double>")
    known = F.array(*[F.lit(None if np.isnan(p) else float(p)).cast("double") for p in part])
    null = F.array(*[F.lit(bool(k not in set(live.tolist()))) for k in range(len(part))])
    long = wide.select("vec_id", "deviation", F.posexplode("z").alias("k", "z"))
    return long.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(~F.get(null, "k"), F.col("z")).alias("whitened"), F.get(known, "k").alias("explained"), F.lit(error).alias("identity_error"),
    )
