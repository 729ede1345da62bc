"""Embedding whitening: projections on the covariance's eigenvectors, each brought to unit variance.

Integer vectors are centred exactly (``n * x - S`` in integers), multiplied in each task and summed; the covariance,
one number per pair of dimensions, is all that reaches the driver. There eigenvectors found in single precision are
corrected by matrix multiplications in extended precision (Ogita and Aishima); eigenvalues that lie too close for
that are separated by solving for the few directions of their cluster alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from goodsledger.llm.common import ID, id_type, in_arrow, quoted

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Scaled components beyond this count as this.
MOST = 1 << 40
CHUNK, STEPS, SETTLED = 2048, 12, 1e-17
#: Eigenvalues nearer than this, against the matrix's norm, are separated within their cluster.
CLOSE = 1e-10
WIDE = np.longdouble


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id and x of the rows whose vector has finite components only and the length of the smallest id's."""

    def whole(c):
        floors = F.floor(F.lit(float(SCALE)) * F.greatest(F.least(c, F.lit(1e15)), F.lit(-1e15)))
        return F.greatest(F.least(floors, F.lit(MOST)), F.lit(-MOST)) + F.lit(SHIFT)

    rows = vectors.select(F.col(quoted(id_col)).alias(ID), F.col(quoted(vec_col)).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    size = F.size("v")
    wanted = rows.agg(F.coalesce(F.min(F.when(F.col(ID).isNotNull(), F.struct(ID, size.alias("size"))))["size"], F.min(size)).alias("size")).first()["size"]
    return rows.where(size == F.lit(wanted)).select(ID, F.transform("v", whole).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def chunks(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            yield batch.slice(start, CHUNK)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the sum of each dimension, as Python integers."""

    def run(batches):
        sums, n = None, 0
        for part in chunks(batches):
            found = matrix(part.column("x")).sum(0)
            sums, n = (found if sums is None else sums + found), n + part.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(sums) + 1)), "total": pa.array(np.append(sums, n))})

    parts = in_arrow(rows, run, "place long, total long")
    found = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    values = [int(row["total"]) for row in found]
    return (values[-1], np.array(values[:-1], dtype=object)) if values else (0, np.array([], dtype=object))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they hold it, Python's else."""
    largest = max(int(np.abs(x).max(initial=0)), 1) * n + max(map(abs, sums), default=0)
    if largest < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squared_lengths(z: np.ndarray) -> pa.Array:
    """Sums of squares per row; null where a long does not hold them."""
    largest = int(np.abs(z).max(initial=0))
    if largest * largest * max(z.shape[1], 1) < 1 << 62:
        return pa.array((z.astype(np.int64) ** 2).sum(1))
    exact = [sum(int(v) * int(v) for v in row) for row in z]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def covariance(rows: DataFrame, n: int, sums: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor ``n``) of the centred vectors, or of their projections by ``weights``."""
    sent = rows.sparkSession.sparkContext.broadcast((sums, weights))

    def run(batches):
        sums, weights = sent.value
        total = None
        for part in chunks(batches):
            y = (deviations(matrix(part.column("x")), n, sums) / n).astype(np.float64)
            y = y if weights is None else y @ weights
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"place": pa.array(i * len(total) + j), "total": pa.array(total[i, j])})

    cells = in_arrow(rows, run, "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    width = len(sums) if weights is None else weights.shape[1]
    found = np.zeros((width, width))
    for row in cells:
        i, j = divmod(row["place"], width)
        found[i, j] = found[j, i] = row["total"] / n
    return found


def length(values: np.ndarray):
    return np.sqrt((values * values).sum())


def rayleigh(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the vectors lack in orthogonality, the matrix in their coordinates, and the eigenvalues."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    return r, s, np.diag(s) / (1 - np.diag(r))


def clusters(a, r, s, values) -> np.ndarray:
    """Number of each eigenvalue's cluster: neighbours closer than the present error, or than ``CLOSE``, share one."""
    limit = np.maximum(2 * (length(s - np.diag(values)) + length(a) * length(r)), CLOSE * length(a))
    order = np.argsort(values)
    numbers = np.empty(len(values), dtype=np.int64)
    numbers[order] = np.cumsum(np.append(0, np.diff(values[order]) > limit))
    return numbers


def corrected(x, r, s, values, cluster) -> tuple[np.ndarray, float]:
    """Corrected vectors and the largest change. Within a cluster only orthogonality is mended."""
    gap = values[None, :] - values[:, None]
    same = cluster[:, None] == cluster[None, :]
    change = np.where(same, r / 2, (s + values[None, :] * r) / np.where(same, 1, gap))
    return x + x @ change, float(np.abs(change).max())


def separated(a: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Directions of one cluster: the eigenvectors of ``a``, less the cluster's mean value, within their span."""
    basis = x[:, at]
    inner = basis.T @ (a @ basis)
    inner -= np.eye(len(at), dtype=WIDE) * np.trace(inner) / len(at)
    scale = np.abs(inner).max()
    if not scale:
        return basis
    small = ((inner + inner.T) / (2 * scale)).astype(np.float64)
    return basis @ np.linalg.eigh(small)[1].astype(WIDE)


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    scale = np.abs(v).max(initial=0.0)
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    a = v.astype(WIDE) / WIDE(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    for _ in range(STEPS):
        r, s, values = rayleigh(a, x)
        cluster = clusters(a, r, s, values)
        crowded = np.flatnonzero(np.bincount(cluster) > 1)
        for number in crowded:
            at = np.flatnonzero(cluster == number)
            x[:, at] = separated(a, x, at)
        if len(crowded):
            r, s, values = rayleigh(a, x)
        x, change = corrected(x, r, s, values, cluster)
        if change < SETTLED:
            break
    x /= np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


def whitened_vectors(vectors: DataFrame, id_col="vec_id", vec_col="embedding", *, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another length than the smallest id's, or holds a null or non-finite entry
    are left out. Null ids and repeated rows take part like any other. Vectors of fewer dimensions give as many
    components; a component without variance is 0 everywhere and stays out of ``identity_error``. A ``deviation``
    that no long holds is null. An empty table gives no rows.
    """
    rows = integer_vectors(vectors, id_col, vec_col)
    schema = T.StructType.fromDDL(
        f"{ID} {id_type(rows)}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    n, sums = totals(rows)
    values, directions = eigen(covariance(rows, n, sums)) if n else (np.zeros(0), np.zeros((0, 0)))
    kept = min(components, len(values))
    trace = values.sum()
    some = values[:kept] > trace * len(values) * np.finfo(float).eps if n else np.zeros(0, bool)
    weights = np.where(some, directions[:, :kept] / np.sqrt(np.where(some, values[:kept], 1.0)), 0.0)
    off = covariance(rows, n, sums, weights) - np.diag(some.astype(float)) if some.any() else np.zeros((1, 1))
    error, explained = float(np.abs(off).max()), np.where(some, values[:kept] / (trace or 1.0), 0.0)
    sent = rows.sparkSession.sparkContext.broadcast((sums, weights, explained))

    def run(batches):
        sums, weights, explained = sent.value
        kept = len(explained)
        kinds = to_arrow_schema(schema)
        for part in chunks(batches):
            z = deviations(matrix(part.column("x")), n, sums)
            size = len(z)
            rows = pa.array(np.repeat(np.arange(size), kept))
            made = {
                ID: part.column(ID).take(rows),
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), size),
                "n": np.full(size * kept, n),
                "deviation": squared_lengths(z).take(rows),
                "whitened": ((z / n).astype(np.float64) @ weights).reshape(-1),
                "explained": np.tile(explained, size),
                "identity_error": np.full(size * kept, error),
            }
            yield pa.RecordBatch.from_arrays([pa.array(made[k.name], k.type) if k.name != ID else made[ID] for k in kinds], names=kinds.names)

    return in_arrow(rows, run, schema).withColumnRenamed(ID, id_col)
