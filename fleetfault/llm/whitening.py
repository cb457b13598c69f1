"""Whitening of embeddings by their leading principal components, found by spectrum slicing.

* Entries become whole numbers ``x = floor(256 c)``.  A row counts only if its vector and all
  its entries are there and finite.  The fit list is each different vector once, however often
  it is repeated; it is written once and read for the sums, the covariance and the check.
* Sums are exact.  The covariance is summed from centred vectors, one ``d x d`` block per task;
  blocks are added row by row.  Only ``d * d`` numbers reach the driver: they depend on the
  dimension, not on the data.
* Eigenvalues: the pivots of an LDL' factorisation of ``V - s I`` have as many positive signs
  as V has eigenvalues above s.  Bisection on s isolates the k-th, Rayleigh quotient iteration
  inside the interval converges cubically, and two more counts on either side of the result
  certify that it is number k.  Eigenvalues equal to rounding share an interval; their vectors
  are made orthogonal one after the other.

Vectors need one length: the most frequent (of ties the longer); rows with another can not be
projected and are left out.  Components whose eigenvalue is zero to rounding can not be scaled
to unit variance and are left out, so a table of equal vectors, or none, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfault.session import scratch_folder

SCALE = 256
COMPONENTS = 4
_EPS = float(np.finfo(float).eps)


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of an
    LDL' factorisation of ``matrix - shift I`` with one- and two-row pivots (complete pivoting)."""
    a = matrix - shift * np.eye(len(matrix))
    positive, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        off = np.abs(a)
        diagonal = off.diagonal().copy()
        np.fill_diagonal(off, 0)
        r, largest = int(diagonal.argmax()), off.max()
        if diagonal[r] >= alpha * largest:
            pivot = a[r, r]
            if pivot == 0:
                break  # all that is left is zero
            positive += pivot > 0
            rest = np.delete(np.arange(len(a)), r)
            column = a[rest, r]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:  # a two-row pivot has one eigenvalue of each sign
            pair = list(np.unravel_index(int(off.argmax()), off.shape))
            positive += 1
            rest = np.delete(np.arange(len(a)), pair)
            columns = a[np.ix_(rest, pair)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(pair, pair)], columns.T)
        a = (a + a.T) / 2
    return int(positive)


class Spectrum(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # one column each
    counts: list  # of each value: eigenvalues above it plus and minus a rounding error


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float, known: np.ndarray) -> np.ndarray:
    """One inverse iteration, orthogonal to the vectors found before."""
    try:
        w = np.linalg.solve(matrix - shift * np.eye(len(matrix)), v)
    except np.linalg.LinAlgError:
        w = np.linalg.solve(matrix - (shift + 4 * _EPS * scale) * np.eye(len(matrix)), v)
    if not np.isfinite(w).all():
        w = v
    w = w / np.abs(w).max()
    for _ in range(2):
        w = w - known @ (known.T @ w)
    return w / np.linalg.norm(w)


def slice_spectrum(matrix: np.ndarray, k: int) -> Spectrum:
    """The ``k`` largest eigenvalues of a symmetric positive semidefinite matrix, as far as they exceed
    rounding, with unit vectors whose largest entry is positive."""
    d, scale = len(matrix), float(np.abs(matrix).sum(axis=1).max(initial=0))  # no eigenvalue exceeds it
    noise = 16 * _EPS * d * scale
    seen = {-scale - 1.0: d, scale * (1 + _EPS) + noise: 0}
    values, vectors, counts = [], np.zeros((d, 0)), []

    def count(at: float) -> int:
        if at not in seen:
            seen[at] = eigenvalues_above(matrix, at)
        return seen[at]

    for number in range(1, min(k, d) + 1):
        if scale == 0 or count(noise) < number:
            break  # zero to rounding
        low = max(at for at, above in seen.items() if above >= number)
        high = min(at for at, above in seen.items() if above < number)
        v = np.random.default_rng(number).standard_normal(d)
        v -= vectors @ (vectors.T @ v)
        while True:
            alone = count(low) == number and count(high) == number - 1
            narrow = high - low <= noise
            if alone or narrow:
                middle, w = (low + high) / 2, v
                for _ in range(3):
                    w = _solve(matrix, middle, w, scale, vectors)
                value = float(w @ matrix @ w)
                for _ in range(12):  # Rayleigh quotient iteration, cubic
                    if narrow or not low < value < high:
                        break
                    if np.linalg.norm(matrix @ w - value * w) <= 4 * _EPS * scale:
                        break
                    w = _solve(matrix, value, w, scale, vectors)
                    value = float(w @ matrix @ w)
                residual = float(np.linalg.norm(matrix @ w - value * w))
                error = max(noise, 2 * residual)
                if residual <= noise and low - noise <= value <= high + noise:
                    certified = (count(value + error), count(value - error))
                    if certified[0] < number <= certified[1]:
                        break
                if narrow:
                    raise ArithmeticError(f"eigenvalue {number} is not certified: residual {residual}, counts {certified}")
            middle = (low + high) / 2
            if count(middle) >= number:
                low = middle
            else:
                high = middle
        w = w * np.sign(w[int(np.abs(w).argmax())])
        values.append(value)
        vectors = np.column_stack([vectors, w])
        counts.append(certified)
    return Spectrum(np.array(values), vectors, counts)


class Whitening(NamedTuple):
    """``n`` different vectors, exact sums of each dimension, the leading spectrum of their covariance and its trace."""

    n: int
    sums: list
    spectrum: Spectrum
    trace: float


def _whole(column: pa.Array, scale: int) -> tuple[np.ndarray, list, list]:
    """Of the rows of a list column that are whole and finite: row, length, and ``floor(scale * entry)`` as bytes."""
    ends = np.asarray(column.offsets)
    entries = np.floor(scale * np.asarray(column.values.cast(pa.float64()).fill_null(np.nan))) + 0
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (odd[ends[1:]] == odd[ends[:-1]]))
    top = float(2**63)  # beyond whole numbers of 64 bits: the nearest, as a cast does
    inside = np.nan_to_num(np.clip(entries, -top, np.nextafter(top, 0))).astype("<i8")
    data = np.where(entries >= top, 2**63 - 1, inside).astype("<i8").tobytes()
    return rows, (ends[rows + 1] - ends[rows]).tolist(), [data[8 * ends[r] : 8 * ends[r + 1]] for r in rows.tolist()]


def whole_vectors(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``(id, d, x)`` of the rows whose vector counts; ``x`` holds ``d`` 64-bit numbers as bytes."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, found = _whole(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(lengths, pa.int32()), pa.array(found, pa.binary())],
                names=["id", "d", "x"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).mapInArrow(
        coded, "id long, d int, x binary"
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _spread(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """``n * x - S``, exactly: as 64-bit numbers where they fit, else as Python's."""
    wide = n * max(np.abs(x.astype(float)).max(initial=0), 1) + max((abs(s) for s in sums), default=0)
    if wide < 2.0**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    spread = _spread(x, n, sums)
    return np.array(spread / n, np.float64) if spread.dtype == object else spread / float(n)


def _added(blocks: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' matrices ``(i, row)``, added row by row; ``rows x d`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(row)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "row"]
            )

    rows = {r.i: np.frombuffer(r.row) for r in blocks.repartition("i").mapInArrow(add, "i int, row binary").collect()}
    return np.array([rows[i] for i in sorted(rows)]).reshape(len(rows), d)


def _blocks(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], names=["i", "row"]
        )


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame | None]:
    """The whitening of ``whole_vectors`` and its written fit list; ``(None, None)`` where there is no vector."""
    spark = vectors.sparkSession
    lengths = vectors.where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None, None
    d = lengths.d
    path = f"{scratch_folder(spark)}/fit"
    vectors.where(F.col("d") == d).select("x").distinct().write.parquet(path)
    listed = spark.read.schema("x binary").parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # High and low halves apart, so that no sum leaves 64 bits.
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"]
            )

    parts = listed.mapInArrow(sums, "i int, n long, high long, low long").groupBy("i")
    rows = sorted(parts.agg(*[F.sum(name).alias(name) for name in ("n", "high", "low")]).collect())
    n, total = rows[0].n, [(r.high << 32) + r.low for r in rows]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            y = _centred(_matrix(batch.column(0), d), n, total)
            block = y.T @ y if block is None else block + y.T @ y
        yield from _blocks(block)

    covariance = _added(listed.mapInArrow(products, "i int, row binary"), d) / n
    covariance = (covariance + covariance.T) / 2
    return Whitening(n, total, slice_spectrum(covariance, components), float(np.trace(covariance))), listed


def _projection(fitted: Whitening) -> np.ndarray:
    return fitted.spectrum.vectors / np.sqrt(fitted.spectrum.values)


def identity_error(listed: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, k = len(fitted.sums), len(fitted.spectrum.values)
    projection = _projection(fitted)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            w = _centred(_matrix(batch.column(0), d), fitted.n, fitted.sums) @ projection
            here = np.vstack([w.T @ w, w.sum(axis=0)])
            block = here if block is None else block + here
        yield from _blocks(block)

    total = _added(listed.mapInArrow(products, "i int, row binary"), k) / fitted.n
    # The mean is zero to rounding: what is taken off here is its square.
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue)`` for each row
    that counts and each component; ``deviation`` is null where it exceeds 64 bits (from some eight
    million different unit vectors on).  Repeated rows and null ids are projected like any other.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    vectors = whole_vectors(df, id_column, vector_column, scale)
    fitted, listed = fit(vectors, components)
    if fitted is None or not len(fitted.spectrum.values):
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(listed, fitted)
    d, k, projection = len(fitted.sums), len(fitted.spectrum.values), _projection(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            spread = _spread(x, fitted.n, fitted.sums)
            if spread.dtype == object or np.abs(spread).max(initial=0) >= (2**62 / d) ** 0.5:
                exact = [sum(int(s) ** 2 for s in row) for row in spread]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            else:
                deviation = pa.array((spread * spread).sum(axis=1))
            w = _centred(x, fitted.n, fitted.sums) @ projection
            row = np.repeat(np.arange(len(x)), k)
            across = lambda values: pa.array(np.tile(values, len(x)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), across(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(row), fitted.n)),
                 deviation.take(pa.array(row)), pa.array(w.ravel()), across(fitted.spectrum.values / fitted.trace),
                 pa.array(np.full(len(row), error)), across(fitted.spectrum.values)],
                names=[part.split()[0] for part in schema.split(", ")])

    return vectors.where(F.col("d") == d).select("id", "x").mapInArrow(project, schema)
