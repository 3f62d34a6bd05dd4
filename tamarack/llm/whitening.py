"""Embedding whitening by mixed-precision refinement (operator 12).

Entries are put on a grid of integers; each different vector counts once. Spark counts them, sums every dimension and the
products of every two dimensions. What the driver gets is d * d numbers, whatever the rows (d up to ``MOST_DIMENSIONS``).
There the covariance's eigenvectors are found in float32 and corrected by matrix multiplications in extended precision
(T. Ogita and K. Aishima, "Iterative refinement for symmetric eigenvalue decomposition", 2018, and its second part on
clustered eigenvalues, 2019): each round makes the columns orthonormal and parts those whose eigenvalues lie further
apart than the error of the round; columns whose eigenvalues lie closer are a cluster, within which a small shifted
problem is solved. A further pass measures the covariance of the whitened rows themselves.

The sums are of whole numbers and exact, so a task that runs again, or rows in another order, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from tamarack.llm.common import release, table
from tamarack.llm.decontamination import free_name
from tamarack.operators.storage import drop, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MOST_DIMENSIONS = 2_048
#: Distances from the mean below this, squared and summed over a block of rows, are exact in doubles.
SMALL = 1 << 20
#: Entries from here on have no place on the grid in 64 bits.
LARGEST = float(1 << 56)
_BLOCK = 4_096


def on_grid(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of every entry c, as longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors with entries, all of them finite and smaller than 2 ** 56."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


@dataclass
class Whitening:
    """What is learned of ``n`` different vectors: whole means and what remains of them in n-ths, components in columns."""

    n: int
    dimensions: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n to the last bit but one."""
        return (x - self.whole).astype(np.float64) - self.rest.astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S) squared over the dimensions of each row, exact."""
        near = x - self.whole
        most = int(np.abs(near).max(initial=0))
        if most * max(most, self.n) * self.dimensions >= 1 << 62:
            near = near.astype(object)
        squares, cross = (near * near).sum(axis=1).tolist(), (near * self.rest).sum(axis=1).tolist()
        last = sum(int(r) ** 2 for r in self.rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, cross)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of ascending ``values`` that lie within ``width`` of a neighbour, by run."""
    order = np.argsort(values)
    runs = np.split(order, np.flatnonzero(np.diff(values[order]) > width) + 1)
    return [r for r in runs if len(r) > 1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in extended precision, by products of doubles that are exact.

    Rows of ``a`` and columns of ``b`` are cut into slices of so few bits that a sum of products of two slices fits a
    double (the scheme of K. Ozaki and others, 2012); three slices of each hold what a long double does.
    """
    bits = (53 - max(1, a.shape[1] - 1).bit_length()) // 2

    def slices(m: np.ndarray, axis: int) -> tuple[list[np.ndarray], np.ndarray]:
        scale = np.exp2(np.ceil(np.log2(np.maximum(np.abs(m).max(axis=axis, keepdims=True), np.longdouble(1e-300)))))
        left, out = m / scale, []
        for k in range(1, 4):
            unit = np.longdouble(2) ** (bits * k)
            part = np.rint(left * unit) / unit
            out.append(part.astype(np.float64))
            left = left - part
        return out, scale

    (rows, of_rows), (columns, of_columns) = slices(a, 1), slices(b, 0)
    total = sum((rows[i] @ columns[j]).astype(np.longdouble) for i, j in ((2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)))
    return total * of_rows * of_columns


def refine(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors of the symmetric ``a`` in extended precision, from approximate ``x``."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    size, eye, eps = norm(a), np.eye(len(a), dtype=np.longdouble), float(np.finfo(np.longdouble).eps)
    values = np.diag(a)
    for _ in range(rounds):
        r, s = eye - product(x.T, x), product(x.T, product(a, x))
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        width = 2 * (norm(s - np.diag(values)) + size * norm(r)) + 4 * len(a) * eps * size
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > width
        # half of r makes the columns orthonormal; the rest is a turn, exactly antisymmetric, so that what rounding does to
        # it where a gap is small can't undo that
        turn = np.where(apart, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(apart, gap, 1), 0)
        x = x + product(x, turn + r / 2)
        moved = float(max(np.abs(turn * gap).max(initial=0) / size, np.abs(r).max(initial=0)))
        for c in _clusters(values, width):
            own = x[:, c]
            middle = values[c].mean()
            small = product(own.T, product(a, own) - middle * own)
            if float(np.abs(small - np.diag(np.diag(small))).max()) > 8 * len(a) * eps * size:
                # the shift leaves differences alone, which doubles hold to their last digits
                x[:, c] = product(own, np.linalg.eigh(((small + small.T) / 2).astype(np.float64))[1].astype(np.longdouble))
                moved = max(moved, 1e-3)  # what was turned is refined again
        if moved < 8 * eps * len(a):
            break
    for _ in range(2):
        x = x + product(x, eye - product(x.T, x)) / 2
    return values, x


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, their largest entry positive) to double precision."""
    size = np.abs(covariance).max(initial=0)
    if not size:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    scaled = covariance.astype(np.longdouble) / size
    values, x = refine(scaled, np.linalg.eigh(scaled.astype(np.float32))[1])
    order = np.argsort(-values, kind="stable")
    values, x = values[order] * size, x[:, order]
    x = x / np.sqrt((x * x).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1, 1)
    return values.astype(np.float64), x.astype(np.float64)


def _blocks(batch: pa.RecordBatch, at: int, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch in parts of ``_BLOCK`` rows with their grid vectors as a matrix."""
    for first in range(0, batch.num_rows, _BLOCK):
        part = batch.slice(first, _BLOCK)
        yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimensions)


def _summed(fit: DataFrame, dimensions: int, columns: int, of, exact: bool) -> np.ndarray:
    """Sums over ``fit`` of ``of(x)``, a matrix with ``columns`` columns for a block of rows, put together by Spark."""
    kind, python = ("long", np.int64) if exact else ("double", np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _blocks(batch, 0, dimensions):
                found = np.asarray(of(x), dtype=python)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.from_numpy_dtype(python)))], names=["i", "v"])
        release()

    parts = fit.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    got = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)") if exact else F.col("v")).alias("v")).toArrow()
    rows = 1 + max(got.column("i").to_pylist(), default=-1)
    out = np.zeros((rows, columns), dtype=object if exact else np.float64)
    values = [int(v) for v in got.column("v").to_pylist()] if exact else got.column("v").to_numpy()
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = values
    return out


def _covariance(fit: DataFrame, n: int, whole: np.ndarray, rest: np.ndarray, most: int) -> np.ndarray:
    """The covariance with divisor n; ``most`` bounds the distance of an entry from its whole mean."""
    d = len(whole)
    if most < SMALL and n * most * most < 1 << 62:
        near = lambda x: (x - whole).astype(np.float64)
        step = max(1, (1 << 53) // max(1, most * most))

        def products(x: np.ndarray) -> np.ndarray:
            y = near(x)
            return sum((y[i : i + step].T @ y[i : i + step]).astype(np.int64) for i in range(0, len(y), step))

        exact = n * _summed(fit, d, d, products, True) - np.multiply.outer(rest.astype(object), rest.astype(object))
        parts, left = exact // (n * n), exact % (n * n)
        return parts.astype(np.float64).astype(np.longdouble) + (left / (n * n)).astype(np.float64)
    middle = rest.astype(np.float64) / n

    def centred(x: np.ndarray) -> np.ndarray:
        y = (x - whole).astype(np.float64) - middle
        return y.T @ y

    return _summed(fit, d, d, centred, False).astype(np.longdouble) / n


def fit(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """Learn the whitening of the different grid vectors of ``vectors``; None where there is no vector.

    Vectors of another length than the commonest (of equally common ones the least) are no part of it. Components of no
    variance, which can't be brought to one, are left out.
    """
    good = vectors.select(F.col(vector_col).alias("v")).where(usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d = sizes[0]["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; {MOST_DIMENSIONS} are the most")
    distinct = written(good.where(F.size("v") == d).select(on_grid(F.col("v")).alias("x")).distinct(), "grid")
    # sums of the upper and the lower halves of numbers are exact, and so are extremes
    halves = lambda x: np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
    high, low = _summed(distinct, d, d, halves, True)
    n = distinct.count()
    sums = [int(h) * (1 << 32) + int(v) for h, v in zip(high, low)]
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    ends = distinct.agg(F.min(F.array_min("x")).alias("a"), F.max(F.array_max("x")).alias("b")).first()
    most = max(int(ends["b"]) - int(whole.min()), int(whole.max()) - int(ends["a"])) + 1
    covariance = _covariance(distinct, n, whole, rest, most)
    values, vectors_ = eigen(covariance)
    k = int(np.count_nonzero(values[:components] > d * 1e-15 * max(values[0], 0)))
    model = Whitening(n, d, whole, rest, values[:k], vectors_[:, :k], (values[:k] / float(np.trace(covariance))) if k else values[:0])
    if k:
        own = _summed(distinct, d, k, lambda x: (w := model.whitened(x)).T @ w, False) / n
        model.identity_error = float(np.abs(own - np.eye(k)).max())
    drop(distinct)
    return model


def whiten(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` that the model can take, with their columns, ``deviation`` and ``whitened``; narrow.

    ``deviation`` is the sum of (n x - S) squared, a decimal of 38 digits, null beyond; ``whitened`` has a number for each
    component. Vectors that are null or empty, hold null or non-finite entries or such of 2 ** 56 and more, or have
    another length than the model's, have no row. Repeated rows and null ids give a row each; an empty table, or no
    model, gives none. Columns of the two names stay: the new ones then get an underscore.
    """
    grid, deviation, name = (free_name(vectors.columns, c) for c in ("grid", "deviation", "whitened"))
    schema = StructType([*vectors.schema.fields, StructField(deviation, DecimalType(38, 0)), StructField(name, ArrayType(DoubleType()))])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = vectors.where(usable(F.col(vector_col)) & (F.size(vector_col) == model.dimensions)).withColumn(grid, on_grid(F.col(vector_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, batch.num_columns - 1, model.dimensions):
                far = pa.array([Decimal(v) if v < 10**38 else None for v in model.deviations(x)], pa.decimal128(38, 0))
                out = model.whitened(x)
                offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], far, lists], names=schema.names)
        release()

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    rows = whiten(vectors, model).select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in (model.explained if model else [])), F.lit(0.0))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
