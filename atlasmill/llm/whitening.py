"""Embedding whitening by Jacobi-Davidson over distributed products.

Vectors become integers, of which each distinct one counts once. The covariance is never built: its
product with a block of vectors is one pass, in which every task centres its rows and adds up its
part. A search space starts at random; Rayleigh-Ritz gives the leading pairs in it; for each pair that
has not converged, a correction equation, projected away from that pair and the converged ones, is
solved by some MINRES steps, all pairs' steps sharing one pass; the corrections widen the space.
Converged pairs are locked: they stay in the space and get no more corrections. The rounds end when
every residual is at double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch

#: Entries are multiplied by SCALE, rounded down and moved by SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS, SEED = 16, 42
#: Pairs beyond the wanted ones that are corrected too, MINRES steps in a round, and rounds.
GUARD, INNER, ROUNDS = 4, 8, 100
#: Parts of sums that are added up together before they reach the driver.
FAN_IN = 256


def integers(vec: Column) -> Column:
    """The vector as an array of longs; null where it is null, empty, or holds a null or an entry that is not finite."""
    fine = F.forall(vec, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine & (F.size(vec) > 0), F.transform(vec, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.chunked_array(column).combine_chunks().flatten()
    return np.asarray(flat, np.int64).reshape(-1, width)


@dataclass(frozen=True)
class Centre:
    """The mean as whole and rest / n, so that entries are centred before anything is rounded."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - sum) ** 2 for each row."""
        off = x - self.whole
        largest = int(np.abs(off).max(initial=0)) + 1
        if (largest * self.n) ** 2 * x.shape[1] < 1 << 62:
            return ((off * self.n - self.rest) ** 2).sum(1).tolist()
        rest = self.rest.tolist()
        return [sum((o * self.n - r) ** 2 for o, r in zip(row, rest, strict=True)) for row in off.tolist()]


class Fit:
    """The distinct vectors, in tasks; passes over them return sums of small arrays."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width
        self.centre = self._centre()

    def _centre(self) -> Centre | None:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width + 1, np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                total += np.append(x.sum(0), len(x))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["part"])

        parts = self.rows.mapInArrow(run, "part array<long>").select(F.posexplode("part").alias("at", "x"))
        sums = dict(parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect())  # a row per dimension
        n = int(sums.get(width, 0))
        return Centre.of(n, [int(sums[k]) for k in range(width)]) if n else None

    def total(self, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all centred blocks of part(block); parts are added in the order of their tasks."""
        width, centre = self.width, self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += part(centre.centred(_matrix(batch.column(0), width)))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "part"])

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("task")
            total = np.zeros(shape)
            for x in table.column("part").to_pylist():
                total += np.frombuffer(x).reshape(shape)
            return pa.table({"task": table.column("task").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

        sums = self.rows.mapInArrow(run, "task long, part binary")
        tasks = self.rows.rdd.getNumPartitions()
        while tasks > FAN_IN:
            sums = sums.groupBy(F.floor(F.col("task") / FAN_IN).alias("g")).applyInArrow(add, "task long, part binary").withColumn("task", F.floor(F.col("task") / FAN_IN))
            tasks = -(-tasks // FAN_IN)
        total = np.zeros(shape)
        for row in sorted(sums.collect()):  # FAN_IN rows at most
            total += np.frombuffer(row.part).reshape(shape)
        return total

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self.total(lambda x: x.T @ (x @ block), block.shape) / self.centre.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([np.square(x).sum()]), (1,))[0]) / self.centre.n


def minres(operator: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Solves operator(x) = b for each column of b on its own; the columns' steps are taken together."""
    tiny = np.finfo(float).tiny
    x, w, w_old, v_old = (np.zeros_like(b) for _ in range(4))
    start = np.linalg.norm(b, axis=0)
    v, eta = b / np.maximum(start, tiny), start.copy()
    beta, c, c_old, s, s_old = np.zeros_like(start), np.ones_like(start), np.ones_like(start), np.zeros_like(start), np.zeros_like(start)
    for _ in range(steps):
        p = operator(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        delta, upper, top = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        rho = np.maximum(np.hypot(delta, after), tiny)
        c_old, s_old, c, s = c, s, delta / rho, after / rho
        w_old, w = w, (v - top * w_old - upper * w) / rho
        x = x + c * eta * w
        eta = -s * eta
        if (np.abs(eta) <= tolerance * start).all():
            break
        # a column whose Krylov space is used up stands still
        going = after > 1e-14 * (np.abs(alpha) + beta)
        v_old, v, beta = v, np.where(going, p / np.maximum(after, tiny), 0.0), np.where(going, after, 0.0)
    return x


def _orthonormal(block: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what the block's columns add to the orthonormal base."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        if base is not None:
            block = block - base @ (base.T @ block)
        u, size, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, size > 1e-8]
    return block


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric operator."""
    k = min(wanted, width)
    most = min(width, max(4 * k, 24))
    space = _orthonormal(np.random.default_rng(seed).standard_normal((width, min(width, k + GUARD))))
    image = product(space)
    best, still = np.inf, 0
    for n_round in range(ROUNDS):
        inner = space.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, image = space @ y, image @ y  # Ritz vectors in falling order, and their images
        residual = image - space * theta
        size = np.linalg.norm(residual, axis=0)
        scale = max(abs(theta[0]), np.finfo(float).tiny)
        enough = 4 * width * np.finfo(float).eps * scale
        worst = float(size[:k].max()) / scale
        best, still = (worst, 0) if worst < 0.5 * best else (best, still + 1)
        if (size[:k] <= enough).all() or (still >= 4 and worst <= 1e-11):
            # the images were carried along; they are made anew before the end is believed
            vectors = _orthonormal(space[:, :k])
            fresh = product(vectors)
            inner = vectors.T @ fresh
            theta, y = np.linalg.eigh((inner + inner.T) / 2)
            vectors, fresh, theta = vectors @ y[:, ::-1], fresh @ y[:, ::-1], theta[::-1]
            if np.linalg.norm(fresh - vectors * theta, axis=0).max() <= max(4 * enough, 1e-11 * scale * (still >= 4)):
                return theta, vectors
            image = product(space)
            continue
        locked = space[:, :k][:, size[:k] <= enough]
        open_ = [j for j in range(min(k + GUARD, space.shape[1])) if size[j] > enough]
        u, shift, r = space[:, open_], theta[open_], residual[:, open_]

        def away(t: np.ndarray, locked: np.ndarray = locked, u: np.ndarray = u) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - u * (u * t).sum(0)

        def operator(t: np.ndarray, shift: np.ndarray = shift, away: Callable = away) -> np.ndarray:
            t = away(t)
            return away(product(t) - t * shift)

        if space.shape[1] == width:  # the whole space: only rounding is left
            image = product(space)
            still += 4
            continue
        corrections = minres(operator, away(-r), INNER, max(0.5 ** (n_round + 1), 1e-4))
        if space.shape[1] + len(open_) > most:
            keep = min(max(k + GUARD, 2 * k), most - min(len(open_), most - k))
            space, image = space[:, :keep], image[:, :keep]
        new = _orthonormal(away(corrections), space)[:, : width - space.shape[1]]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng([seed, n_round]).standard_normal((width, 1)), space)
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"residuals are still {worst:.1e} of the largest eigenvalue after {ROUNDS} rounds")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, seed: int = SEED) -> DataFrame:
    """A row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null or an entry that is not finite are left out, as are
    those of another length than most have (of lengths as frequent the largest). n is the number of
    distinct integer vectors, which the mean and the covariance are of; deviation, a decimal of 38
    digits, the exact sum of (n * x - sum) ** 2. There are as many components as the covariance has
    rank, `components` at most: none, and no rows, for one distinct vector or an empty table. Repeated
    rows give repeated rows; null ids stay; other columns are ignored. A component's entry of largest
    size is positive. Entries that leave the range of long raise an error.
    """
    scratch = Scratch()
    rows = vectors.select(F.col(id_col).alias("id"), integers(F.col(vec_col)).alias("x")).filter("x IS NOT NULL")
    schema = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    none = vectors.sparkSession.createDataFrame([], schema)
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return none
    width = width[0]
    rows = rows.filter(F.size("x") == width)
    fit = Fit(scratch.staged(rows.select("x").distinct(), "distinct-vectors"), width)
    trace = fit.trace()
    if not trace > 0:
        scratch.clear()
        return none
    values, axes = jacobi_davidson(fit.product, width, components, seed)
    real = values > width * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    turn = axes / np.sqrt(values)
    made = fit.total(lambda x: (x @ turn).T @ (x @ turn), (len(values), len(values))) / fit.centre.n
    error = float(np.abs(made - np.eye(len(values))).max())
    scratch.clear()
    centre, explained = fit.centre, values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            at = np.repeat(np.arange(len(x)), k)
            exact = centre.deviation(x)
            deviation = pa.array([Decimal(d) for d in exact], pa.decimal128(38, 0))
            arrays = [
                batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), centre.n)), deviation.take(pa.array(at)),
                pa.array((centre.centred(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema])

    return rows.mapInArrow(run, schema)
