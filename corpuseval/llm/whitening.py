"""Whitening of embeddings: principal components by QDWH spectral divide-and-conquer, then a broadcast projection.

Values become integers, x = floor(``SCALE`` * value) + ``SHIFT``, so that counts, sums and deviations are exact.  The fit list is each distinct
x-vector once.  Tasks sum it, then sum products of centred vectors, (n x - S) / n; only d sums and a d x d matrix reach the driver, for d of
at most ``MAX_LENGTH``.

The covariance is split there without an eigensolver.  ``polar`` finds the orthogonal polar factor U of a shifted matrix A - sI by
dynamically weighted Halley steps (Nakatsukasa and Higham, 2013), each one QR factorisation; (I + U) / 2 projects on the space of
all eigenvalues over s.  A basis of that space and of its complement splits A into two smaller matrices, and each is split again until it
is one number or diagonal.  Only parts that hold one of the wanted components are split on.

The components, at most 16 vectors of d numbers, are broadcast; every row is centred, projected, and divided by the square root of
the eigenvalue.  ``identity_error`` is measured on the fit list, not derived.

Rows whose vector is null, empty, or holds null or non-finite values are dropped; so are vectors of another length than most have (the smallest
length of several).  Values are held within +-2^40 after scaling.  A deviation beyond a long is null.  Components of less than
``LEAST_SHARE`` of the first one's variance have no direction to double precision and are left out: none of equal vectors, a
single one, or an empty table, which give no rows.  Repeated rows and null ids are rows like others; other columns are carried along by
``whiten``, its own five replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuseval.llm._session import spread, stored
from corpuseval.llm._vectors import matrix, scaled, sound, usual_length

SCALE, SHIFT, BOUND = 64, 1_000_000, 1 << 40
COMPONENTS = 16
#: Numbers of a vector at most: a square matrix of that side is all that the driver holds.
MAX_LENGTH = 2_048
LEAST_SHARE = 1e-11
#: Rows that are multiplied at once inside a task.
STEP = 4_096
_EPS = np.finfo(np.float64).eps
_LONG = 1 << 63
_OWN = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley iterations."""
    n = len(a)
    x, least, eye = a / np.linalg.norm(a), _EPS / n, np.eye(n)
    for _ in range(12):
        squared = least * least
        d = np.cbrt(4 * (1 - squared) / squared**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - squared) / (squared * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        least, moved = min(1.0, least * (wa + wb * squared) / (1 + wc * squared)), np.linalg.norm(new - x)
        x = new
        if abs(1 - least) < 10 * _EPS and moved < 1e-8:  # convergence is cubic
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int, float]:
    """An orthogonal basis whose first k vectors span the space of eigenvalues over ``shift``, k, and what couples both spaces."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = round(float(np.trace(projector)))
    if not 0 < k < n:
        return np.eye(n), k, np.inf
    start = np.random.default_rng(n).standard_normal((n, k))
    for _ in range(2):
        start = np.linalg.qr(projector @ start)[0]
    basis = np.linalg.qr(start, mode="complete")[0]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def eigen(a: np.ndarray, wanted: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: at least the first ``wanted``, or all."""
    n = len(a)
    scale = np.linalg.norm(a) if scale is None else scale
    values = np.diag(a)
    apart = a - np.diag(values)
    if n == 1 or np.linalg.norm(apart) <= _EPS * scale:
        order = np.argsort(-values, kind="stable")
        return values[order], np.eye(n)[:, order]
    mean, width = values.mean(), np.linalg.norm(a - values.mean() * np.eye(n)) / np.sqrt(n)
    best = (np.eye(n), 0, np.inf)
    for shift in (np.median(values), mean, *(mean + f * width for f in (0.11, -0.13, 0.31, -0.37))):
        found = split(a, float(shift))
        best = min(best, found, key=lambda s: s[2])
        if best[2] <= 10 * n * _EPS * scale:
            break
    basis, k, coupled = best
    if not 0 < k < n or coupled > 1e-3 * scale:  # eigenvalues that no shift keeps apart: one value, any basis
        order = np.argsort(-values, kind="stable")
        return values[order], np.eye(n)[:, order]
    turned = basis.T @ a @ basis
    turned = (turned + turned.T) / 2
    high, left = eigen(turned[:k, :k], wanted, scale)
    if k >= wanted:
        return high, basis[:, :k] @ left
    low, right = eigen(turned[k:, k:], wanted - k, scale)
    return np.concatenate([high, low]), np.hstack([basis[:, :k] @ left, basis[:, k:] @ right])


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: count and sums of the fit list, components (columns), their variances, and the whole variance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def length(self) -> int:
        return len(self.sums)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n x - S of each row, exact: as longs, or as Python's integers where longs do not hold them."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)) if self.sums else 0
        kind = np.int64 if 2 * most < _LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x).astype(np.float64) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)


def deviations(moved: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; None beyond a long."""
    most = int(np.abs(moved).max(initial=0))
    if most * most * moved.shape[1] < _LONG:
        whole = moved.astype(np.int64)
        return (whole * whole).sum(axis=1).tolist()
    return [t if t < _LONG else None for t in (sum(int(v) ** 2 for v in row) for row in moved)]


def _summed(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """The sum of the matrices that ``each`` makes of runs of x-vectors: by task, then by row of the matrix."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for low in range(0, len(batch), STEP):
                part = each(matrix(batch.column(0).slice(low, STEP), length))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def by_row(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(list(pdf["v"]), axis=0)]})

    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    done = rows.select("x").coalesce(tasks).mapInArrow(by_task, "i int, v array<double>").groupBy("i").applyInPandas(by_row, "i int, v array<double>")
    return np.array([r["v"] for r in done.orderBy("i").collect()])


def _exact_sums(rows: DataFrame, length: int) -> tuple[int, tuple[int, ...]]:
    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # 2^41 times the rows of a batch is a long
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, length), pa.int32()), pa.array([len(batch), *matrix(batch.column(0), length).sum(axis=0).tolist()], pa.int64())], names=["i", "v"])

    sums = rows.select("x").mapInArrow(by_task, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in sums.collect()}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(length))


def fit(rows: DataFrame, length: int, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """The whitening of ``rows`` (distinct ``x`` of one length), and the largest entry of |covariance of whitened - identity|."""
    n, sums = _exact_sums(rows, length)
    blank = Whitening(n, sums, np.zeros((length, 0)), np.zeros(0), 0.0)
    if n < 2:
        return blank, 0.0

    def products(x: np.ndarray) -> np.ndarray:
        c = blank.centred(x)
        return c.T @ c

    covariance = _summed(rows, products, length) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = eigen(covariance, components)
    k = int((values[:components] > LEAST_SHARE * max(values[0], 0)).sum())
    if k == 0:
        return blank, 0.0
    model = Whitening(n, sums, vectors[:, :k], values[:k], float(np.trace(covariance)))

    def whitened(x: np.ndarray) -> np.ndarray:
        z = model.project(x)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = _summed(rows, whitened, length) / n
    return model, float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding") -> DataFrame:
    """A row for each sound row and component, with ``component, n, deviation, whitened, explained`` and ``identity_error``."""
    vector = F.col(f"`{vector_col}`")
    others = F.struct(*(F.col(f"`{c}`") for c in vectors.columns if c not in _OWN))
    rows = spread(vectors.where(sound(vector)).select(others.alias("record"), F.transform(scaled(vector, SCALE, BOUND), lambda v: v + SHIFT).alias("x")))
    length = usual_length(rows, "x")
    if length > MAX_LENGTH:
        raise ValueError(f"vectors of {length} numbers; at most {MAX_LENGTH}")
    rows = rows.where(F.size("x") == length)
    model, error = fit(stored(rows.select("x").distinct(), "fit"), length, components)
    shared, kind = vectors.sparkSession.sparkContext.broadcast(model), rows.schema["record"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low in range(0, len(batch), STEP):
                part = batch.slice(low, STEP)
                x = matrix(part.column("x"), length)
                yield pa.RecordBatch.from_arrays([part.column("record"), pa.array(deviations(known.moved(x)), pa.int64()), pa.array(list(known.project(x)), pa.list_(pa.float64()))], names=["record", "deviation", "z"])

    done = rows.mapInArrow(run, f"record {kind}, deviation long, z array<double>")
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.variances)) if len(model.variances) else F.array().cast("array<double>")
    flat = done.select("record", "deviation", F.posexplode("z").alias("at", "whitened"))
    return flat.select("record.*", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return done.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
