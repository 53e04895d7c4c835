"""Whitening of embeddings by spectral divide-and-conquer on QDWH polar decompositions.

The fit list is every different vector once, as integers. Its size, sums and centred products are counted in tasks and added
up exactly; the matrix of one number for each pair of dimensions is all that reaches the driver. There the covariance is split: the
polar factor of the shifted covariance ``V - s I`` (dynamically weighted Halley iteration, each step a QR factorisation)
is the matrix sign, so ``(U + I) / 2`` projects on the invariant subspace of all eigenvalues above ``s``; an orthonormal basis of
this subspace and of its complement turns the matrix into two smaller ones, and so on down to single components. The components
are broadcast (dimensions x components) and every row is whitened in its task.

Edge cases: vectors that are null, empty, or hold null or non-finite entries are left out, as are vectors of another length than
that of most different vectors (ties: the shortest); repeated vectors count once in the fit, and every row is returned; entries
beyond the range of a long take its nearest value; directions in which the fit list doesn't differ (eigenvalue zero within
rounding) are no components, so a fit list of one vector gives no rows, nor does an empty table; null ids stay null; within equal
eigenvalues any orthonormal basis is right, and one is taken. A deviation beyond the range of a long fails.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, ship, table

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MAX_STEPS = 60


# Spectral divide-and-conquer -----------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by the dynamically weighted Halley iteration in QR form."""
    n = len(a)
    x = a / np.linalg.norm(a, 2)
    # A lower bound of the least singular value; too low a one costs a step, none costs accuracy.
    low = max(np.linalg.norm(x, 1) / (math.sqrt(n) * max(1.0, np.linalg.cond(x, 1))), 1e-17)
    for _ in range(MAX_STEPS):
        d = (4 * (1 - low**2) / low**4) ** (1 / 3) if low < 1 else 0.0
        p = math.sqrt(1 + d)
        w = p + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * p))) / 2
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (w - b / c) / math.sqrt(c) * q[:n] @ q[n:].T
        new = (new + new.T) / 2  # the sign of a symmetric matrix is symmetric
        low = min(1.0, low * (w + b * low**2) / (1 + c * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-14 * n and 1 - low < 1e-12:
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns: the first ``rank`` span the range of a projector, the rest its complement."""
    found, _ = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))
    found, _ = np.linalg.qr(projector @ found)
    return np.linalg.qr(np.hstack([found, rng.standard_normal((len(projector), len(projector) - rank))]))[0]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale, rng = max(float(np.abs(v).max(initial=0.0)), 1e-300), np.random.default_rng(1)
    found: list[tuple[float, np.ndarray]] = []
    open_: list[tuple[np.ndarray, np.ndarray]] = [(v / scale, np.eye(len(v)))]
    while open_:
        a, q = open_.pop()
        a = (a + a.T) / 2
        n = len(a)
        rest = a - np.diag(np.diag(a))
        if n == 1 or np.abs(rest).max() <= 1e-16 * n:
            found += [(float(a[i, i]), q[:, i]) for i in range(n)]
            continue
        rank = 0
        for at in (0.5, 0.37, 0.61, 0.2, 0.8, 0.05, 0.95, 0.002, 0.998):
            low, high = (float(x) for x in (np.diag(a).min(), np.diag(a).max()))
            if high - low < np.abs(rest).max():  # an even diagonal says nothing: the discs hold all eigenvalues
                reach = np.abs(rest).sum(axis=1)
                low, high = float((np.diag(a) - reach).min()), float((np.diag(a) + reach).max())
            shift = float(np.median(np.diag(a))) if at == 0.5 and low < np.median(np.diag(a)) < high else low + at * (high - low)
            moved = a - shift * np.eye(n)
            if np.abs(moved).max() == 0:
                continue
            projector = (polar(moved) + np.eye(n)) / 2
            rank = round(float(np.trace(projector)))
            if 0 < rank < n:
                basis = _basis(projector, rank, rng)
                turned = basis.T @ a @ basis
                if np.abs(turned[:rank, rank:]).max() <= 1e-14 * n:
                    break
            rank = 0
        if not rank:  # no shift parts them: equal within rounding, up to a last turn
            turned, basis, rank = *_last_turns(a), 0
            found += [(float(turned[i, i]), q @ basis[:, i]) for i in range(n)]
            continue
        open_ += [(turned[:rank, :rank], q @ basis[:, :rank]), (turned[rank:, rank:], q @ basis[:, rank:])]
    found.sort(key=lambda f: -f[0])
    vectors = np.array([f[1] for f in found]).T
    # One Rayleigh quotient in the original matrix gives the eigenvalues their last digits.
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _last_turns(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plane rotations until a small block of nearly equal eigenvalues is diagonal."""
    a, q = a.copy(), np.eye(len(a))
    for _ in range(MAX_STEPS):
        if np.abs(a - np.diag(np.diag(a))).max() <= 1e-16:
            break
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if a[i, j]:
                    turn = 0.5 * math.atan2(2 * a[i, j], a[j, j] - a[i, i])
                    c, s = math.cos(turn), math.sin(turn)
                    g = np.array([[c, s], [-s, c]])
                    a[:, [i, j]] = a[:, [i, j]] @ g
                    a[[i, j]] = g.T @ a[[i, j]]
                    q[:, [i, j]] = q[:, [i, j]] @ g
    return a, q


# Counting ------------------------------------------------------------------------------------------------------------


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def to_integers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def _sums(fit: DataFrame, column: str = "x", kind: str = "long") -> tuple[int, list]:
    """Number of rows and sums of every dimension, exact for integers; each task gives its own sums once."""
    number = pa.decimal128(38, 0) if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for b in batches:
            z = _matrix(b.column(0))
            if len(z):
                exact = kind == "long" and (int(z.max()).bit_length() + len(z).bit_length() > 62 or int(z.min()).bit_length() + len(z).bit_length() > 62)
                part = z.astype(object).sum(axis=0) if exact else z.sum(axis=0)
                total, n = total + (part.astype(object) if kind == "long" else part), n + len(z)
        if n:
            values = [int(x) if kind == "long" else float(x) for x in total]
            columns = [pa.array(np.arange(len(values), dtype=np.int32)), pa.array([n] * len(values)), pa.array(values, number)]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "n", "s"])

    out = fit.select(column).mapInArrow(run, f"pos int, n long, s {'decimal(38,0)' if kind == 'long' else 'double'}")
    row = sorted(out.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    return (row[0]["n"], [int(r["s"]) if kind == "long" else r["s"] for r in row]) if row else (0, [])


def _products(fit: DataFrame, column: str, centre: list, kind: str) -> DataFrame:
    """``i, j, p``: sums over the table of products of centred entries, for i <= j; each task gives its own sums once.

    Integer entries are added up exactly (``kind`` long), others in double precision.
    """
    d = len(centre)
    i, j = np.triu_indices(d)
    number = pa.decimal128(38, 0) if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d), object if kind == "long" else float), False
        for b in batches:
            z = _matrix(b.column(0))
            for at in range(0, len(z), 4096):
                part = z[at : at + 4096]
                some = True
                if kind != "long":
                    part = part - np.array(centre)
                    total += part.T @ part
                    continue
                near = part - np.array(centre, np.int64) if max(map(abs, centre)) < 1 << 62 and np.abs(part).max() < 1 << 62 else None
                if near is not None and int(np.abs(near).max()) ** 2 * len(near) < 1 << 53:
                    near = near.astype(float)  # exact, and fast
                    total += (near.T @ near).astype(np.int64).astype(object)
                else:
                    wide = part.astype(object) - np.array(centre, object)
                    total += wide.T.dot(wide)
        if some:
            values = total[i, j].tolist()
            values = [int(x) for x in values] if kind == "long" else values
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, number)], ["i", "j", "p"])

    out = fit.select(column).mapInArrow(run, f"i int, j int, p {'decimal(38,0)' if kind == 'long' else 'double'}")
    return out.groupBy("i", "j").agg(F.sum("p").alias("p"))


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of integer vectors, every entry rounded once."""
    near = [round(Fraction(s, n)) for s in sums]
    off = [s - n * m for s, m in zip(sums, near, strict=True)]  # n times what rounding has left of the mean
    v = np.zeros((len(sums), len(sums)))
    for r in _products(fit, "x", near, "long").toLocalIterator():
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (n * int(r["p"]) - off[r["i"]] * off[r["j"]]) / (n * n)
    return v


# Whitening -----------------------------------------------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    spark = vectors.sparkSession
    ship(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), to_integers(F.col("embedding")).alias("x"))
    fit = materialise(rows.select("x").distinct(), "fit")
    length = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    fit, rows = fit.where(F.size("x") == length["d"]), rows.where(F.size("x") == length["d"])
    n, sums = _sums(fit)
    v = covariance(fit, n, sums)
    values, basis = eigen(v)
    kept = int((values > max(values.max(), 0.0) * len(sums) * 2.3e-16).sum())
    k = min(components, kept)
    if not k:
        return spark.createDataFrame([], schema)
    values, basis, trace = values[:k], basis[:, :k], float(np.trace(v))
    near = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([float(Fraction(s, n) - int(m)) for s, m in zip(sums, near, strict=True)])
    onto = spark.sparkContext.broadcast((basis, np.sqrt(values)))

    def project(x: np.ndarray) -> np.ndarray:
        basis, roots = onto.value
        return ((x - near).astype(float) - rest) @ basis / roots

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = project(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * k, w.ravel())], ["w"])

    projected = fit.select("x").mapInArrow(of_fit, "w array<double>")
    means = [x / n for x in _sums(projected, "w", "double")[1]]
    error = max(abs(r["p"] / n - (r["i"] == r["j"])) for r in _products(projected, "w", means, "double").collect())
    explained, exact = values / trace, sums

    def deviations(x: np.ndarray) -> list[int]:
        wide = [max(abs(n * int(x[:, i].max()) - s), abs(n * int(x[:, i].min()) - s)) for i, s in enumerate(exact)]
        if n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, exact)) < 1 << 62 and sum(a * a for a in wide) < 1 << 62:
            away = n * x - np.array(exact, np.int64)
            return (away * away).sum(axis=1).tolist()
        return [sum((n * int(e) - s) ** 2 for e, s in zip(r, exact, strict=True)) for r in x.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(np.array(deviations(x), np.int64), k)),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
