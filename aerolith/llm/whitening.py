"""Whitened vectors from a spectrum that is updated row by row (op13).

Method: a component c counts as the whole number floor(1024 * c) + 100000. Each task holds the
eigenvalues and eigenvectors of the scatter of the rows it has read, and their exact sums. A further
row changes that scatter by a multiple of d d', with d the row less the mean so far: what of d the
eigenvectors don't span becomes a new one, components of next to no weight and equal eigenvalues are
deflated, the other eigenvalues are the roots of the secular equation (rational steps inside brackets,
each root relative to its nearest pole), and the eigenvectors follow from weights that fit the roots
exactly, which keeps them orthogonal. Spectra of tasks are merged FAN at a time, by as many rank-one
updates as the smaller one has eigenvalues and one for the distance of the means. In the end one pass
over the rows, centred by the exact sums, gives the covariance in the merged eigenvectors, and its
eigenvectors (Rayleigh-Ritz over the whole basis) take away what rounding left.

A spectrum has width**2 numbers; the driver gets at most FAN of them. `explained` is e / trace(V),
`identity_error` is measured on the whitened values themselves.

Edge cases: rows whose vector is null or has null or non-finite components are left out; lengths that
differ are an error (ValueError), as are components of 2**42 or more, or so many rows that a sum or
n * x is no long (ArithmeticError); null ids stay; repeated rows count each time; components whose
eigenvalue is at most FLAT of the trace (fewer rows than dimensions, equal rows) have null in
`whitened` and are no part of identity_error; fewer dimensions give fewer components; where the exact
deviation is no long, `deviation` is null and `deviation_digits` has it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

from ._spark import checkpointed, pieces, released, table
from ._vectors import finite, integers, width

COMPONENTS, OFFSET = 8, 100_000
#: Spectra that are merged in one call, and the share of the trace up to which an eigenvalue is none.
FAN, FLAT = 16, 1e-12
_EPS = np.finfo(float).eps
_STATE = "id long, n long, sums array<long>, values array<double>, vectors array<double>"


class Spectrum(NamedTuple):
    """n rows, their sums, and eigenvalues and eigenvectors (columns) of their scatter."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) for ascending d: for each the index of its nearest pole and the distance from it."""
    k = len(d)
    upper = np.r_[d[1:], d[-1] + z2.sum()]
    gap = upper - d
    middle = d + gap / 2
    value = 1 + (z2 / (d - middle[:, None])).sum(1)
    left = (value > 0) | (np.arange(k) == k - 1)
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d[None, :] - d[pole][:, None]
    # a bracket for the distance from the pole: the function rises from -inf at d to +inf at the next pole
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    last = k - 1
    low[last], high[last] = 0.0, gap[last]
    if value[last] < 0:
        low[last] = gap[last] / 2
    else:
        high[last] = gap[last] / 2
    x = (low + high) / 2
    below = np.tri(k)
    at = np.arange(k)
    nxt = np.minimum(at + 1, k - 1)
    for _ in range(80):
        away = delta - x[:, None]
        inverse = np.reciprocal(away)
        term = z2 * inverse
        slope = term * inverse
        total = term.sum(1)
        f = 1 + total
        # terms of poles to the left are negative, the others positive
        size = 1 + total - 2 * np.einsum("ij,ij->i", term, below)
        done = (np.abs(f) <= 4 * k * _EPS * size) | (high - low <= 2 * _EPS * np.abs(x))
        if done.all():
            break
        high = np.where(f > 0, np.minimum(high, x), high)
        low = np.where(f < 0, np.maximum(low, x), low)
        # both sides as constant + pole: equal in value and slope, so the root solves a quadratic
        s_left = np.einsum("ij,ij->i", slope, below)
        s_right = slope.sum(1) - s_left
        a, b = away[at, at], np.where(at == last, 1.0, away[at, nxt])
        c = f - s_left * a - np.where(at == last, 0.0, s_right * b)
        with np.errstate(all="ignore"):
            p = c * (a + b) + s_left * a * a + s_right * b * b
            q = a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            step = np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where(at == last, a + s_left * a * a / np.where(c == 0, np.nan, c), step)
            new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return pole, x


def updated(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of vectors diag(values) vectors' + rho x x'."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0 or rho == 0.0:
        return values, vectors
    z = vectors.T @ x
    rest = x - vectors @ z
    again = vectors.T @ rest
    z, rest = z + again, rest - vectors @ again
    length = float(np.linalg.norm(rest))
    if vectors.shape[1] < len(x) and length > 1e-11 * norm:
        vectors = np.c_[rest / length, vectors]
        values, z = np.r_[0.0, values], np.r_[length, z]
        order = np.argsort(values, kind="stable")
        values, vectors, z = values[order], vectors[:, order], z[order]
    z = z * np.sqrt(rho)
    least = 8 * _EPS * max(float(np.abs(values).max(initial=0.0)), float(z @ z))
    # deflation: components without weight stay; of two poles that are equal one is turned out of the update
    kept = np.abs(z) * np.linalg.norm(z) > least
    own = np.flatnonzero(kept)
    close = own[1:][np.diff(values[own]) <= least] if len(own) > 1 else own[:0]
    if len(close):
        vectors, z = vectors.copy(), z.copy()
        before = own[0]
        for j in own[1:]:
            if values[j] - values[before] <= least:
                r = np.hypot(z[before], z[j])
                cos, sin = z[j] / r, z[before] / r
                vectors[:, before], vectors[:, j] = cos * vectors[:, before] - sin * vectors[:, j], sin * vectors[:, before] + cos * vectors[:, j]
                z[before], z[j] = 0.0, r
                kept[before] = False
            before = j
        own = np.flatnonzero(kept)
    if not len(own):
        return values, vectors
    d, w = values[own], z[own]
    pole, x0 = secular_roots(d, w * w)
    # d_i - root_j without cancellation
    away = (d[None, :] - d[pole][:, None]) - x0[:, None]
    # weights for which the roots found are exact
    k = len(own)
    ratio = -away.T.copy()
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    paired = ratio / between
    fitted = np.sqrt(np.abs(np.prod(paired, axis=1)))
    fitted = np.copysign(fitted, w)
    turn = fitted[:, None] / away.T
    turn /= np.linalg.norm(turn, axis=0)
    values, vectors = values.copy(), vectors.copy()
    values[own] = d[pole] + x0
    vectors[:, own] = vectors[:, own] @ turn.reshape(k, k)
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def added(s: Spectrum, row: np.ndarray) -> Spectrum:
    """s after one more row."""
    n = s.n + 1
    d = row - s.sums / s.n if s.n else np.zeros(len(row))
    values, vectors = updated(s.values, s.vectors, d, s.n / n)
    if n % 1000 == 0 and vectors.shape[1]:
        vectors = np.linalg.qr(vectors)[0]
    return Spectrum(n, s.sums + row, values, vectors)


def merged(a: Spectrum, b: Spectrum) -> Spectrum:
    """The spectrum of the rows of both."""
    if not a.n or not b.n:
        return a if a.n else b
    if a.vectors.shape[1] < b.vectors.shape[1]:
        a, b = b, a
    values, vectors = a.values, a.vectors
    for e, v in zip(b.values, b.vectors.T):
        values, vectors = updated(values, vectors, v, max(float(e), 0.0))
    values, vectors = updated(values, vectors, a.sums / a.n - b.sums / b.n, a.n * (b.n / (a.n + b.n)))
    return Spectrum(a.n + b.n, a.sums + b.sums, values, vectors)


def nothing(width: int) -> Spectrum:
    return Spectrum(0, np.zeros(width, np.int64), np.zeros(0), np.zeros((width, 0)))


def _checked(x: np.ndarray, rows: int) -> np.ndarray:
    if x.size and int(np.abs(x).max()) * max(rows, 1) >= 1 << 62:
        raise ArithmeticError("a sum of components is no 64-bit integer")
    return x


def _row(id: int, s: Spectrum) -> dict:
    return {"id": [id], "n": [s.n], "sums": [s.sums.tolist()], "values": [s.values.tolist()], "vectors": [s.vectors.ravel().tolist()]}


def _read(rows: list[dict], width: int) -> Spectrum:
    out = nothing(width)
    for r in sorted(rows, key=lambda r: r["id"]):
        out = merged(out, Spectrum(r["n"], np.array(r["sums"], np.int64), np.array(r["values"]), np.array(r["vectors"]).reshape(width, -1)))
        _checked(out.sums, 1)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """id as a number from 0 that has few gaps, for merging FAN by FAN; it is the task's."""
    return rows.withColumn("id", F.spark_partition_id().cast("long"))


def spectrum(vectors: DataFrame, n: int, vec_col: str) -> Spectrum:
    """The spectrum of all rows, by tasks and then by merging."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = nothing(n)
        for batch in batches:
            x = integers(batch.column(0), n, OFFSET)
            _checked(x, own.n + len(x))
            for row in x:
                own = added(own, row)
        if own.n:
            yield pa.RecordBatch.from_pydict(_row(0, own), schema=_ARROW)

    def merge(t: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(_row(t["id"][0].as_py() // FAN, _read(t.to_pylist(), n)), schema=_ARROW)

    states = checkpointed(_numbered(vectors.select(vec_col).mapInArrow(run, _STATE)))
    left = (states.agg(F.max("id")).first()[0] or 0) + 1
    while left > FAN:
        states = checkpointed(states.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(merge, _STATE))
        left = pieces(left, FAN)
    return _read([r.asDict() for r in states.collect()], n)


_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean; only the last division rounds."""
    return (n * x - sums) / n


def refined(vectors: DataFrame, s: Spectrum, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of the covariance, from one pass in the basis that s has found."""
    n, d = s.n, len(s.sums)
    basis = np.linalg.qr(np.c_[s.vectors[:, ::-1], np.eye(d)])[0]
    sums = s.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = centred(_checked(integers(batch.column(0), d, OFFSET), n), n, sums) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"id": pa.array([0], pa.int64()), "m": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})
        released()

    def add(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["id"])
        return pa.table({"id": pa.array([rows[0]["id"] // FAN], pa.int64()), "m": pa.array([np.sum([r["m"] for r in rows], axis=0).tolist()], pa.list_(pa.float64()))})

    parts = checkpointed(_numbered(vectors.select(vec_col).mapInArrow(run, "id long, m array<double>")))
    left = (parts.agg(F.max("id")).first()[0] or 0) + 1
    while left > FAN:
        parts = checkpointed(parts.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(add, "id long, m array<double>"))
        left = pieces(left, FAN)
    total = np.sum([r.m for r in sorted(parts.collect(), key=lambda r: r.id)], axis=0).reshape(d, d) / n
    values, turn = np.linalg.eigh((total + total.T) / 2)
    found = basis @ turn[:, ::-1]
    # either sign would do; the largest entry is positive
    found *= np.sign(found[np.abs(found).argmax(0), np.arange(d)])
    return np.maximum(values[::-1], 0.0), found


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum of (n * x - sum)**2 over the components of each row, exact."""
    off = n * x - sums
    largest = int(np.abs(off).max(initial=0))
    if largest * largest * max(1, off.shape[1]) >= 1 << 62:
        off = off.astype(object)
    return [int(v) for v in (off * off).sum(1)] if off.shape[1] else [0] * len(off)


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each finite vector and component: id, component, n, deviation, whitened, explained, identity_error, deviation_digits."""
    own = finite(vectors.select(id_col, vec_col), vec_col)
    d = width(own, vec_col)
    kind = own.schema[id_col].dataType.simpleString()
    if not d:
        return own.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string")
    s = spectrum(own, d, vec_col)
    n, sums, k = s.n, s.sums, min(components, d)
    values, basis = refined(own, s, vec_col)
    trace = float(values.sum())
    firm = [bool(v > FLAT * trace) for v in values[:k]]
    scale = np.array([1 / np.sqrt(v) if f else np.nan for v, f in zip(values, firm)])
    head = basis[:, :k]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d, OFFSET)
            y = centred(x, n, sums) @ head * scale
            exact = _squares(x, n, sums)
            rows = [[float(v) if f else None for v, f in zip(r, firm)] for r in y]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), pa.array(map(str, exact)), pa.array(rows, pa.list_(pa.float64()))], [id_col, "deviation", "deviation_digits", "w"])
        released()

    schema = own.select(id_col).schema.add("deviation", LongType()).add("deviation_digits", StringType()).add("w", ArrayType(DoubleType()))
    done = checkpointed(own.mapInArrow(project, schema))
    w = lambda i: F.col("w")[i]
    pairs = [(i, j) for i in range(k) for j in range(i, k) if firm[i] and firm[j]]
    means = {i: F.avg(w(i)) for i in range(k) if firm[i]}
    off = [F.abs(F.avg(w(i) * w(j)) - means[i] * means[j] - F.lit(float(i == j))) for i, j in pairs]
    error = done.agg(F.greatest(*off, F.lit(0.0), F.lit(0.0))).first()[0] if off else None
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values[:k]])
    out = done.select(id_col, "deviation", "deviation_digits", F.posexplode("w").alias("at", "whitened"))
    return out.select(id_col, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_digits")


def op13_rank_one_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_rank_one_whitening": op13_rank_one_whitening}
ORACLE_SQL: dict[str, str] = {}
