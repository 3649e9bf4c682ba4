"""Whitening of embeddings from an exact integer scatter.

Entries become integers. Each task subtracts the shift and sums entries and cross-products of its distinct
vectors exactly: doubles serve only where every partial sum stays below 2^53, else numbers are cut into
limbs of 20 bits. Partial sums leave a task as 40-bit limbs, so that Spark adds them as longs with map-side
sums whatever their size; what reaches the driver is one row a limb and pair of dimensions, however many
vectors there are. Only n*X'X - SS', formed in Python integers, is converted to floating point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PACKED = "vec_id long, dim int, key binary"
LIMBS = "i int, j int, k int, v long"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
TOP = 2**63 - 1
LIMB = 40
BLOCK = 8192  # rows multiplied at once: 2^13 products of two 20-bit limbs stay below 2^53


@dataclass(frozen=True)
class WhitenParams:
    scale: int = 64
    shift: int = 1_000_000  # of the integers; the scatter is taken without it
    components: int = 16


@dataclass(frozen=True)
class Whitening:
    """What the fit gives; sums are of entries without the shift."""

    n: int
    sums: list[int]
    scatter: list[list[int]]  # n*X'X - SS'
    vectors: np.ndarray  # a row each component
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)


def _pack(scale: int, shift: int):
    """Rows whose vector is whole, with its integers (less the shift) in the fewest bytes of 1, 2, 4 or 8 an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            if b.num_rows == 0:
                continue
            flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = np.cumsum(sizes, dtype=np.int64)
            values = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            whole = (bad[ends] == bad[ends - sizes]) & (sizes > 0) & np.asarray(lists.is_valid())
            with np.errstate(over="ignore", invalid="ignore"):
                up = np.floor(values * scale)
            fits = np.abs(up) < 2.0**62
            x = np.where(fits, np.where(fits, up, 0).astype(np.int64), np.where(up > 0, TOP - shift, -TOP - 1))
            ids, dims, keys = [], [], []
            given = b.column("vec_id").to_pylist()
            for r in np.flatnonzero(whole):
                v = x[ends[r] - sizes[r] : ends[r]]
                low, high = int(v.min()), int(v.max())
                width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
                ids.append(given[r])
                dims.append(len(v))
                keys.append(bytes([width]) + v.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], names=["vec_id", "dim", "key"])

    return run


def packed(embeddings: DataFrame, p: WhitenParams = WhitenParams()) -> DataFrame:
    """(vec_id, dim, key) of rows whose vector is neither null nor empty and holds finite entries only."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_pack(p.scale, p.shift), PACKED)


def matrix(keys: list[bytes], dim: int) -> np.ndarray:
    """The packed vectors as rows of longs."""
    out = np.empty((len(keys), dim), np.int64)
    for r, key in enumerate(keys):
        out[r] = np.frombuffer(key, f"<i{key[0]}", offset=1)
    return out


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as float limbs of 20 bits, low first, the last signed; one limb if x needs no more."""
    out, rest = [], x
    while len(x) and max(-int(rest.min()), int(rest.max())) >= 1 << 20:
        out.append((rest & 0xFFFFF).astype(np.float64))
        rest = rest >> 20
    return [*out, rest.astype(np.float64)]


def exact_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of columns and X'X of a matrix of longs, as Python integers."""
    d = x.shape[1]
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    for at in range(0, len(x), BLOCK):
        parts = _limbs(x[at : at + BLOCK])
        for a, u in enumerate(parts):
            total += u.sum(axis=0).astype(np.int64).astype(object) * (1 << 20 * a)
            for b, v in enumerate(parts):
                cross += (u.T @ v).astype(np.int64).astype(object) * (1 << 20 * (a + b))
    return total, cross


def _scatter(dim: int):
    """Exact sums of a task's vectors as rows (i, j, k, v): limb k of entry (i, j); i = -1: sums, (-1, -1): n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            keys = b.column("key").to_pylist()
            for at in range(0, len(keys), BLOCK):
                s, c = exact_sums(matrix(keys[at : at + BLOCK], dim))
                total, cross = total + s, cross + c
            n += len(keys)
        if not n:
            return
        entries = [(-1, -1, n), *((-1, j, int(s)) for j, s in enumerate(total)), *((i, j, int(cross[i, j])) for i in range(dim) for j in range(i, dim))]
        rows = []
        for i, j, v in entries:
            k = 0
            while not -(1 << LIMB) < v < 1 << LIMB:
                rows.append((i, j, k, v & ((1 << LIMB) - 1)))
                v, k = v >> LIMB, k + 1
            rows.append((i, j, k, v))
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 50_000]), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "k", "v"])

    return run


def _exactly(vectors: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in np.rint(row * 2.0**52)] for row in vectors], object).reshape(vectors.shape)


def decompose(n: int, sums: list[int], cross: list[list[int]], components: int = 16) -> Whitening:
    """n*X'X - SS' exactly, then its leading eigenvectors; those without variance are left out.

    A quotient of two Python integers is correctly rounded, so each covariance is the nearest double. What eigh
    leaves of covariance between components, exactly known, is taken out to first order; the eigenvalue of a
    component is its Rayleigh quotient in the exact scatter.
    """
    d = len(sums)
    scatter = [[n * cross[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    v, whole = np.array([[x / (n * n) for x in row] for row in scatter]), np.array(scatter, object).reshape(d, d)
    unit = float(np.abs(v).max()) or 1.0
    e, q = np.linalg.eigh(v / unit)
    order = np.argsort(-e, kind="stable")
    e, q = e[order] * unit, q[:, order].T
    k = int((e[:components] > 4 * d * np.finfo(float).eps * e[0]).sum())
    fine, scale = _exactly(q), n * n << 104
    rest = np.array([[int(x) / scale for x in row] for row in fine[:k].dot(whole).dot(fine.T)]).reshape(k, d)
    e[:k] = np.diagonal(rest)
    gaps = e[:k, None] - e[None, :]
    small = (np.abs(gaps) > 4 * np.abs(rest)) & (np.arange(k)[:, None] != np.arange(d)[None, :])
    vectors = q[:k] + (np.where(small, rest, 0) / np.where(small, gaps, 1)) @ q
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    values = np.array([int(row.dot(whole).dot(row)) / (n * n * int(row.dot(row))) for row in _exactly(vectors)])
    trace = sum(scatter[j][j] for j in range(d)) / (n * n)
    return Whitening(n, sums, scatter, vectors, values, values / trace if k else values)


def _centred(keys: list[bytes], m: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n*x - S of the packed vectors, as longs if they fit, else as Python integers; and divided by n."""
    x = matrix(keys, m.dim)
    size = m.n * (max(-int(x.min()), int(x.max())) if len(x) else 0) + max(map(abs, m.sums))
    if size < 1 << 62:
        far = x * m.n - np.array(m.sums, np.int64)
        return far, far / m.n
    far = x.astype(object) * m.n - np.array(m.sums, object)
    return far, np.array([[int(a) / m.n for a in row] for row in far]).reshape(x.shape)


def _projected(m: Whitening):
    return (m.vectors / np.sqrt(m.values)[:, None]).T


def _second(m: Whitening):
    """Sums of whitened entries and of their products over a task's fit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, to = len(m.values), _projected(m)
        cross, one = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            keys = b.column("key").to_pylist()
            for at in range(0, len(keys), BLOCK):
                w = _centred(keys[at : at + BLOCK], m)[1] @ to
                cross, one = cross + w.T @ w, one + w.sum(axis=0)
        rows = [(i, j, cross[i, j]) for i in range(k) for j in range(k)] + [(-1, j, one[j]) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

    return run


def fit(rows: DataFrame, p: WhitenParams = WhitenParams()) -> Whitening | None:
    """Fit on the distinct vectors of packed() rows; None without any.

    The dimension is the one that most distinct vectors have, at a tie the larger. identity_error is measured: the
    fit list is whitened once more and its covariance compared with the identity.
    """
    scratch = Scratch(rows.sparkSession)
    try:
        distinct = scratch.store(rows.select("dim", "key").distinct(), "vectors")
        dims = distinct.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
        if dims is None:
            return None
        dim, of = dims["dim"], distinct.where(F.col("dim") == dims["dim"]).select("key")
        sums, cross, n = [0] * dim, [[0] * dim for _ in range(dim)], 0
        for i, j, k, v in of.mapInArrow(_scatter(dim), LIMBS).groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():  # d*d/2 rows a limb
            v <<= LIMB * k
            if i >= 0:
                cross[i][j] += v
                if i != j:
                    cross[j][i] += v
            elif j >= 0:
                sums[j] += v
            else:
                n += v
        m = decompose(n, sums, cross, p.components)
        if not len(m.values):
            return Whitening(m.n, m.sums, m.scatter, m.vectors, m.values, m.explained, 0.0)
        second, first = np.zeros((len(m.values),) * 2), np.zeros(len(m.values))
        for i, j, v in of.mapInArrow(_second(m), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            if i < 0:
                first[j] = v
            else:
                second[i, j] = v
        gap = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(first))).max())
        return Whitening(m.n, m.sums, m.scatter, m.vectors, m.values, m.explained, gap)
    finally:
        scratch.clear()


def _rows(m: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, to = len(m.values), _projected(m)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                far, near = _centred(part.column("key").to_pylist(), m)
                top = max(-int(far.min()), int(far.max()), 1)
                if m.dim * top * top <= TOP:
                    away = pa.array((far * far).sum(axis=1), pa.int64())
                else:
                    each = [sum(int(a) * int(a) for a in row) for row in far]
                    away = pa.array([a if a <= TOP else None for a in each], pa.int64())
                r, n = part.num_rows, pa.scalar(m.n, pa.int64())
                rows = pa.array(np.repeat(np.arange(r), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array([n.as_py()] * (r * k), pa.int64()), away.take(rows),
                        pa.array((near @ to).ravel()), pa.array(np.tile(m.explained, r)), pa.array(np.full(r * k, m.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def transform(rows: DataFrame, m: Whitening) -> DataFrame:
    """A row for each packed() row of the model's dimension and component: OUT."""
    return rows.where(F.col("dim") == m.dim).mapInArrow(_rows(m), OUT)


def whiten(embeddings: DataFrame, p: WhitenParams = WhitenParams()) -> DataFrame:
    """Whitened components of every row (vec_id, embedding) with a whole vector.

    Rows whose vector is null or empty, holds a null or non-finite entry, or has another dimension than most
    distinct vectors have, give no rows; neither does an empty table. A repeated row or vector is
    whitened as often as it comes and fitted once; a null vec_id is kept. Entries whose integer passes a long count as the largest or least.
    Components without variance, or with less than doubles can tell from none beside the largest (4 d eps of it), are
    left out; all are if all vectors are equal. Equal eigenvalues are ordered as eigh gives them. deviation is null where its exact value passes a long. Other columns are ignored.
    """
    rows = packed(embeddings, p)
    m = fit(rows, p)
    return embeddings.sparkSession.createDataFrame([], OUT) if m is None else transform(rows, m)
