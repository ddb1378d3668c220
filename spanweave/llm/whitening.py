"""Whitening by the leading principal components, in mixed precision.

Vectors become integers x = floor(1024 * c) + 100000. Two scans give exact integer sums: the sums S of each dimension, then
the products of the vectors centred on the rounded mean; the part of the mean that rounding left is taken off
exactly, so that the covariance V does not depend on how the rows are dealt out. Its eigenvectors are found in single precision
and then corrected by matrix multiplications in extended precision (the iteration of Ogita and Aishima):

    R = I - X'X,  D = X'VX,  e_i = D_ii / (1 - R_ii),  X <- X + X E,
    E_ij = (D_ij + e_j R_ij) / (e_j - e_i)   or   R_ij / 2 where e_i and e_j are too close to part.

Runs of close eigenvalues are solved on their own: the small matrix X_J' V X_J, less its mean eigenvalue, is
diagonalised, the columns of the run are turned by its eigenvectors, and the iteration goes on.

Every scan returns one row of fixed size per task, which Spark adds up by cell; the driver holds a few
matrices of (dimensions x dimensions).

Defined results: vectors that are null, have another length than ``size`` or hold null or non-finite entries are dropped, and so are
those with an entry of absolute 131072 or more; rows without id and repeated rows count each; a component whose eigenvalue
is zero (to double precision) has null ``whitened`` and is left out of ``identity_error``; with no variance at all ``explained``
is null; an empty table gives an empty table. ``deviation`` is null where it does not fit a long;
``deviation_text`` always has all digits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.vantage import integers

SHIFT = 100_000
HALF = 14
STEPS = 16
REAL = np.longdouble


class Model(NamedTuple):
    n: int
    sums: list[int]
    vectors: np.ndarray  # columns, by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray
    some: np.ndarray  # eigenvalue above zero


def _step(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """One correction: (new vectors, eigenvalues, runs of close eigenvalues, size of the correction)."""
    r = np.eye(len(v), dtype=REAL) - x.T @ x
    d = x.T @ v @ x
    e = np.diag(d) / (1 - np.diag(r))
    norm = lambda a: float(np.sqrt((a.astype(float) ** 2).sum()))
    # never below the rounding of e, within which eigenvalues cannot be told apart
    close = 2 * (norm(d - np.diag(e)) + norm(v) * (norm(r) + 8 * len(v) * float(np.finfo(REAL).eps)))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > close
    fix = np.where(apart, (d + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(e, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(e[order]) > close) + 1)
    return x + x @ fix, e, [j for j in runs if len(j) > 1], float(np.abs(fix).max())


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a symmetric matrix, by falling value, to double precision."""
    scale = np.abs(v).max() or REAL(1)
    a = v.astype(REAL) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(REAL)
    for _ in range(STEPS):
        x, e, runs, moved = _step(a, x)
        for j in runs:  # a run of close eigenvalues on its own
            part = x[:, j]
            inner = part.T @ a @ part
            inner = inner - np.eye(len(j), dtype=REAL) * (np.trace(inner) / len(j))
            top = np.abs(inner).max()
            if top > np.finfo(REAL).eps * len(a):
                x[:, j] = part @ np.linalg.eigh((inner / top).astype(float))[1].astype(REAL)
        for _ in range(2):  # gaps may be tiny, so the columns are made orthonormal to full precision first
            x = x + x @ (np.eye(len(a), dtype=REAL) - x.T @ x) / 2
        if moved < 1e-18 * len(a):
            break
    e = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-e, kind="stable")
    return (e[order] * scale).astype(float), (x / np.sqrt((x * x).sum(0)))[:, order].astype(float)


def _totals(rows: DataFrame, size: int, width: int, cells: Callable[[np.ndarray], np.ndarray], exact: bool = True) -> list:
    """Sums over all rows of ``width`` numbers that ``cells`` gives for each block of vectors."""
    kind = np.int64 if exact else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, kind)
        for batch in batches:
            if batch.num_rows:
                held += cells(batch.column(0).flatten().to_numpy().reshape(-1, size).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.from_numpy_dtype(kind)))], ["x"])

    parts = rows.select("v").mapInArrow(add, f"x array<{'bigint' if exact else 'double'}>").select(F.posexplode("x").alias("at", "x"))
    value = F.col("x").cast("decimal(38,0)") if exact else F.col("x")
    out = [0] * width if exact else [0.0] * width
    for r in parts.groupBy("at").agg(F.sum(value).alias("x")).collect():
        out[r["at"]] = int(r["x"]) if exact else r["x"]
    return out


def fit(rows: DataFrame, size: int = 64, components: int = 8) -> Model:
    """The model of integer vectors (id, v) without the shift, which moves no component."""
    first = _totals(rows, size, size + 1, lambda b: np.append(b.sum(0), len(b)))
    n, sums = first[size], first[:size]
    if not n:
        return Model(0, [0] * size, np.zeros((size, 0)), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(size)

    def products(block: np.ndarray) -> np.ndarray:
        # halves of 14 bits, whose products add up exactly in double precision
        z = block - mean
        a, b = (z >> HALF).astype(float), (z & (1 << HALF) - 1).astype(float)
        mixed = a.T @ b
        return np.concatenate([m[upper] for m in (a.T @ a, mixed + mixed.T, b.T @ b)]).astype(np.int64)

    width = len(upper[0])
    found = _totals(rows, size, 3 * width, products)
    left = [s - n * int(m) for s, m in zip(sums, mean)]
    v = np.zeros((size, size), REAL)
    for k, (i, j) in enumerate(zip(*upper)):
        c = (found[k] << 2 * HALF) + (found[width + k] << HALF) + found[2 * width + k]
        whole, rest = divmod(n * c - left[i] * left[j], n * n)
        v[i, j] = v[j, i] = REAL(str(whole)) + REAL(str(rest)) / REAL(str(n * n))
    values, vectors = eigen(v)
    total = float(np.trace(v))
    kept = min(components, size)
    explained = values[:kept] / total if total > 0 else np.full(kept, np.nan)
    return Model(n, sums, vectors[:, :kept], values[:kept], explained, values[:kept] > max(total, 0) * size * np.finfo(float).eps)


def _white(model: Model):
    mean = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], np.int64)
    rest = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, mean)])
    turn = model.vectors[:, model.some] / np.sqrt(model.values[model.some])
    return lambda block: ((block - mean) - rest) @ turn


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """Largest absolute entry of the covariance of all whitened rows less the identity."""
    k = int(model.some.sum())
    if not k:
        return None
    white, size = _white(model), len(model.sums)

    def cells(block: np.ndarray) -> np.ndarray:
        w = white(block)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    found = np.array(_totals(rows, size, k + k * k, cells, exact=False))
    mean = found[:k] / model.n
    return float(np.abs(found[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, model: Model) -> DataFrame:
    """(id, deviation_text, whitened) per integer vector; ``whitened`` has one value per component."""
    n, size = model.n, len(model.sums)
    mean = [(2 * s + n) // (2 * n) for s in model.sums] if n else [0] * size
    left = [s - n * m for s, m in zip(model.sums, mean)]
    square = sum(s * s for s in left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = _white(model)
        center = np.array(mean, np.int64)
        # products with the remainders in two halves, each exact in 64 bits
        high, low = np.array([s >> 20 for s in left], np.int64), np.array([s & (1 << 20) - 1 for s in left], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)
            z = block - center
            own, up, down = (z * z).sum(1).tolist(), (z @ high).tolist(), (z @ low).tolist()
            wide = [str(n * n * a - 2 * n * ((u << 20) + d) + square) for a, u, d in zip(own, up, down)]
            found = np.full((len(block), len(model.some)), np.nan)
            found[:, model.some] = white(block)
            flat = pa.array(found.ravel(), mask=np.isnan(found.ravel()))
            ends = pa.array(np.arange(len(block) + 1, dtype=np.int32) * len(model.some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(wide), pa.ListArray.from_arrays(ends, flat)], ["id", "deviation_text", "whitened"])

    return rows.select("id", "v").mapInArrow(run, "id bigint, deviation_text string, whitened array<double>")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, size: int = 64) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, deviation_text, whitened, explained, identity_error."""
    rows = integers(vectors, id_col, vector_col, size)
    model = fit(rows, size, components)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    each = whiten(rows, model).select("id", "deviation_text", F.posexplode("whitened").alias("_at", "whitened"))
    share = F.get(shares, F.col("_at"))
    return each.select(
        "id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation_text").try_cast("bigint").alias("deviation"), "deviation_text", "whitened",
        F.when(~F.isnan(share), share).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
