"""Blocks of vectors in Arrow: matrices, byte codes and the best of each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column) -> np.ndarray:
    """A column of lists of equal length as a matrix of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def largest(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest finite values of each row, largest first; ties go to the earlier column."""
    n = score.shape[1]
    if n > 4 * k:  # only what reaches the k-th value is sorted
        least = np.partition(score, n - k, axis=1)[:, n - k]
        row, at = np.nonzero(score >= least[:, None])
        order = np.lexsort((at, -score[row, at], row))
        row, at = row[order], at[order]
        start = np.searchsorted(row, np.arange(len(score)))
        kept = np.arange(len(row)) - start[row] < k
        row, at = row[kept], at[kept]
    else:
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        row, at = np.repeat(np.arange(len(score)), order.shape[1]), order.ravel()
    finite = np.isfinite(score[row, at])
    return row[finite], at[finite]


def byte_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes -127..127, step, error) of each row: ``step * codes`` is at L2 distance ``error`` from the row."""
    step = np.abs(x).max(axis=1, initial=0.0) / 127
    codes = np.rint(np.divide(x, step[:, None], out=np.zeros_like(x), where=step[:, None] > 0)).astype(np.int8)
    return codes, step, np.linalg.norm(x - step[:, None] * codes, axis=1)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of byte codes: sums of at most 1,000 products of bytes are exact in single precision."""
    if a.shape[1] <= 1000:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return a.astype(np.float64) @ b.astype(np.float64).T


def centres_of(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """``k`` centres of ``points`` by k-means from distinct random members; fewer if there are fewer points."""
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = nearest_centre(points, centres)[0]
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and the distance to it."""
    at, far, square = np.zeros(len(points), np.int64), np.zeros(len(points)), (centres**2).sum(axis=1)
    for first in range(0, len(points), 4096):
        part = slice(first, first + 4096)
        d = square - 2 * (points[part] @ centres.T)
        at[part] = d.argmin(axis=1)
        far[part] = np.linalg.norm(points[part] - centres[at[part]], axis=1)
    return at, far
