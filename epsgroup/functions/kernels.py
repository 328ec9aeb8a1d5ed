"""Numpy helpers for the Arrow stages: distances between two small blocks of vectors.

Distances count coordinate by coordinate, like the SQL form, so both forms decide alike. In many dimensions a matrix
product screens the pairs first, and only pairs too close to call are counted again coordinate by coordinate.
"""

import numpy as np
import pyarrow as pa

FEW_DIMENSIONS = 8
PAIRS_PER_BLOCK = 1 << 17
PAIRS_PER_PRODUCT = 1 << 22


def vectors_of(column, dimension=None) -> np.ndarray:
    """An Arrow list column as a matrix; vectors of unequal length fail."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    if rows == 0:
        return np.empty((0, dimension or 0))
    wide = dimension or len(flat) // rows
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or not np.all(lengths == wide):
        raise ValueError(f"every vector must have {wide} coordinates")
    return np.ascontiguousarray(flat.reshape(rows, wide))


def pairwise_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of a and the rows of b, coordinate by coordinate."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        gap *= gap
        total += gap
    return total


def aligned_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of row i of a to row i of b."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        total += gap * gap
    return total


def screened_sq(a: np.ndarray, b: np.ndarray, norm_b=None) -> tuple[np.ndarray, float]:
    """Squared distances by matrix product, and a bound on their rounding error."""
    norm_a = np.einsum("ij,ij->i", a, a)
    norm_b = np.einsum("ij,ij->i", b, b) if norm_b is None else norm_b
    total = a @ b.T
    total *= -2.0
    total += norm_a[:, None]
    total += norm_b[None, :]
    widest = (norm_a.max() if len(a) else 0.0) + (norm_b.max() if len(b) else 0.0)
    return total, 8.0 * (a.shape[1] + 8) * np.finfo(float).eps * widest


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """True where a row of a and a row of b are at most eps apart."""
    if a.shape[1] <= FEW_DIMENSIONS:
        return np.sqrt(pairwise_sq(a, b)) <= eps
    total, error = screened_sq(a, b)
    error += 4.0 * np.finfo(float).eps * eps * eps
    close = total <= eps * eps
    i, j = np.nonzero(np.abs(total - eps * eps) <= error)
    if len(i):
        close[i, j] = np.sqrt(aligned_sq(a[i], b[j])) <= eps
    return close


def distance_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances between the rows of a and the rows of b."""
    if a.shape[1] <= FEW_DIMENSIONS:
        gap = np.sqrt(pairwise_sq(a, b))
        return gap * (1 - 1e-12), gap * (1 + 1e-12)
    total, error = screened_sq(a, b)
    return np.sqrt(np.maximum(total - error, 0.0)), np.sqrt(np.maximum(total + error, 0.0))


def row_blocks(rows: int, columns: int, pairs: int = PAIRS_PER_BLOCK):
    """Slices of rows small enough for one distance matrix."""
    step = max(1, pairs // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def nearest(x: np.ndarray, points: np.ndarray, squared: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest point (the lowest index wins ties) and the distance to it."""
    near = np.empty(len(x), dtype=np.int32)
    few = x.shape[1] <= FEW_DIMENSIONS
    norms = None if few else np.einsum("ij,ij->i", points, points)
    for block in row_blocks(len(x), len(points), PAIRS_PER_BLOCK if few else PAIRS_PER_PRODUCT):
        part = x[block]
        if few:
            near[block] = _first_lowest(part, points, squared)
            continue
        total, error = screened_sq(part, points, norms)
        near[block] = total.argmin(axis=1)
        rivals = (total <= total.min(axis=1)[:, None] + 2.0 * error).sum(axis=1) > 1
        if rivals.any():
            near[np.flatnonzero(rivals) + block.start] = _first_lowest(part[rivals], points, squared)
    gap = aligned_sq(x, points[near])
    return near, gap if squared else np.sqrt(gap)


def _first_lowest(x, points, squared):
    total = pairwise_sq(x, points)
    return (total if squared else np.sqrt(total)).argmin(axis=1)


def window_copies(x, points, near, near_distance, eps, form) -> np.ndarray:
    """Which points a row is copied to: the nearest one, and every other whose border with it is at most eps away."""
    bases, of = np.unique(near, return_inverse=True)
    copies = window_borders(x, points, points[bases], of, near_distance, eps, form)
    copies[np.arange(len(x)), near] = True
    return copies


def window_borders(x, points, bases, of, near_distance, eps, form) -> np.ndarray:
    """Which points' borders with the base of a row, bases[of[row]], are at most eps from the row.

    Distances between points are only taken from those that are nearest to some row, and in many dimensions by matrix
    product; pairs too close to call are counted again coordinate by coordinate.
    """
    hits = np.empty((len(x), len(points)), dtype=bool)
    screened = form == "euclidean" and x.shape[1] > FEW_DIMENSIONS
    norms = np.einsum("ij,ij->i", points, points)
    for block in row_blocks(len(x), len(points), PAIRS_PER_PRODUCT if screened else PAIRS_PER_BLOCK):
        part, base, d_base = x[block], of[block], near_distance[block]
        own, at = np.unique(base, return_inverse=True)
        if screened:
            total, error = screened_sq(part, points, norms)
            apart, apart_error = screened_sq(bases[own], points, norms)
            # Far apart points have a small relative error; the few close ones are counted exactly.
            i, j = np.nonzero(apart <= 1e6 * apart_error)
            apart[i, j] = aligned_sq(bases[own[i]], points[j])
            between = np.sqrt(apart)[at]
            gap = total - (d_base * d_base)[:, None]
            reach = 2.0 * eps * between
            hit = (gap <= reach) & (between > 0)
            slack = 4.0 * error + 8.0 * np.finfo(float).eps * np.abs(reach) + 1e-5 * np.abs(reach)
            i, j = np.nonzero(np.abs(gap - reach) <= slack)
            if len(i):
                d, exact = np.sqrt(aligned_sq(part[i], points[j])), np.sqrt(aligned_sq(bases[base[i]], points[j]))
                hit[i, j] = border(d, d_base[i], exact, form) <= eps
        else:
            d = np.sqrt(pairwise_sq(part, points))
            between = np.sqrt(pairwise_sq(bases[own], points))[at]
            hit = border(d, d_base[:, None], between, form) <= eps
        hits[block] = hit
    return hits


def border(d, d_base, between, form):
    """Distance from a row to the border between its nearest point and another, or its lower bound in a general metric
    space. Equal points have no border: not a number."""
    if form == "metric":
        return (d - d_base) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (d * d - d_base * d_base) / (2 * between)
