"""Distances that vectors can be grouped by. Anything that is a metric will do, as partitioning and grouping use only the triangle
inequality, unless a metric says that more holds."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from epsgroup.functions import kernels


@dataclass(frozen=True)
class Metric:
    """aligned(a, b): distances of row i of a to row i of b; pairwise(a, b): those of all rows of a to all rows of b.

    `coordinatewise`: no two coordinates differ by more than the distance. Both functions must count alike, as results depend on
    whether a distance is at most eps. They run inside tasks, on blocks of vectors.
    """

    name: str
    aligned: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]
    coordinatewise: bool = False

    def within(self, a, b, eps) -> np.ndarray:
        """True where a row of a and a row of b are at most eps apart."""
        return self.pairwise(a, b) <= eps

    def bounds(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all distances."""
        gap = self.pairwise(a, b)
        return gap * (1 - 1e-12), gap * (1 + 1e-12)

    def nearest(self, x, points) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point (the lowest index wins ties) and the distance to it."""
        near = np.empty(len(x), np.int32)
        for block in kernels.row_blocks(len(x), len(points)):
            near[block] = self.pairwise(x[block], points).argmin(axis=1)
        return near, self.aligned(x, points[near])

    def copies(self, x, points, near, gap, eps, form) -> np.ndarray:
        """Which points a row is copied to: the nearest one, and every other that may be nearest to a row within eps of it."""
        out = self.bordering(x, points, points, near, gap, eps, form)
        out[np.arange(len(x)), near] = True
        return out

    def bordering(self, x, points, bases, of, gap, eps, form) -> np.ndarray:
        """Which points may be nearest to a row within eps of a row whose nearest one is bases[of[row]], gap away."""
        out = np.empty((len(x), len(points)), bool)
        for block in kernels.row_blocks(len(x), len(points)):
            out[block] = kernels.border(self.pairwise(x[block], points), gap[block][:, None], None, "metric") <= eps
        return out


class _Euclidean(Metric):
    """Counted coordinate by coordinate, with matrix products to screen pairs of many coordinates; has a window of its own."""

    def within(self, a, b, eps):
        return kernels.within(a, b, eps)

    def bounds(self, a, b):
        return kernels.distance_bounds(a, b)

    def nearest(self, x, points):
        return kernels.nearest(x, points, squared=False)

    def copies(self, x, points, near, gap, eps, form):
        return kernels.window_copies(x, points, near, gap, eps, form)

    def bordering(self, x, points, bases, of, gap, eps, form):
        return kernels.window_borders(x, points, bases, of, gap, eps, form)


def _by_coordinate(fold):
    """Distances from a fold over the absolute differences, from the first coordinate to the last."""

    def aligned(a, b):
        total = np.zeros(len(a))
        for j in range(a.shape[1]):
            total = fold(total, np.abs(a[:, j] - b[:, j]))
        return total

    def pairwise(a, b):
        total = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            total = fold(total, np.abs(a[:, j, None] - b[None, :, j]))
        return total

    return aligned, pairwise


EUCLIDEAN = _Euclidean("euclidean", lambda a, b: np.sqrt(kernels.aligned_sq(a, b)), lambda a, b: np.sqrt(kernels.pairwise_sq(a, b)), True)
MANHATTAN = Metric("manhattan", *_by_coordinate(np.add), True)
MAXIMUM = Metric("maximum", *_by_coordinate(np.maximum), True)
