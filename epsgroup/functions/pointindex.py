"""Index over the points that rows are compared with, such as pivots or centres.

The points stand in about sqrt(k) groups around some of them. A row looks into a group only if the triangle inequality lets a point
of it be near enough, so for rows that lie in heaps most distances are never counted, and none is missed: results are those of
comparing with all points, ties included. It holds for every metric.
"""

import math

import numpy as np

from epsgroup.functions import kernels

LEAST = 64  # points; fewer stand in one group
SHARE = 4  # a block that must look at more than this part of all its distances is compared with all points at once, which is faster
_OUT, _IN = 1 + 1e-9, 1 - 1e-9  # room for rounding where groups are passed over


def farthest_first(points, number, metric) -> np.ndarray:
    """The first point, then each time the one farthest from those taken, so that no point is far from all of them."""
    taken, gap = [0], metric.bounds(points, points[:1])[1][:, 0]
    while len(taken) < number and gap.max() > 0:
        taken.append(int(gap.argmax()))
        np.minimum(gap, metric.bounds(points, points[taken[-1:]])[1][:, 0], out=gap)
    return points[taken]


class PointIndex:
    """Built on the driver and sent to the tasks. Holds arrays only; the metric comes with every call.

    `compared` counts the distances to points and to leaders since it was last set to 0.
    """

    def __init__(self, points, metric):
        self.points, self.compared = np.asarray(points, dtype=float), 0
        k = len(self.points)
        leaders = farthest_first(self.points, math.isqrt(k) if k >= LEAST else 1, metric)
        of, gap = metric.nearest(self.points, leaders)
        used = np.unique(of)
        self.leaders = leaders[used]
        self.members = [np.flatnonzero(of == g) for g in used]
        self.sizes = np.array([len(m) for m in self.members], dtype=float)
        self.radius = np.array([gap[m].max() for m in self.members]) * _OUT

    def __len__(self):
        return len(self.points)

    def blocks(self, rows: int):
        """Slices of rows whose bounds to all leaders stay small."""
        return kernels.row_blocks(rows, len(self.members), kernels.PAIRS_PER_PRODUCT)

    def _least(self, x, metric):
        """(least distance a point of each group can have, group with the nearest leader) for each row."""
        if len(self.members) == 1:
            return np.zeros((len(x), 1)), np.zeros(len(x), int)
        low, high = metric.bounds(x, self.leaders)
        self.compared += low.size
        return low * _IN - self.radius, high.argmin(axis=1)

    def _many(self, wanted) -> bool:
        """Whether the groups wanted for each row hold so many points that a plain scan is better."""
        return len(self.members) > 1 and SHARE * float((wanted @ self.sizes).sum()) > len(wanted) * len(self)

    def nearest(self, x, metric, squared=False) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point (the lowest index wins ties) and the distance to it, for the Euclidean metric also squared."""
        near, gap = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        for block in self.blocks(len(x)):
            near[block], gap[block] = self._nearest(x[block], metric, squared)
        return near, gap

    def _nearest(self, x, metric, squared):
        near, gap = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
        least, home = self._least(x, metric)

        def look(rows, members):
            self.compared += len(rows) * len(members)
            points = self.points[members]
            index, found = kernels.nearest(x[rows], points, True) if squared else metric.nearest(x[rows], points)
            return members[index], found

        for g in np.unique(home):
            rows = np.flatnonzero(home == g)
            near[rows], gap[rows] = look(rows, self.members[g])
        if self._many(least <= ((np.sqrt(gap) if squared else gap) * _OUT)[:, None]):
            return look(np.arange(len(x)), np.arange(len(self)))
        for g, members in enumerate(self.members if len(self.members) > 1 else []):
            reach = (np.sqrt(gap) if squared else gap) * _OUT
            rows = np.flatnonzero((least[:, g] <= reach) & (home != g))
            if len(rows):
                index, found = look(rows, members)
                closer = (found < gap[rows]) | ((found == gap[rows]) & (index < near[rows]))
                near[rows[closer]], gap[rows[closer]] = index[closer], found[closer]
        return near, gap

    def bordering(self, x, bases, of, gap, metric, eps, form) -> tuple[np.ndarray, np.ndarray]:
        """(row, point) where the border between row i's base, bases[of[i]] at distance gap[i], and the point is at most eps from
        the row. The border is no nearer than half of what the point is farther than the base."""
        at, to = [np.zeros(0, int)], [np.zeros(0, int)]
        for block in self.blocks(len(x)):
            least, _ = self._least(x[block], metric)
            wanted = least <= ((gap[block] + 2 * eps) * _OUT)[:, None]
            if self._many(wanted):
                every = np.arange(len(self))
                parts = kernels.row_blocks(len(wanted), len(self), kernels.PAIRS_PER_PRODUCT)
                looks = [(block.start + np.arange(part.start, part.stop), every) for part in parts]
            else:
                looks = [(np.flatnonzero(wanted[:, g]) + block.start, members) for g, members in enumerate(self.members)]
            for rows, members in looks:
                if not len(rows):
                    continue
                self.compared += len(rows) * len(members)
                own, place = np.unique(of[rows], return_inverse=True)
                hit = metric.bordering(x[rows], self.points[members], bases[own], place, gap[rows], eps, form)
                i, j = np.nonzero(hit)
                at.append(rows[i])
                to.append(members[j])
        return np.concatenate(at), np.concatenate(to)

    def targets(self, x, near, gap, metric, eps, form) -> tuple[np.ndarray, np.ndarray]:
        """(row, point) for the points a row is copied to, in this order: its nearest one and those bordering on it."""
        at, to = self.bordering(x, self.points, near, gap, metric, eps, form)
        other = to != near[at]
        at, to = np.concatenate([np.arange(len(x)), at[other]]), np.concatenate([near, to[other]])
        order = np.lexsort((to, at))
        return at[order], to[order]
