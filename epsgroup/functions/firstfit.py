"""First-fit grouping of one bounded block of vectors."""

import numpy as np

from epsgroup.functions.metrics import EUCLIDEAN

SAFE = 1.0 - 1e-9
BLOCK = 256


class Group:
    """Members of one group in the block, and a ball around them that lets most rows join without a full check."""

    __slots__ = ("rows", "size", "center", "radius", "due", "metric")

    def __init__(self, metric=EUCLIDEAN):
        self.metric = metric
        self.rows = np.empty(4, dtype=np.int64)
        self.size = 0
        self.center = None
        self.radius = 0.0
        self.due = 16

    def accepts(self, x, i, eps):
        if self.size == 0:
            return True
        if self.center is not None:
            if self.gap(x, i) + self.radius <= eps * SAFE:
                return True
        members = self.rows[: self.size]
        for start in range(0, self.size, 1024):
            if not self.metric.within(x[i : i + 1], x[members[start : start + 1024]], eps).all():
                return False
        return True

    def gap(self, x, i):
        return float(self.metric.aligned(x[i : i + 1], self.center[None])[0])

    def take(self, x, i):
        if self.size == len(self.rows):
            self.rows = np.resize(self.rows, 2 * self.size)
        self.rows[self.size] = i
        self.size += 1
        if self.center is not None:
            self.radius = max(self.radius, self.gap(x, i))
        if self.size == self.due:
            members = x[self.rows[: self.size]]
            self.center = members.mean(axis=0)
            self.radius = float(self.metric.aligned(members, np.broadcast_to(self.center, members.shape)).max())
            self.due *= 2


def first_fit(ids, x, eps, offers=None, metric=EUCLIDEAN):
    """Group of every row, named by the id of the row that founded it.

    Rows come in ascending id and join the first group all of whose members lie within eps, or else found a group.
    `offers[i]` holds earlier groups, ascending, that accept row i as far as their members outside this block go.
    """
    groups: dict[int, Group] = {}
    founders: list[int] = []
    label = np.empty(len(x), dtype=np.int64)
    for start in range(0, len(x), BLOCK):
        stop = min(len(x), start + BLOCK)
        known = np.array(founders, dtype=np.int64)
        near_known = metric.within(x[start:stop], x[known], eps) if len(known) else None
        near_block = metric.within(x[start:stop], x[start:stop], eps)
        fresh: list[int] = []
        for i in range(start, stop):
            row = i - start
            chosen = None
            for key in offers[i] if offers is not None else ():
                group = groups.get(key)
                if group is None or group.accepts(x, i, eps):
                    chosen = key
                    break
            if chosen is None:
                candidates = known[near_known[row]] if near_known is not None else ()
                for f in (*candidates, *(f for f in fresh if near_block[row, f - start])):
                    if groups[int(ids[f])].accepts(x, i, eps):
                        chosen = int(ids[f])
                        break
            if chosen is None:
                chosen = int(ids[i])
                fresh.append(i)
            if chosen not in groups:
                groups[chosen] = Group(metric)
            groups[chosen].take(x, i)
            label[i] = chosen
        founders.extend(fresh)
    return label


class Cells:
    """Row numbers by cell of a grid over the plane."""

    def __init__(self, plane: np.ndarray, side: float):
        self.cells = np.floor(plane / side).astype(np.int64)
        self.rows: dict[tuple, list[int]] = {}

    def add(self, i: int) -> None:
        self.rows.setdefault(tuple(self.cells[i].tolist()), []).append(i)

    def around(self, i: int) -> list[int]:
        """The rows added in the cell of row i and the eight next to it."""
        x, y = self.cells[i].tolist()
        return [j for a in (x - 1, x, x + 1) for b in (y - 1, y, y + 1) for j in self.rows.get((a, b), ())]


def first_fit_in_cells(ids, x, plane, eps, group, decided, home, metric=EUCLIDEAN):
    """(group of every row, whether it is decided, distances counted) after one pass over a tile and its surroundings.

    Rows come in ascending id; `plane` holds two of their coordinates. Of the rows not `decided` yet, those at `home` are decided
    as `first_fit` would, unless an undecided earlier row is within 2 eps; those around the tile stay undecided. A row meets the
    founders, members and waiting rows of the cells next to its own only.
    """
    label, done = group.copy(), decided.copy()
    waiting, founders = Cells(plane, 2 * eps * (1 + 1e-9)), Cells(plane, eps * (1 + 1e-9))
    groups: dict[int, Group] = {}
    pairs = 0

    def take(i, key):
        if key not in groups:
            groups[key] = Group(metric)
        if ids[i] == key:
            founders.add(i)
        groups[key].take(x, i)

    for i in range(len(x)):
        if done[i]:
            take(i, int(label[i]))
            continue
        blocked = not home[i]
        if not blocked:
            near = waiting.around(i)
            pairs += len(near)
            blocked = bool(near) and bool(metric.within(x[i : i + 1], x[near], 2 * eps * (1 + 1e-9)).any())
        if blocked:
            waiting.add(i)
            continue
        near = sorted(founders.around(i))
        pairs += len(near)
        key = int(ids[i])
        if near:
            for j in np.array(near)[metric.within(x[i : i + 1], x[near], eps)[0]].tolist():
                pairs += groups[int(ids[j])].size
                if groups[int(ids[j])].accepts(x, i, eps):
                    key = int(ids[j])
                    break
        label[i], done[i] = key, True
        take(i, key)
    return label, done, pairs


def lowest(label, base):
    """The lowest base index in the group of each row, for every round."""
    _, group = np.unique(label, return_inverse=True)
    low = np.full((group.max(initial=-1) + 1, base.shape[1]), np.iinfo(np.int32).max, dtype=np.int64)
    np.minimum.at(low, group, base)
    return low[group]


def owned(label, base, assigned):
    """True for rows of groups whose lowest base index is the assigned index, or one of several, in every round."""
    keep, low = np.ones(len(label), dtype=bool), lowest(label, base)
    for r, index in enumerate(assigned):
        keep &= np.isin(low[:, r], index)
    return keep
